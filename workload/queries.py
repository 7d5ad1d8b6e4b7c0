"""One registered query per operator group, each with its SQL counterpart where SQL can
say it. Every query reads whole tables; sheets with planted faults come from `fixtures`."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyfold import fixed
from keyfold.functions import cells
from keyfold.model import ORD, Sheet
from keyfold.operators import checks, clean, conflicts, derive, entities, layout, mapping, merge, mlready, profile, rollup, suggest
from keyfold.plans import audit, consolidate
from keyfold.schema import CanonicalSchema
from keyfold.session import tune, work_folder
from keyfold.sources import catalog, master, sinks, states, tables
from workload.fixtures import ctes, sheet, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2000-01-01"
KEYS = fixed.KEY_COLS
ORDER = F.col


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(tune(spark), sf)
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


def half_even(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}::DOUBLE"
    return f"(round_even(CAST(({expr}) AS DOUBLE) * {scale}, 0) / {scale})"


def round_exact(expr: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', CAST(({expr}) AS DOUBLE)) AS DOUBLE)"


def as_of():
    return F.lit(datetime.date.fromisoformat(AS_OF))


# --- merge -----------------------------------------------------------------------------

_FULL = """
    SELECT coalesce(l.account_id, r.account_id) AS account_id, coalesce(l.close_date, r.close_date) AS close_date, {cols}
    FROM {l} l FULL JOIN {r} r ON l.account_id IS NOT DISTINCT FROM r.account_id
                              AND l.close_date IS NOT DISTINCT FROM r.close_date"""
_KEYED = "(SELECT * FROM {} WHERE account_id IS NOT NULL OR close_date IS NOT NULL)"


def _full(left: str, right: str, cols: str) -> str:
    return _FULL.format(l=left, r=right, cols=cols)


@query("merge_full_outer", ctes("crm", "billing") + _full(
    _KEYED.format("crm"), _KEYED.format("billing"), "l.deal_value, coalesce(l.stage, r.stage) AS stage, r.priority"))
def merge_full_outer(spark, sf):
    return merge.merge_sheets([sheet(spark, sf, "crm"), sheet(spark, sf, "billing")], on_conflict="keep_left", plan="pad")


@query("merge_n_way", ctes("crm", "billing", "shipments") + ", m AS (" + _full(
    _KEYED.format("crm"), _KEYED.format("billing"), "l.deal_value, coalesce(l.stage, r.stage) AS stage, r.priority")
    + ")" + _full("m", "shipments", "l.deal_value, coalesce(l.stage, r.stage) AS stage, l.priority, r.shipped"))
def merge_n_way(spark, sf):
    return merge.merge_sheets([sheet(spark, sf, n) for n in ("crm", "billing", "shipments")],
                              on_conflict="keep_left", plan="pad")


@query("merge_n_way_unique", ctes("crm_unique", "billing_unique", "shipments") + ", m AS (" + _full(
    "crm_unique", "billing_unique", "l.deal_value, coalesce(l.stage, r.stage) AS stage, r.priority")
    + ")" + _full("m", "shipments", "l.deal_value, coalesce(l.stage, r.stage) AS stage, l.priority, r.shipped"))
def merge_n_way_unique(spark, sf):
    return merge.merge_sheets([sheet(spark, sf, n) for n in ("crm_unique", "billing_unique", "shipments")],
                              on_conflict="keep_left", plan="stack")


@query("merge_default_plan", ctes("crm", "billing") + _full(
    _KEYED.format("crm"), _KEYED.format("billing"), "l.deal_value, coalesce(l.stage, r.stage) AS stage, r.priority"))
def merge_default_plan(spark, sf):
    """Keys that repeat, with the plan the library chooses."""
    return merge.merge_sheets([sheet(spark, sf, "crm"), sheet(spark, sf, "billing")], on_conflict="keep_left")


@query("merge_salted", ctes("crm", "billing") + """
    SELECT coalesce(l.account_id, r.account_id) AS account_id, coalesce(l.close_date, r.close_date) AS close_date,
           l.deal_value, coalesce(l.stage, r.stage) AS stage, r.priority
    FROM (SELECT * FROM crm WHERE account_id IS NOT NULL) l
    FULL JOIN (SELECT * FROM billing WHERE account_id IS NOT NULL) r ON l.account_id = r.account_id""")
def merge_salted(spark, sf):
    """Accounts of more than ten rows on both sides, which are dealt over salts."""
    return merge.merge_sheets([sheet(spark, sf, "crm"), sheet(spark, sf, "billing")], ["account_id"],
                              on_conflict="keep_left", hot_rows=10)


_SIX = {"crm": ["deal_value", "stage"], "billing": ["priority", "stage"], "shipments": ["shipped", "stage"], "crm_unique": ["deal_value", "stage"],
        "billing_unique": ["priority", "stage"], "usage": ["usage"]}


def _chain(sheets: dict[str, list[str]]) -> tuple[list[str], list[str], list[str]]:
    """CTEs of a merge sheet by sheet (m1, m2, ...), its columns, and a query of each sheet's differing row pairs."""
    (first, columns), *rest = sheets.items()
    columns, ctes_, pairs = list(columns), [f"m1 AS {_KEYED.format(first)}"], []
    on = "l.account_id IS NOT DISTINCT FROM r.account_id AND l.close_date IS NOT DISTINCT FROM r.close_date"
    for i, (name, own) in enumerate(rest, 2):
        right = _KEYED.format(name)
        for c in (c for c in own if c in columns):
            pairs.append(f"""SELECT {i} AS sheet, '{c}' AS "column", l.account_id, l.close_date FROM m{i - 1} l JOIN {right} r ON {on}
                WHERE l.{c} IS NOT NULL AND r.{c} IS NOT NULL AND trim(CAST(l.{c} AS STRING)) <> trim(CAST(r.{c} AS STRING))""")
        picked = [f"coalesce(l.{c}, r.{c}) AS {c}" if c in columns and c in own else f"l.{c}" if c in columns else f"r.{c}" for c in dict.fromkeys([*columns, *own])]
        ctes_.append(f"m{i} AS ({_full(f'm{i - 1}', right, ', '.join(picked))})")
        columns = list(dict.fromkeys([*columns, *own]))
    return ctes_, columns, pairs


_SIX_CTES, _SIX_COLS, _SIX_PAIRS = _chain(_SIX)


@query("merge_six_sheets", ctes(*_SIX) + ", " + ", ".join(_SIX_CTES) + f" SELECT account_id, close_date, {', '.join(_SIX_COLS)} FROM m6")
def merge_six_sheets(spark, sf):
    """Six sheets, keys that repeat in some, with the plan the library chooses."""
    return merge.merge_sheets([sheet(spark, sf, n) for n in _SIX], on_conflict="keep_left")


@query("conflicts_six_sheets", ctes(*_SIX) + ", " + ", ".join(_SIX_CTES) + ", p AS (" + " UNION ALL ".join(_SIX_PAIRS) + """),
    k AS (SELECT sheet, "column", 'account_id=' || coalesce(account_id, 'null') || ', close_date=' || coalesce(close_date, 'null') AS key, count(*) AS n FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY sheet, "column" ORDER BY key) AS example_no, sum(n) OVER (PARTITION BY sheet, "column") AS total FROM k)
    SELECT sheet, "column", CAST(total AS BIGINT) AS n_conflicts, CAST(example_no AS INTEGER) AS example_no, key FROM r WHERE example_no <= 3""")
def conflicts_six_sheets(spark, sf):
    """Each sheet against the merge of all before it, in one query."""
    sheets = [merge.drop_keyless(sheet(spark, sf, n), KEYS) for n in _SIX]
    return conflicts.sheet_conflicts(sheets).select("sheet", "column", "n_conflicts", "example_no", "key")


@query("merge_stored_layout", ORACLE["merge_six_sheets"])
def merge_stored_layout(spark, sf):
    """Six sheets stored once by their keys; the merge follows the stored buckets."""
    return layout.merge_stored(layout.store_sheets([sheet(spark, sf, n) for n in _SIX], buckets=8), "keep_left")


@query("conflicts_stored_layout", ORACLE["conflicts_six_sheets"])
def conflicts_stored_layout(spark, sf):
    """The conflict check over the same stored buckets."""
    stored = layout.store_sheets([sheet(spark, sf, n) for n in _SIX], buckets=8)
    return layout.stored_conflicts(stored).select("sheet", "column", "n_conflicts", "example_no", "key")


@query("append_parts", ctes("crm", "usage", "shipments") + ", m AS (" + _full("crm", "usage", "l.deal_value, l.stage, r.usage") + ")"
       + _full("m", "shipments", "l.deal_value, coalesce(l.stage, r.stage) AS stage, l.usage, r.shipped"))
def append_parts(spark, sf):
    """Two appends to a stored master, each of which replaces only the parts of its keys."""
    path = work_folder(spark, "parts")
    master.create_master(sheet(spark, sf, "crm"), path, parts=32)
    master.append_rows(spark, path, sheet(spark, sf, "usage"), 1, "keep_left")
    master.append_rows(spark, path, sheet(spark, sf, "shipments"), 2, "keep_left")
    return master.read_master(spark, path)


@query("base_choice", ctes("order_text", "customer_text") + """
    SELECT order_id, o.customer_id, status, amount, order_date, name, segment
    FROM order_text o LEFT JOIN (SELECT customer_id, name, segment FROM customer_text) c ON o.customer_id = c.customer_id""")
def base_choice(spark, sf):
    """No base named: the sheet with most rows becomes it."""
    sheets = {"customers": sheet(spark, sf, "customer_text").select("customer_id", "name", "segment"), "orders": sheet(spark, sf, "order_text").drop(ORD)}
    return merge.join_entities(sheets, join_keys=["customer_id"])


@query("append_master", ctes("crm", "usage") + _full("crm", "usage", "l.deal_value, l.stage, r.usage"))
def append_master(spark, sf):
    return merge.append_to_master(sheet(spark, sf, "crm"), sheet(spark, sf, "usage"), on_conflict="keep_left", plan="pad")


@query("merge_conflicts", ctes("crm", "billing") + """,
    pairs AS (SELECT l.account_id, l.close_date, trim(l.stage) AS a, trim(r.stage) AS b FROM crm l JOIN billing r
              ON l.account_id IS NOT DISTINCT FROM r.account_id AND l.close_date IS NOT DISTINCT FROM r.close_date
              WHERE (l.account_id IS NOT NULL OR l.close_date IS NOT NULL)
                AND l.stage IS NOT NULL AND r.stage IS NOT NULL AND trim(l.stage) <> trim(r.stage)),
    firsts AS (SELECT 'account_id=' || coalesce(account_id, 'null') || ', close_date=' || coalesce(close_date, 'null') AS key
               FROM pairs GROUP BY 1 ORDER BY 1 LIMIT 3)
    SELECT 'stage' AS "column", CAST((SELECT count(*) FROM pairs) AS BIGINT) AS n_conflicts,
           CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS example_no, key FROM firsts""")
def merge_conflicts(spark, sf):
    left, right = (merge.drop_keyless(sheet(spark, sf, n), KEYS) for n in ("crm", "billing"))
    return merge.find_conflicts(left, right).select("column", "n_conflicts", "example_no", "key")


@query("master_preview", ctes("crm") + """
    SELECT * FROM crm ORDER BY account_id NULLS LAST, close_date NULLS LAST, deal_value, stage LIMIT 100""")
def master_preview(spark, sf):
    return merge.preview(sheet(spark, sf, "crm"))


@query("master_summary", ctes("crm", "usage") + ", m AS (" + _full("crm", "usage", "l.deal_value, l.stage, r.usage") + f""")
    , c AS (SELECT count(*) AS total, count(account_id) AS a, count(close_date) AS d FROM m)
    SELECT 'account_id' AS key, a AS non_null, total, {round_exact('a / total * 100', 1)} AS pct, 5 AS column_count FROM c
    UNION ALL SELECT 'close_date', d, total, {round_exact('d / total * 100', 1)}, 5 FROM c""")
def master_summary(spark, sf):
    return merge.master_summary(append_master(spark, sf))


@query("map_columns", ctes("raw_text") + """
    SELECT "Deal No" AS contract_id, "Annual Cost" AS acv, "Signed Date" AS close_date FROM raw_text""")
def map_columns(spark, sf):
    raw = Sheet("raw", sheet(spark, sf, "raw_text"))
    wanted = {"Deal No": " contract_id", "Annual Cost": "acv", "Signed Date": "close_date", "Notes": "", "absent": "x"}
    return mapping.map_sheets([raw], wanted, keys=["contract_id"])[0].df.drop(ORD)


# --- rollup ----------------------------------------------------------------------------

_FIRST = "first({c} ORDER BY _ord) FILTER (WHERE {c} IS NOT NULL) AS {c}"
_UNIQUE = """(SELECT string_agg(v, ' | ' ORDER BY o) FROM
    (SELECT {c} AS v, min(_ord) AS o FROM lines i WHERE i.contract_id = k.contract_id AND {c} IS NOT NULL GROUP BY 1))"""
_ROLLUP_COLS = ["contract_id", "account_id", "total_value", "quantity", "discount", "start_date", "end_date",
                "renewal_date", "term_months", "auto_renew", "product", "vendor", "tax", "line_item_count"]
_ROLLUP_SQL = f"""
    products AS (SELECT contract_id, string_agg(v, ' | ' ORDER BY o) AS product FROM
        (SELECT contract_id, product AS v, min(_ord) AS o FROM lines WHERE contract_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    grouped AS (SELECT contract_id, {_FIRST.format(c="account_id")}, coalesce(sum(total_value), 0) AS total_value,
        coalesce(sum(quantity), 0) AS quantity, avg(discount) AS discount, min(start_date) AS start_date,
        max(end_date) AS end_date, max(renewal_date) AS renewal_date, max(term_months) AS term_months,
        {_FIRST.format(c="auto_renew")}, {_FIRST.format(c="vendor")}, coalesce(sum(tax), 0) AS tax,
        count(*) AS line_item_count
        FROM lines WHERE contract_id IS NOT NULL GROUP BY 1),
    records AS (SELECT {", ".join(_ROLLUP_COLS)} FROM grouped JOIN products USING (contract_id)
        UNION ALL SELECT contract_id, account_id, total_value, quantity, discount, start_date, end_date, renewal_date,
            term_months, auto_renew, product, vendor, tax, 1 FROM lines WHERE contract_id IS NULL)"""


def _rolled(spark, sf) -> DataFrame:
    return rollup.rollup(sheet(spark, sf, "lines"))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: cells.half_even(c, d) for c, d in digits.items()})


@query("rollup_contracts", ctes("lines") + "," + _ROLLUP_SQL + f"""
    SELECT contract_id, account_id, {half_even("total_value", 2)} AS total_value, quantity,
           {half_even("discount", 6)} AS discount, start_date, end_date, renewal_date, term_months, auto_renew,
           product, vendor, {half_even("tax", 4)} AS tax, line_item_count FROM records""")
def rollup_contracts(spark, sf):
    return _rounded(_rolled(spark, sf), total_value=2, discount=6, tax=4).select(*_ROLLUP_COLS)


@query("count_rule", ctes("lines") + """
    SELECT contract_id, count(*) AS vendor, count(*) AS discount, count(*) AS line_item_count
    FROM lines WHERE contract_id IS NOT NULL GROUP BY 1""")
def count_rule(spark, sf):
    keyed, _ = merge.split_keyed(sheet(spark, sf, "lines"), ["contract_id"])
    return rollup.group_aggregate(keyed, ["contract_id"], {"vendor": "count", "discount": "count"}, F.col(ORD), "line_item_count")


@query("classify_grain", ctes("lines", "faulty") + "".join(f"""
    {union} SELECT '{n}' AS sheet, CASE WHEN r > 0.9 THEN 'contract_level' WHEN r < 0.5 THEN 'line_item_level' ELSE 'mixed' END AS level,
        total_rows, unique_ids, {round_exact("r", 4)} AS uniqueness_ratio
    FROM (SELECT count(contract_id) AS total_rows, count(DISTINCT contract_id) AS unique_ids,
                 count(DISTINCT contract_id) / count(contract_id) AS r FROM {n})""" for union, n in (("", "lines"), ("UNION ALL", "faulty"))))
def classify_grain(spark, sf):
    parts = [rollup.classify_grain(sheet(spark, sf, n)).select(F.lit(n).alias("sheet"), "*") for n in ("lines", "faulty")]
    return parts[0].unionByName(parts[1])


@query("quote_lines", ctes("quotes") + f""",
    tabs AS (SELECT quote_id, booking_date, string_agg(v, ' | ' ORDER BY o) AS meta_source_tab FROM
        (SELECT quote_id, booking_date, meta_source_tab AS v, min(_ord) AS o FROM quotes WHERE booking_date IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT g.quote_id, g.booking_date, {half_even("amount", 2)} AS amount, flag, meta_source_tab FROM
        (SELECT quote_id, booking_date, sum(amount) AS amount, {_FIRST.format(c="flag")} FROM quotes
         WHERE booking_date IS NOT NULL GROUP BY 1, 2) g JOIN tabs t ON g.quote_id = t.quote_id AND g.booking_date = t.booking_date
    UNION ALL SELECT quote_id, booking_date, amount, flag, meta_source_tab FROM quotes WHERE booking_date IS NULL""")
def quote_lines(spark, sf):
    return _rounded(rollup.merge_quote_lines(sheet(spark, sf, "quotes")), amount=2)


@query("entity_left_join", ctes("crm", "billing") + """,
    clients AS (SELECT 'ACC-' || CAST(c_custkey AS STRING) AS account_id, c_mktsegment AS stage, c_acctbal FROM customer)
    SELECT b.account_id, b.close_date, b.deal_value, b.stage, c.stage AS stage_clients, c.c_acctbal
    FROM crm b LEFT JOIN clients c ON b.account_id IS NOT DISTINCT FROM c.account_id""")
def entity_left_join(spark, sf):
    clients = table(spark, sf, "customer").select(
        F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.col("c_mktsegment").alias("stage"), "c_acctbal", F.lit("x").alias("row_lineage_id"))
    return merge.join_entities({"crm": sheet(spark, sf, "crm"), "clients": clients}, primary="crm")


@query("concat_outer", ctes("crm", "usage", "nation_text") + """
    SELECT account_id, close_date, deal_value, stage, NULL AS usage, NULL AS nation_id, NULL AS name, NULL AS region_id FROM crm
    UNION ALL SELECT account_id, close_date, NULL, NULL, usage, NULL, NULL, NULL FROM usage
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, nation_id, name, region_id FROM nation_text""")
def concat_outer(spark, sf):
    return tables.drop_empty_columns(merge.concat_sheets([sheet(spark, sf, n) for n in ("crm", "usage", "nation_text")]))


@query("dedup_most_complete", ctes("doc_rows") + """
    SELECT text, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY
        -((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT), _ord) AS rn FROM doc_rows) WHERE rn = 1""")
def dedup_most_complete(spark, sf):
    return rollup.deduplicate(sheet(spark, sf, "doc_rows"), ["text", "not_there"]).drop(ORD)


@query("duplicate_ids", ctes("faulty") + """
    SELECT CAST(sum(n) AS BIGINT) AS rows_sharing_id, CAST(sum(n - 1) AS BIGINT) AS rows_beyond_first
    FROM (SELECT count(*) AS n FROM faulty WHERE contract_id IS NOT NULL GROUP BY contract_id) WHERE n > 1""")
def duplicate_ids(spark, sf):
    return rollup.duplicate_counts(sheet(spark, sf, "faulty"), "contract_id")


# --- cleaning --------------------------------------------------------------------------

_MONEY = """CASE o_orderkey % 5 WHEN 1 THEN floor(round(o_totalprice * 100) / 10000) * 100
            WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE o_totalprice END"""
_DATE = "CASE WHEN o_orderkey % 6 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END"
_BOOL = "CASE WHEN o_orderkey % 7 IN (0, 2, 3) THEN true WHEN o_orderkey % 7 IN (1, 4, 5) THEN false END"


@query("clean_currency", f"SELECT o_orderkey AS id, {_MONEY} AS amount FROM orders")
def clean_currency(spark, sf):
    return sheet(spark, sf, "raw_text").select(F.col(ORD).alias("id"), cells.parse_currency("Annual Cost").alias("amount"))


@query("clean_dates", f"""SELECT o_orderkey AS id, {_DATE} AS day, o_orderkey % 6 = 4 AS is_auto_renew,
    CASE WHEN o_orderkey % 6 = 5 THEN CAST(o_orderdate AS DATE) END AS range_end FROM orders""")
def clean_dates(spark, sf):
    raw = sheet(spark, sf, "raw_text")
    _, end = cells.split_range("Signed Date")
    ends = raw.select(F.col(ORD).alias("id"), "Signed Date", cells.single_date(end).alias("range_end"))
    return clean.normalize_dates(ends).select("id", F.col("Signed Date").alias("day"), "is_auto_renew", "range_end")


@query("clean_booleans", f"SELECT o_orderkey AS id, {_BOOL} AS auto_renew FROM orders")
def clean_booleans(spark, sf):
    raw = sheet(spark, sf, "raw_text")
    return clean.standardize_booleans(raw.select(F.col(ORD).alias("id"), F.col("Auto Renew").alias("auto_renew"), "Notes")) \
        .select("id", "auto_renew")


@query("clean_errors", """
    SELECT 'Deal No' AS "column", CAST(0 AS BIGINT) AS n_errors UNION ALL
    SELECT 'Annual Cost', count(*) FROM orders WHERE o_orderkey % 5 = 3 UNION ALL
    SELECT 'Signed Date', 0 UNION ALL SELECT 'Auto Renew', 0 UNION ALL
    SELECT 'Notes', count(*) FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 19 = 0""")
def clean_errors(spark, sf):
    return clean.error_counts(sheet(spark, sf, "raw_text"))


@query("clean_table", f"""
    SELECT CAST(o_orderkey AS STRING) AS "Deal No", {_MONEY} AS "Annual Cost", {_DATE} AS "Signed Date", {_BOOL} AS "Auto Renew",
           CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS "Notes",
           o_orderkey % 6 = 4 AS is_auto_renew FROM orders""")
def clean_table(spark, sf):
    return clean.clean_table(sheet(spark, sf, "raw_text")).drop(ORD)


@query("impute_acv", f"""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE {half_even("o_totalprice / (o_orderkey % 11 + 1) * 12", 2)} END AS "ACV"
    FROM orders""")
def impute_acv(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("ACV"),
        F.col("o_totalprice").alias("Total_Value"), (F.col("o_orderkey") % 11 + 1).alias("Term_Months"))
    return clean.scrub_financials(df).select("id", "ACV")


@query("typed_extraction", f"""
    SELECT o_orderkey AS _source_row_idx, 'deals' AS _source_sheet_id, CAST(o_orderkey AS STRING) AS contract_id, {_MONEY} AS acv,
           {_DATE} AS close_date, {_BOOL} AS auto_renew,
           CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS notes, CAST(NULL AS DOUBLE) AS quantity FROM orders""")
def typed_extraction(spark, sf):
    columns = {"contract_id": "Deal No", "acv": "Annual Cost", "close_date": "Signed Date", "auto_renew": "Auto Renew",
               "notes": "Notes", "quantity": "absent"}
    out = mapping.extract_sheet(Sheet("deals", sheet(spark, sf, "raw_text")), columns, CanonicalSchema.default())
    return out.drop("row_lineage_id")


# --- derived fields --------------------------------------------------------------------

_DERIVED = f"""
    d1 AS (SELECT * REPLACE ({half_even("total_value", 2)} AS total_value), date_diff('day', start_date, end_date) AS contract_duration_days FROM records),
    d2 AS (SELECT *, {half_even("contract_duration_days / 365.25::DOUBLE", 4)} AS duration_years FROM d1)"""


@query("derived_fields", ctes("lines") + "," + _ROLLUP_SQL + "," + _DERIVED + f"""
    SELECT contract_id, account_id, start_date, end_date, CAST(contract_duration_days AS INTEGER) AS contract_duration_days, duration_years,
           CASE WHEN duration_years <> 0 THEN {half_even("total_value / duration_years", 4)} END AS annualized_value,
           {half_even("total_value / term_months", 4)} AS monthly_value,
           coalesce(end_date < DATE '{AS_OF}', false) AND coalesce(auto_renew, false) IS DISTINCT FROM true AS churn_flag,
           coalesce(auto_renew, false) OR renewal_date IS NOT NULL AS renewal_flag FROM d2""")
def derived_fields(spark, sf):
    out = derive.derive_fields(_rounded(_rolled(spark, sf), total_value=2), as_of=as_of())
    return out.select(
        "contract_id", "account_id", "start_date", "end_date", *fixed.DERIVED_FIELDS)


# --- profiles --------------------------------------------------------------------------

_ORDER_COLS = ["order_id", "customer_id", "status", "amount", "order_date"]
_COLUMNS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v, _ord FROM order_text" for c in _ORDER_COLS)


@query("profile_columns", ctes("order_text") + f", cells AS ({_COLUMNS})" + f"""
    SELECT "column", 'string' AS inferred_type, count(*) AS n_rows, CAST(count_if(v IS NULL OR trim(v) = '') AS BIGINT) AS null_count,
           {round_exact("count_if(v IS NULL OR trim(v) = '') / count(*) * 100", 2)} AS null_pct,
           count(DISTINCT v) AS unique_count, {round_exact("count(DISTINCT v) / count(*)", 4)} AS uniqueness_ratio
    FROM cells GROUP BY 1""")
def profile_columns(spark, sf):
    return profile.profile_columns(sheet(spark, sf, "order_text"))


@query("top_values", ctes("order_text") + f", cells AS ({_COLUMNS})" + """
    SELECT "column", v AS "value", n, CAST(rn AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, o) AS rn FROM
            (SELECT "column", v, count(*) AS n, min(_ord) AS o FROM cells WHERE v IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 5""")
def top_values(spark, sf):
    return profile.top_values(sheet(spark, sf, "order_text"))


@query("distinct_samples", ctes("order_text") + f", cells AS ({_COLUMNS})" + """
    SELECT "column", string_agg(v, '; ' ORDER BY o) AS samples FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY o) AS rn FROM
            (SELECT "column", v, min(_ord) AS o FROM cells WHERE v IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 8 GROUP BY 1""")
def distinct_samples(spark, sf):
    return profile.distinct_samples(sheet(spark, sf, "order_text")).select(
        "column", F.array_join("samples", "; ").alias("samples"))


@query("random_sample", ctes("order_text") + """
    SELECT "value" FROM (SELECT trim(status) AS "value", md5('42|' || CAST(_ord AS STRING) || '|' || trim(status)) AS h FROM order_text
        WHERE trim(status) <> '') ORDER BY h, "value" LIMIT 50""")
def random_sample(spark, sf):
    return profile.random_sample(sheet(spark, sf, "order_text"), "status")


_STAT_COLS = ["total_value", "quantity", "discount", "term_months"]


@query("numeric_stats", ctes("lines") + " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS n, min({c}) AS min, max({c}) AS max, {round_exact(f"avg({c})", 2)} AS mean,
           {round_exact(f"median({c})", 2)} AS median, {round_exact(f"stddev_samp({c})", 2)} AS std FROM lines""" for c in _STAT_COLS))
def numeric_stats(spark, sf):
    return profile.numeric_stats(sheet(spark, sf, "lines").select(*_STAT_COLS, "product"))


@query("date_ranges", """
    SELECT 'Signed Date' AS "column", min(CAST(o_orderdate AS DATE)) AS min_date, max(CAST(o_orderdate AS DATE)) AS max_date
    FROM orders WHERE o_orderkey % 6 <> 4""")
def date_ranges(spark, sf):
    return profile.date_ranges(sheet(spark, sf, "raw_text"), ["Deal No", "Annual Cost", "Signed Date", "Notes"])


@query("median_epochs", """
    SELECT 'epoch' AS "column", count(*) AS n, min(e) AS min, max(e) AS max, """ + f"""{round_exact("avg(e)", 2)} AS mean, {round_exact("median(e)", 2)} AS median, {round_exact("stddev_samp(e)", 2)} AS std
    FROM (SELECT CAST(1500000000 + l_orderkey * 7 + l_linenumber AS DOUBLE) AS e FROM lineitem)""")
def median_epochs(spark, sf):
    """Epoch numbers all share their power of two, so a value bucket of fixed width would hold them all."""
    epochs = table(spark, sf, "lineitem").select((F.lit(1500000000) + F.col("l_orderkey") * 7 + F.col("l_linenumber")).cast("double").alias("epoch"))
    return profile.numeric_stats(epochs)


@query("full_profile", ctes("order_text") + f", cells AS ({_COLUMNS})" + f""",
    t AS (SELECT "column", string_agg(v || ' x' || n, '; ' ORDER BY rn) AS top_values FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, o) AS rn FROM
            (SELECT "column", v, count(*) AS n, min(_ord) AS o FROM cells WHERE v IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1),
    x AS (SELECT *, CASE WHEN regexp_matches(v, '^[0-9]+([.][0-9]+)?$') THEN CAST(v AS DOUBLE) END AS x, TRY_CAST(CASE WHEN v LIKE '____-__-__' THEN v END AS DATE) AS d FROM cells)
    SELECT 'orders' AS sheet, "column", 'string' AS inferred_type, count(*) AS n_rows, CAST(count_if(v IS NULL OR trim(v) = '') AS BIGINT) AS null_count,
           {round_exact("count_if(v IS NULL OR trim(v) = '') / count(*) * 100", 2)} AS null_pct,
           count(DISTINCT v) AS unique_count, {round_exact("count(DISTINCT v) / count(*)", 4)} AS uniqueness_ratio,
           nullif(count(x), 0) AS numeric_count, min(x) AS min, max(x) AS max, {round_exact("avg(x)", 2)} AS mean, {round_exact("median(x)", 2)} AS median,
           {round_exact("stddev_samp(x)", 2)} AS std, min(d) AS min_date, max(d) AS max_date, any_value(top_values) AS top_values
    FROM x JOIN t USING ("column") GROUP BY "column" """)
def full_profile(spark, sf):
    """All facts of a sheet's columns from one read of it."""
    tops = F.array_join(F.transform("top_values", lambda x: F.concat(x["value"], F.lit(" x"), x["n"].cast("string"))), "; ")
    return profile.full_profile(Sheet("orders", sheet(spark, sf, "order_text"))).withColumn("top_values", tops)


@query("duplicate_rows", ctes("line_codes") + f"""
    , c AS (SELECT order_id, part_number, flag, ship_date, quantity, count(*) AS n FROM line_codes GROUP BY ALL)
    , d AS (SELECT order_id, flag, quantity, count(*) AS n FROM line_codes GROUP BY ALL)
    SELECT 'line_codes' AS sheet, CAST(sum(n) AS BIGINT) AS row_count, 5 AS column_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count,
           {round_exact("sum(n - 1) / sum(n) * 100", 2)} AS duplicate_row_pct FROM c
    UNION ALL SELECT 'narrow', CAST(sum(n) AS BIGINT), 3, CAST(sum(n - 1) AS BIGINT), {round_exact("sum(n - 1) / sum(n) * 100", 2)} FROM d""")
def duplicate_rows(spark, sf):
    codes = sheet(spark, sf, "line_codes")
    narrow = Sheet("narrow", codes.select("order_id", "flag", "quantity"))
    return profile.profile_sheet(Sheet("line_codes", codes)).unionByName(profile.profile_sheet(narrow))


@query("key_candidates", ctes("order_text") + f", cells AS ({_COLUMNS})" + """
    SELECT "column" FROM cells GROUP BY 1 HAVING count(DISTINCT v) / count(*) > 0.9 AND count_if(v IS NULL OR trim(v) = '') / count(*) < 0.05""")
def key_candidates(spark, sf):
    return profile.key_candidates(profile.profile_columns(sheet(spark, sf, "order_text"))).select("column")


_TEXT_SHEETS = {"orders": ("order_text", _ORDER_COLS), "customers": ("customer_text", ["customer_id", "name", "nation_id", "segment"]),
                "nations": ("nation_text", ["nation_id", "name", "region_id"]), "regions": ("region_text", ["region_id", "name"])}


def _text_sheets(spark, sf) -> list[Sheet]:
    return [Sheet(n, sheet(spark, sf, f).select(*cols)) for n, (f, cols) in _TEXT_SHEETS.items()]


@query("foreign_keys", ctes("order_text", "customer_text", "nation_text", "region_text") + ", cells AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS no, '{n}' AS sheet, '{c}' AS col, {c} AS v FROM {f} WHERE {c} IS NOT NULL"
    for i, (n, (f, cols)) in enumerate(_TEXT_SHEETS.items()) for c in cols) + f"""),
    sizes AS (SELECT no, sheet, col, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 3),
    pairs AS (SELECT a.no AS na, a.sheet AS sa, a.col AS ca, b.no AS nb, b.sheet AS sb, b.col AS cb, count(*) AS common
              FROM cells a JOIN cells b ON a.v = b.v AND a.no < b.no GROUP BY ALL)
    SELECT sa AS sheet_1, ca AS column_1, sb AS sheet_2, cb AS column_2, {round_exact("common / least(x.n, y.n) * 100", 1)} AS overlap_pct
    FROM pairs JOIN sizes x ON na = x.no AND ca = x.col JOIN sizes y ON nb = y.no AND cb = y.col WHERE common / least(x.n, y.n) > 0.5""")
def foreign_keys(spark, sf):
    return profile.foreign_keys(_text_sheets(spark, sf))


@query("value_overlap", "SELECT count(*) AS overlap FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)")
def value_overlap(spark, sf):
    return profile.value_overlap(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "events"), "user_id")


@query("shared_columns", """
    SELECT * FROM (VALUES ('customer_id', 'customers; orders', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)),
        ('name', 'customers; nations; regions', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)),
        ('nation_id', 'customers; nations', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)),
        ('region_id', 'nations; regions', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region))) t("column", sheets, filled_cells)""")
def shared_columns(spark, sf):
    sheets = _text_sheets(spark, sf)
    filled = merge.concat_sheets([profile.completeness(s.df) for s in sheets]).groupBy(F.lower("column").alias("column")) \
        .agg(F.sum("non_null").alias("filled_cells"))
    return profile.shared_columns(sheets).join(filled, "column").select(
        "column", F.array_join("sheets", "; ").alias("sheets"), "filled_cells")


@query("line_item_hints", ctes("line_codes") + " , h AS (" + " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", 1 - count(DISTINCT {c}) / count({c}) AS r, count(DISTINCT {c}) AS unique_values, count({c}) AS total_rows
    FROM line_codes""" for c in ("order_id", "part_number")) + f""")
    SELECT 'line_codes' AS sheet, "column", {round_exact("r", 3)} AS duplicate_ratio, unique_values, total_rows FROM h WHERE r > 0.3""")
def line_item_hints(spark, sf):
    return profile.line_item_hints(Sheet("line_codes", sheet(spark, sf, "line_codes")))


@query("suggest_grain", ctes("line_codes") + """
    SELECT CASE WHEN r > 0.5 THEN 'line_item_level' WHEN r > 0.3 THEN 'mixed' ELSE 'contract_level' END AS suggestion,
           CASE WHEN r > 0.5 THEN 'high' WHEN r > 0.3 THEN 'low' ELSE 'medium' END AS confidence
    FROM (SELECT greatest(1 - count(DISTINCT order_id) / count(order_id), 1 - count(DISTINCT part_number) / count(part_number)) AS r FROM line_codes)""")
def suggest_grain(spark, sf):
    return profile.suggest_grain(line_item_hints(spark, sf))


# --- completeness ----------------------------------------------------------------------

_MASTER_COLS = ["account_id", "close_date", "deal_value", "stage", "priority"]
_MASTER = ctes("crm", "billing") + ", m AS (" + _full(
    "crm", "billing", "l.deal_value, coalesce(l.stage, r.stage) AS stage, r.priority") + """
    WHERE coalesce(l.account_id, r.account_id) IS NOT NULL OR coalesce(l.close_date, r.close_date) IS NOT NULL)
    , c AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) AS total FROM m" for c in _MASTER_COLS) + ")"


@query("completeness", _MASTER + f"""
    SELECT *, {round_exact("non_null / total * 100", 1)} AS pct FROM c""")
def completeness(spark, sf):
    return profile.completeness(merge_full_outer(spark, sf))


@query("quality_scorecard", _MASTER + f""", p AS (SELECT *, {round_exact("non_null / total * 100", 1)} AS pct FROM c)
    SELECT *, CASE WHEN pct >= 90 THEN 'Excellent' WHEN pct >= 60 THEN 'Fair' ELSE 'Poor' END AS rating FROM p""")
def quality_scorecard(spark, sf):
    return profile.quality_scorecard(merge_full_outer(spark, sf))


@query("overall_quality", _MASTER + f"""
    SELECT {round_exact("sum(non_null) / sum(total) * 100", 1)} AS overall_pct FROM c""")
def overall_quality(spark, sf):
    return profile.overall_quality(profile.quality_scorecard(merge_full_outer(spark, sf)))


@query("preview_completeness", ctes("order_text") + f", cells AS ({_COLUMNS})" + """
    SELECT "column", CAST(floor(count_if(trim(v) <> '') * 100 / count(*) + 0.5) AS INTEGER) AS pct FROM cells GROUP BY 1""")
def preview_completeness(spark, sf):
    return profile.preview_completeness(sheet(spark, sf, "order_text"))


@query("timeline", ctes("faulty") + """
    SELECT contract_id, CAST(NULL AS VARCHAR) AS vendor, start_date, end_date, total_value FROM (SELECT * FROM faulty ORDER BY _ord LIMIT 100)
    WHERE start_date IS NOT NULL OR end_date IS NOT NULL""")
def timeline(spark, sf):
    return profile.timeline(sheet(spark, sf, "faulty"), order=F.col(ORD))


# --- validation, anomalies, model input ------------------------------------------------

_ISSUES = ctes("faulty") + """,
    s AS (SELECT avg(total_value) AS m, stddev_samp(total_value) AS d, count(total_value) AS k FROM faulty),
    i(severity, type, field, n) AS (
        SELECT 'error', 'null_in_required', 'contract_id', count(*) FROM faulty WHERE contract_id IS NULL
        UNION ALL SELECT 'error', 'null_in_required', 'total_value', count(*) FROM faulty WHERE total_value IS NULL
        UNION ALL SELECT 'warning', 'invalid_numeric', 'unit_price', count(*) FROM faulty WHERE unit_price IS NOT NULL AND try_cast(unit_price AS DOUBLE) IS NULL
        UNION ALL SELECT 'error', 'end_before_start', NULL, count(*) FROM faulty WHERE end_date < start_date
        UNION ALL SELECT 'warning', 'zero_duration', NULL, count(*) FROM faulty WHERE end_date = start_date
        UNION ALL SELECT 'warning', 'negative_financial', 'total_value', count(*) FROM faulty WHERE total_value < 0
        UNION ALL SELECT 'warning', 'negative_financial', 'unit_price', count(*) FROM faulty WHERE try_cast(unit_price AS DOUBLE) < 0
        UNION ALL SELECT 'warning', 'outlier', 'total_value', count(*) FROM faulty, s WHERE k >= 10 AND d > 0 AND abs(total_value - m) > 3 * d
        UNION ALL SELECT 'warning', 'extreme_duration', NULL, count(*) FROM faulty WHERE term_months > 120
        UNION ALL SELECT 'info', 'future_date', 'close_date', count(*) FROM faulty WHERE close_date > DATE '2001-01-01'
        UNION ALL SELECT 'error', 'duplicate_contract_id', NULL, count(contract_id) - count(DISTINCT contract_id) FROM faulty)"""


@query("validate_rules", _ISSUES + " SELECT * FROM i WHERE n > 0")
def validate_rules(spark, sf):
    return checks.validate(sheet(spark, sf, "faulty"), as_of=as_of()).drop("message")


@query("validate_totals", ctes("lines", "faulty") + """,
    a AS (SELECT contract_id, coalesce(sum(total_value), 0) AS record_total FROM faulty WHERE contract_id IS NOT NULL GROUP BY 1),
    b AS (SELECT contract_id, coalesce(sum(total_value), 0) AS line_total FROM lines WHERE contract_id IS NOT NULL GROUP BY 1)
    SELECT 'error' AS severity, 'required_fields_missing' AS type, CAST(1 AS BIGINT) AS n, 'Missing required columns: [''end_date'']' AS message
    UNION ALL SELECT 'warning', 'aggregation_mismatch', count(*), CAST(count(*) AS STRING) || ' contracts have aggregated totals that don''t match line-item sums'
    FROM a LEFT JOIN b ON a.contract_id = b.contract_id WHERE abs(record_total - coalesce(line_total, 0)) > 0.01 HAVING count(*) > 0""")
def validate_totals(spark, sf):
    """A required column is absent, and record totals are held against line items."""
    issues = checks.validate(sheet(spark, sf, "faulty").drop("end_date"), line_items=sheet(spark, sf, "lines"), as_of=as_of())
    return issues.where("type IN ('required_fields_missing', 'aggregation_mismatch')").select("severity", "type", "n", "message")


@query("reconcile_totals", ctes("lines", "faulty") + f""",
    a AS (SELECT contract_id, coalesce(sum(total_value), 0) AS record_total FROM faulty WHERE contract_id IS NOT NULL GROUP BY 1),
    b AS (SELECT contract_id, coalesce(sum(total_value), 0) AS line_total FROM lines WHERE contract_id IS NOT NULL GROUP BY 1)
    SELECT a.contract_id, {half_even("record_total", 2)} AS record_total, {half_even("coalesce(line_total, 0)", 2)} AS line_total
    FROM a LEFT JOIN b ON a.contract_id = b.contract_id WHERE abs(record_total - coalesce(line_total, 0)) > 0.01""")
def reconcile_totals(spark, sf):
    out = checks.reconcile_totals(sheet(spark, sf, "faulty"), sheet(spark, sf, "lines"))
    return _rounded(out, record_total=2, line_total=2).drop("diff")


_FLAGS = """
    flagged AS (SELECT *, concat_ws(' | ', CASE WHEN ACV < 0 THEN 'negative_ACV' END, CASE WHEN Term_Months > 120 THEN 'long_term' END,
        CASE WHEN Expiry_Date < Effective_Date THEN 'date_mismatch' END,
        CASE WHEN abs(ACV - (SELECT avg(ACV) FROM suspect)) > 3 * (SELECT stddev_samp(ACV) FROM suspect) THEN 'outlier_ACV' END,
        CASE WHEN Contract_ID IS NULL THEN 'missing_Contract_ID' END, CASE WHEN trim(Vendor) = '' THEN 'missing_Vendor' END,
        CASE WHEN Account_ID IS NULL THEN 'missing_Account_ID' END,
        CASE WHEN Contract_Close_Date > DATE '2001-01-01' THEN 'future_close' END) AS _anomaly_flags FROM suspect)"""


@query("anomaly_flags", ctes("suspect") + "," + _FLAGS + """
    SELECT Contract_ID AS contract_id, Effective_Date AS effective_date, ACV AS acv, _anomaly_flags FROM flagged""")
def anomaly_flags(spark, sf):
    return checks.flag_anomalies(sheet(spark, sf, "suspect"), as_of()).select(
        F.col("Contract_ID").alias("contract_id"), F.col("Effective_Date").alias("effective_date"),
        F.col("ACV").alias("acv"), "_anomaly_flags")


@query("anomaly_summary", ctes("suspect") + "," + _FLAGS + """, f AS (SELECT unnest(string_split(_anomaly_flags, ' | ')) AS flag FROM flagged)
    SELECT t.type, CAST(count(*) AS BIGINT) AS n, t.severity FROM f JOIN (VALUES ('negative_ACV', 'Negative ACV', 'high'),
        ('long_term', 'Long Term (>10yr)', 'medium'), ('date_mismatch', 'Date Mismatch', 'high'), ('outlier_ACV', 'ACV Outlier', 'medium'),
        ('missing_Contract_ID', 'Missing Contract_ID', 'high'), ('missing_Vendor', 'Missing Vendor', 'medium'),
        ('missing_Account_ID', 'Missing Account_ID', 'high'), ('future_close', 'Far Future Close', 'low')) t(flag, type, severity) USING (flag)
    GROUP BY ALL
    UNION ALL SELECT 'Empty: Account_ID', count(*), 'low' FROM suspect WHERE Account_ID IS NULL
    UNION ALL SELECT 'Duplicate Contract IDs', CAST(sum(n) AS BIGINT), 'medium' FROM
        (SELECT count(*) AS n FROM suspect WHERE Contract_ID IS NOT NULL GROUP BY Contract_ID) WHERE n > 1""")
def anomaly_summary(spark, sf):
    return checks.anomaly_summary(sheet(spark, sf, "suspect"), as_of()).drop("description")


@query("empty_rows", ctes("gaps") + """
    SELECT Contract_ID AS contract_id, ACV AS acv, concat_ws(' | ',
        CASE WHEN ACV < 0 THEN 'negative_ACV' END,
        CASE WHEN abs(ACV - (SELECT avg(ACV) FROM gaps)) > 3 * (SELECT stddev_samp(ACV) FROM gaps) THEN 'outlier_ACV' END,
        CASE WHEN Contract_ID IS NULL THEN 'missing_Contract_ID' END,
        CASE WHEN Contract_ID IS NULL AND ACV IS NULL THEN 'empty_row' END) AS _anomaly_flags FROM gaps""")
def empty_rows(spark, sf):
    return checks.flag_anomalies(sheet(spark, sf, "gaps"), as_of()).select(
        F.col("Contract_ID").alias("contract_id"), F.col("ACV").alias("acv"), "_anomaly_flags")


@query("readiness", _ISSUES + """,
    v AS (SELECT count(*) AS n FROM faulty WHERE total_value IS NULL OR contract_id IS NULL)
    SELECT 'faulty' AS table_name, (SELECT n FROM v) = 0 AND (SELECT coalesce(sum(n), 0) FROM i WHERE severity = 'error') = 0 AS ready""")
def readiness(spark, sf):
    records = sheet(spark, sf, "faulty")
    ready = mlready.is_ready(records, checks.validate(records, as_of=as_of()))
    return spark.createDataFrame([("faulty", ready)], "table_name string, ready boolean")


@query("ml_violations", ctes("faulty") + """
    SELECT 'total_value' AS field, count(*) AS n FROM faulty WHERE total_value IS NULL
    UNION ALL SELECT 'contract_id', count(*) FROM faulty WHERE contract_id IS NULL""")
def ml_violations(spark, sf):
    return mlready.contract_violations(sheet(spark, sf, "faulty")).select("field", "n")


@query("ml_prepare", ctes("faulty") + """,
    ok AS (SELECT * FROM faulty WHERE total_value IS NOT NULL AND contract_id IS NOT NULL AND start_date IS NOT NULL AND end_date IS NOT NULL)
    SELECT contract_id, total_value, unit_price, start_date, end_date,
           coalesce(term_months, (SELECT median(term_months) FROM ok), 0) AS term_months, coalesce(quantity, 1) AS quantity, close_date FROM ok""")
def ml_prepare(spark, sf):
    return mlready.prepare_for_ml(sheet(spark, sf, "faulty"), check=False)


# --- headers, names, content -----------------------------------------------------------


@query("value_types", ctes("raw_text") + " , t AS (" + " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", trim("{c}") AS v FROM raw_text""" for c in ("Deal No", "Annual Cost", "Signed Date", "Auto Renew", "Notes")) + r"""),
    r AS (SELECT "column", count(*) AS k, count_if(regexp_matches(v, '\d{1,4}[/\-\.]\d{1,2}[/\-\.]\d{1,4}|[A-Za-z]{3,}\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]{3,}\s+\d{4}')) AS d,
               count_if(regexp_matches(v, '^[\s$£€¥₹]*[\d,.]+[kKmMbB]?\s*$')) AS m, count_if(regexp_matches(v, '^[A-Za-z0-9]{2,}[-_]?\d+')) AS i
          FROM t WHERE v <> '' GROUP BY 1)
    SELECT 'raw' AS sheet, "column", k AS non_blank, CASE WHEN d / k > 0.6 THEN 'date' WHEN m / k > 0.6 THEN 'currency' WHEN i / k > 0.6 THEN 'id' END AS value_type FROM r""")
def value_types(spark, sf):
    return suggest.value_types([Sheet("raw", sheet(spark, sf, "raw_text"))])


@query("header_suggest")
def header_suggest(spark, sf):
    sheets = [Sheet("raw", sheet(spark, sf, "raw_text"))]
    sheets += [Sheet(t, table(spark, sf, t)) for t in ("orders", "customer", "supplier", "part", "lineitem", "events")]
    return suggest.suggest_mappings(sheets)


@query("resolve_names")
def resolve_names(spark, sf):
    return entities.resolve_names(sheet(spark, sf, "names"), "vendor", F.col(ORD))


def _hash_sql(name: str, columns: list[str]) -> str:
    """(n_rows, content_hash) of a CTE."""
    cells_ = ", ".join(f"coalesce(CAST({c} AS STRING), chr(0))" for c in columns)
    lanes = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(x, {1 + 15 * i}, 15) AS BIGINT)), 0) AS STRING)" for i in range(4))
    return f"(SELECT count(*) AS n_rows, sha256(concat_ws('-', CAST(count(*) AS STRING), {lanes})) AS content_hash FROM (SELECT sha256(concat_ws(chr(31), {cells_})) AS x FROM {name}))"


_CODES = ["order_id", "part_number", "flag", "ship_date", "quantity"]
_CHANGED = ", changed AS (SELECT order_id, part_number, CASE WHEN order_id = (SELECT max(order_id) FROM line_codes) THEN 'changed' ELSE flag END AS flag, ship_date, quantity FROM line_codes)"


@query("fingerprint", ctes("line_codes") + "SELECT * FROM " + _hash_sql("line_codes", _CODES))
def fingerprint(spark, sf):
    return catalog.fingerprint(sheet(spark, sf, "line_codes"))


@query("reproducible", ctes("line_codes") + _CHANGED + f""",
    a AS (SELECT content_hash AS h FROM {_hash_sql("line_codes", _CODES)}), b AS (SELECT content_hash AS h FROM {_hash_sql("changed", _CODES)})
    SELECT 'codes' AS dataset_id, 'r1 r2' AS runs, true AS equal, a.h AS first_hash FROM a
    UNION ALL SELECT 'changed', 'r3 r4', a.h = b.h, a.h FROM a, b""")
def reproducible(spark, sf):
    """Runs with equal versions, from the log that their writes left: two equal ones, and two that differ in an order's flag."""
    root, codes = work_folder(spark, "runs"), sheet(spark, sf, "line_codes")
    last = codes.agg(F.max("order_id")).first()[0]
    changed = codes.withColumn("flag", F.when(F.col("order_id") == last, "changed").otherwise(F.col("flag")))
    for run, name, rows in (("r1", "codes", codes), ("r2", "codes", codes.repartition("part_number")), ("r3", "changed", codes), ("r4", "changed", changed)):
        sinks.write_run(rows, root, run, name, {"schema": "1", "mapping": "a"})
    log = sinks.read_run_log(spark, f"{root}/run_log")
    hashes = log.groupBy("dataset_id").agg(F.min_by("content_hash", "run_id").alias("first_hash"))
    return sinks.reproducible_runs(log).join(hashes, "dataset_id").select("dataset_id", F.array_join("runs", " ").alias("runs"), "equal", "first_hash")


@query("stored_catalog", ctes("order_text") + f""", h AS {_hash_sql("order_text", ["order_id", "customer_id", "status", "amount", "order_date"])}
    SELECT 'orders' AS sheet, h.n_rows AS row_count, 5 AS column_count, content_hash, c.column, c.non_null, {round_exact('c.non_null / h.n_rows * 100', 1)} AS pct
    FROM h, (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM order_text" for c in ("order_id", "customer_id", "status", "amount", "order_date")) + ") c")
def stored_catalog(spark, sf):
    """Catalog, fingerprint and completeness of a sheet stored by three appends, from the states those left."""
    root, orders = work_folder(spark, "states"), sheet(spark, sf, "order_text").select(*_ORDER_COLS)
    for n, part in enumerate((F.col("status") == "F", F.col("status") == "O", F.coalesce(~F.col("status").isin("F", "O"), F.lit(True)))):
        states.append_sheet(Sheet("orders", orders.where(part)), root, n)
    known = states.stored_catalog(spark, root).select("sheet", "row_count", "column_count", "content_hash")
    return known.join(states.stored_completeness(spark, root).select("sheet", "column", "non_null", "pct"), "sheet")


@query("sheet_catalog", """
    SELECT 'orders' AS sheet, count(*) AS row_count, 5 AS column_count, 'order_id; customer_id; status; amount; order_date' AS columns FROM orders
    UNION ALL SELECT 'customers', count(*), 4, 'customer_id; name; nation_id; segment' FROM customer
    UNION ALL SELECT 'nations', count(*), 3, 'nation_id; name; region_id' FROM nation
    UNION ALL SELECT 'regions', count(*), 2, 'region_id; name' FROM region""")
def sheet_catalog(spark, sf):
    return catalog.catalog(_text_sheets(spark, sf)).select(
        "sheet", "row_count", "column_count", F.array_join("columns", "; ").alias("columns"))


@query("csv_roundtrip", ctes("order_text") + """
    SELECT order_id, customer_id, nullif(status, '') AS status, amount, order_date FROM order_text""")
def csv_roundtrip(spark, sf):
    path = work_folder(spark, "csv")
    sinks.export_csv(sheet(spark, sf, "order_text").select(*_ORDER_COLS), path, ordered=False)
    return tables.read_csv(spark, path).drop(ORD)


def _folder(spark, sf) -> str:
    """CSV files of one table each: two data sheets, one with empty rows, and a pivot-like and an empty one."""
    root = work_folder(spark, "folder")
    orders = sheet(spark, sf, "order_text").select(*_ORDER_COLS)
    files = {"orders": orders, "gaps": sheet(spark, sf, "gaps").drop(ORD).select("Contract_ID", F.col("ACV").cast("string").alias("ACV")),
             "pivot": orders.select(F.col("order_id").alias("total"), *[F.col("status").alias(f"_c{i}") for i in (1, 2, 3)]),
             "nothing": orders.select(F.lit("N/A").alias("a"), F.lit("null").alias("b"))}
    for name, df in files.items():
        df.write.options(**sinks.CSV_OPTIONS).csv(f"{root}/{name}.csv")
    return root


@query("folder_report", """SELECT 'gaps' AS sheet, true AS kept, '' AS reason UNION ALL SELECT 'orders', true, ''
    UNION ALL SELECT 'pivot', false, 'looks like a pivot table' UNION ALL SELECT 'nothing', false, 'empty'""")
def folder_report(spark, sf):
    """Which sheets of a folder are data, and why the others are not."""
    root = _folder(spark, sf)
    return tables.sheet_report([Sheet(n, tables.read_csv(spark, f"{root}/{n}.csv")) for n in ("orders", "gaps", "pivot", "nothing")])


@query("folder_rows", ctes("order_text", "gaps") + """
    SELECT 'orders' AS sheet, order_id AS id, nullif(status, '') AS value FROM order_text
    UNION ALL SELECT 'gaps', "Contract_ID", CAST("ACV" AS STRING) FROM gaps WHERE "Contract_ID" IS NOT NULL OR "ACV" IS NOT NULL""".replace('CAST("ACV" AS STRING)', 'NULL'))
def folder_rows(spark, sf):
    """Rows of a folder's data sheets, without empty ones."""
    root = _folder(spark, sf)
    kept = tables.keep_data_sheets([Sheet(n, tables.read_csv(spark, f"{root}/{n}.csv")) for n in ("orders", "gaps", "pivot", "nothing")])
    frames = {s.name: s.df for s in kept}
    orders = frames["orders"].select(F.lit("orders").alias("sheet"), F.col("order_id").alias("id"), F.col("status").alias("value"))
    return orders.unionByName(frames["gaps"].select(F.lit("gaps").alias("sheet"), F.col("Contract_ID").alias("id"), F.lit(None).cast("string").alias("value")))


@query("csv_ordered", ctes("crm_unique") + """
    SELECT row_number() OVER (ORDER BY account_id NULLS LAST, close_date NULLS LAST) AS position, account_id, close_date, nullif(stage, '') AS stage FROM crm_unique""")
def csv_ordered(spark, sf):
    """The exported master in key order, read back with the rows' places in its files."""
    path = work_folder(spark, "ordered")
    sinks.export_csv(sheet(spark, sf, "crm_unique").select("account_id", "close_date", "stage"), path)
    back = tables.read_csv(spark, path)
    return tables.with_place(back).select("position", "account_id", "close_date", "stage")


@query("raw_snapshot", ctes("order_text", "customer_text") + f""", a AS {_hash_sql("order_text", _ORDER_COLS)}, b AS {_hash_sql("customer_text", ["customer_id", "name", "nation_id", "segment"])}
    SELECT 'orders' AS sheet, n_rows AS stored, n_rows AS row_count, content_hash FROM a UNION ALL SELECT 'customers', n_rows, n_rows, content_hash FROM b""")
def raw_snapshot(spark, sf):
    """Sheets and catalog as stored, the rows counted again from the files."""
    root = work_folder(spark, "raw")
    sheets = [s for s in _text_sheets(spark, sf) if s.name in ("orders", "customers")]
    sinks.write_raw(sheets, root)
    counts = merge.concat_sheets([spark.read.parquet(f"{root}/raw/{s.name}").agg(F.count(F.lit(1)).alias("stored")).withColumn("sheet", F.lit(s.name)) for s in sheets])
    return spark.read.parquet(f"{root}/catalog").join(counts, "sheet").select("sheet", "stored", "row_count", "content_hash")


@query("canonical_sink", ctes("lines") + "," + _ROLLUP_SQL + f"""
    SELECT contract_id, {half_even("total_value", 2)} AS total_value, line_item_count, (SELECT count(*) FROM records) AS contract_count,
           (SELECT count(*) FROM lines) AS line_items FROM records""")
def canonical_sink(spark, sf):
    """Contracts and line items as stored, with the counts of the metadata."""
    root = work_folder(spark, "canonical")
    lines = sheet(spark, sf, "lines")
    rolled, items = rollup.rollup_sheets({"lines": lines}, levels={"lines": "line_item_level"})
    sinks.write_canonical(rolled["lines"], items, root, "deals", {"schema": "1"})
    meta = spark.read.json(f"{root}/output_metadata").first()
    return _rounded(spark.read.parquet(f"{root}/contracts"), total_value=2).select(
        "contract_id", "total_value", "line_item_count", F.lit(meta["contract_count"]).cast("bigint").alias("contract_count"),
        F.lit(spark.read.parquet(f"{root}/line_items").count()).cast("bigint").alias("line_items"))


@query("issue_sink", ORACLE["validate_rules"])
def issue_sink(spark, sf):
    """Validation issues as stored."""
    path = work_folder(spark, "issues")
    sinks.write_report(checks.validate(sheet(spark, sf, "faulty"), as_of=as_of()), path)
    return spark.read.schema(checks.ISSUE_SCHEMA).json(path).drop("message")


@query("profile_sink", ORACLE["profile_columns"])
def profile_sink(spark, sf):
    """The column profile as stored."""
    path, found = work_folder(spark, "profile"), profile.profile_columns(sheet(spark, sf, "order_text"))
    sinks.write_report(found, path)
    return spark.read.schema(found.schema).json(path)


@query("chosen_sheets", ctes("crm", "usage") + """
    SELECT account_id, close_date, 'crm' AS sheet FROM crm UNION ALL SELECT account_id, close_date, 'usage' FROM usage""")
def chosen_sheets(spark, sf):
    """Two of three sheets by name, their key columns found by their headers; a sheet without a key is skipped."""
    raw = [Sheet("crm", sheet(spark, sf, "crm").withColumnsRenamed({"account_id": "Account ID", "close_date": "Date of close"})),
           Sheet("usage", sheet(spark, sf, "usage").withColumnsRenamed({"account_id": "Account ID", "close_date": "Date of close"})),
           Sheet("nations", sheet(spark, sf, "nation_text")), Sheet("billing", sheet(spark, sf, "billing"))]
    chosen = mapping.select_sheets(raw, ["crm", "usage", "nations"])
    found = {c: t for s in chosen for c, t in mapping.detect_key_columns(s.data_columns).items()}
    mapped = mapping.map_sheets(chosen, found)
    return merge.concat_sheets([s.df.select(*KEYS, F.lit(s.name).alias("sheet")) for s in mapped])


@query("header_repair", """
    SELECT CAST(o_orderkey AS STRING) AS "Vendor", o_orderpriority AS "Vendor_1", o_orderstatus AS "Vendor_2", CAST(o_custkey AS STRING) AS "Client" FROM orders""")
def header_repair(spark, sf):
    """Composite headers cut to their last part, and columns of one target told apart by suffixes."""
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Supplier"), F.col("o_orderpriority").alias("Vendor Name"), F.col("o_orderstatus").alias("Seller"),
        F.col("o_custkey").cast("string").alias("Account : Name : Client"))
    df = mapping.split_composite_headers(raw)
    names = mapping.suffix_duplicates({"Supplier": "Vendor", "Vendor Name": "Vendor", "Seller": "Vendor", "Client": "Client"})
    return df.withColumnsRenamed(names)


@query("stacked_without_key", ctes("order_text", "region_text") + """
    SELECT order_id, customer_id, status, amount, order_date, NULL AS region_id, NULL AS name FROM order_text
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, region_id, name FROM region_text""")
def stacked_without_key(spark, sf):
    """Sheets that share no key are stacked under the base."""
    return merge.join_entities({"orders": sheet(spark, sf, "order_text").select(*_ORDER_COLS), "regions": sheet(spark, sf, "region_text")}, primary="orders")


@query("line_items", ctes("lines", "faulty") + """
    SELECT 'lines' AS sheet, contract_id, total_value FROM lines UNION ALL SELECT 'faulty', contract_id, total_value FROM faulty""")
def line_items(spark, sf):
    """Rows of all rolled-up sheets before the rollup; a record-level sheet adds none."""
    frames = {n: sheet(spark, sf, n).withColumn("sheet", F.lit(n)) for n in ("lines", "faulty")}
    frames["records"] = sheet(spark, sf, "order_text").select(F.col("order_id").alias("contract_id"))
    _, items = rollup.rollup_sheets(frames, levels={"lines": "line_item_level", "faulty": "mixed", "records": "contract_level"})
    return items.select("sheet", "contract_id", "total_value")


@query("date_range_columns", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS "Effective_Date",
           CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderdate AS DATE) + 30 END AS "Expiry_Date" FROM orders""")
def date_range_columns(spark, sf):
    """A column of date ranges becomes two date columns; a single date has no end, 'N/A' neither."""
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 5 == 0, "N/A").when(F.col("o_orderkey") % 5 == 1, day.cast("string")).otherwise(
        F.concat(day.cast("string"), F.lit(" to "), F.date_add(day, 30).cast("string")))
    return clean.split_date_range_columns(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("Contract Date Range")))


@query("master_snapshots", ctes("crm", "usage") + _full("crm", "usage", "l.deal_value, l.stage, r.usage"))
def master_snapshots(spark, sf):
    root = work_folder(spark, "master")
    sinks.write_master(sheet(spark, sf, "crm"), root, 0)
    grown = merge.append_to_master(sinks.read_master(spark, root, 0), sheet(spark, sf, "usage"), on_conflict="keep_left", plan="pad")
    sinks.write_master(grown, root, 1)
    return sinks.read_master(spark, root, 1)


@query("layered_run", ctes("lines") + "," + _ROLLUP_SQL + f"""
    SELECT contract_id, account_id, {half_even("total_value", 2)} AS total_value, start_date, end_date, term_months, renewal_date,
           line_item_count, c_mktsegment AS account_segment FROM records LEFT JOIN customer ON account_id = 'ACC-' || CAST(c_custkey AS STRING)""")
def layered_run(spark, sf):
    lines = sheet(spark, sf, "lines")
    clients = table(spark, sf, "customer").select(
        F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("Customer Id"), F.col("c_mktsegment").alias("Segment"))
    own = ["contract_id", "account_id", "total_value", "start_date", "end_date", "term_months", "renewal_date"]
    config = mapping.MappingConfig([(c, "lines", c) for c in own]
                                   + [("account_id", "clients", "Customer Id"), ("account_segment", "clients", "Segment")])
    result = consolidate.run_layers([Sheet("lines", lines), Sheet("clients", clients)], config, as_of=as_of(), primary="lines")
    return _rounded(result.contracts, total_value=2).select(*own, "line_item_count", "account_segment")


@query("audit_run", ctes("lines") + "," + _ROLLUP_SQL + """
    , c AS (SELECT count(*) AS n FROM records)
    SELECT 'dataset_id' AS metric, 'deals' AS value
    UNION ALL SELECT 'rows_ingested', CAST((SELECT count(*) FROM lines) + (SELECT count(*) FROM customer) AS STRING)
    UNION ALL SELECT 'tabs_processed', '2'
    UNION ALL SELECT 'final_rows', CAST((SELECT n FROM c) AS STRING)
    UNION ALL SELECT 'line_items_merged', CAST((SELECT count(*) FROM lines) - (SELECT n FROM c) AS STRING)
    UNION ALL SELECT 'unique_vendors', '0' UNION ALL SELECT 'mapping_version', 'v3' UNION ALL SELECT 'schema_version', 'v1'""")
def audit_run(spark, sf):
    lines = sheet(spark, sf, "lines")
    clients = table(spark, sf, "customer").select(
        F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("Customer Id"), F.col("c_mktsegment").alias("Segment"))
    own = ["contract_id", "account_id", "total_value", "start_date", "end_date", "term_months"]
    config = mapping.MappingConfig([(c, "lines", c) for c in own] + [("account_id", "clients", "Customer Id"), ("account_segment", "clients", "Segment")], "v3")
    sheets = [Sheet("lines", lines), Sheet("clients", clients)]
    result = consolidate.run_layers(sheets, config, as_of=as_of(), primary="lines")
    return audit.audit_run(sheets, result, "deals")


@query("cleaner_chain", f"""WITH c AS (
    SELECT CAST(o_orderkey AS STRING) AS "Contract_ID", {_MONEY} AS "ACV", {_DATE} AS "Contract_Close_Date", {_BOOL} AS "Auto_Renew",
           CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 THEN o_orderpriority END AS "Vendor", 'raw' AS meta_source_tab,
           'raw' AS meta_source_file, CAST(o_orderkey % 6 = 4 AS BIGINT) AS is_auto_renew, o_orderkey FROM orders),
    v AS (SELECT "Vendor", CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS STRING) AS "Vendor_Cluster_ID" FROM c WHERE "Vendor" IS NOT NULL GROUP BY 1)
    SELECT c.* EXCLUDE (o_orderkey) REPLACE (CASE WHEN "Contract_Close_Date" IS NULL THEN "ACV" ELSE coalesce("ACV", 0) END AS "ACV"),
           CASE WHEN "Contract_Close_Date" IS NULL THEN c."Vendor" ELSE coalesce(c."Vendor", '') END AS "Vendor_Canonical",
           CASE WHEN "Contract_Close_Date" IS NULL THEN "Vendor_Cluster_ID" ELSE coalesce("Vendor_Cluster_ID", '') END AS "Vendor_Cluster_ID"
    FROM c LEFT JOIN v ON c."Vendor" = v."Vendor" """)
def cleaner_chain(spark, sf):
    raw = sheet(spark, sf, "raw_text")
    headers = {"raw": {"Deal No": "Contract_ID", "Annual Cost": "ACV", "Signed Date": "Contract_Close_Date",
                       "Auto Renew": "Auto_Renew", "Notes": "Vendor"}}
    return consolidate.clean_chain([Sheet("raw", raw)], headers, subset=["Contract_ID", "Contract_Close_Date", "ACV"])
