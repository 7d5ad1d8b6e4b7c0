import random

import pytest
from pyspark.sql import functions as F

from keyfold.functions import similarity as S
from keyfold.model import ORD, Sheet
from keyfold.operators import entities, mapping, suggest
from keyfold.schema import CanonicalSchema


def test_mapping_keeps_only_targets(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "`Acct ID` string, b string, c string, d string")
    out = mapping.apply_mapping(df, {"c": " z ", "Acct ID": "account_id", "b": "", "d": None, "gone": "x"})
    assert out.columns == ["account_id", "z"] and tuple(out.first()) == ("1", "3")
    with pytest.raises(ValueError, match="account_id"):
        mapping.apply_mapping(df, {"b": "account_id", "c": "account_id"})


def test_sheets_are_narrowed_and_keyless_ones_skipped(spark):
    a = Sheet("a", spark.createDataFrame([("1", "d", "x")], "acc string, day string, v string"))
    b = Sheet("b", spark.createDataFrame([("y",)], "v string"))
    out = mapping.map_sheets([a, b], {"acc": "account_id", "day": "close_date", "v": "v"})
    assert [s.name for s in out] == ["a"]
    with pytest.raises(ValueError, match="close_date"):
        mapping.map_sheets([a], {"acc": "account_id"})
    with pytest.raises(ValueError):
        mapping.select_sheets([a], ["zz"])
    assert [s.name for s in mapping.select_sheets([a, b], None)] == ["a", "b"]


def test_key_columns_are_guessed():
    got = mapping.detect_key_columns(["Account ID", "Close_Date", "Account Ident", "Stage"])
    assert got == {"Account ID": "account_id", "Close_Date": "close_date", "Account Ident": "Account Ident", "Stage": "Stage"}


def test_duplicate_targets_get_suffixes():
    assert mapping.suffix_duplicates({"a": "X", "b": "X", "c": "Y", "d": "X"}) == {"a": "X", "b": "X_1", "c": "Y", "d": "X_2"}


def test_composite_headers_are_cut(spark):
    df = spark.createDataFrame([("1", "2", "3")], "`Opp : Name : Account ID` string, `x : Stage` string, Stage string")
    out = mapping.split_composite_headers(df)
    assert out.columns == ["Stage", "Account ID"] and tuple(out.first()) == ("3", "1")


def test_mapping_config():
    config = mapping.MappingConfig([("contract_id", "s1", "A"), ("contract_id", "s2", "B"), ("acv", "s1", "C")])
    assert config.for_sheet("s1") == {"contract_id": "A", "acv": "C"}
    assert config.primary()["contract_id"] == ("s1", "A")
    assert config.unmapped_required() == ["total_value", "start_date", "end_date"] and not config.complete
    assert "contract_id" not in config.without("contract_id").primary()


def test_typed_extraction(spark):
    df = spark.createDataFrame([("C1 ", "$5k", "Jan 2, 2024", "yes", "#REF!"), (" ", "x", "evergreen", "?", "n")],
                               "id string, v string, d string, r string, t string")
    columns = {"contract_id": "id", "total_value": "v", "start_date": "d", "auto_renew": "r", "notes": "t", "acv": "none"}
    sheet = Sheet("s", df.coalesce(1).withColumn(ORD, F.monotonically_increasing_id()))
    got = mapping.extract_sheet(sheet, columns, CanonicalSchema.default()).orderBy("_source_row_idx").collect()
    first = got[0].asDict()
    assert (first["contract_id"], first["total_value"], str(first["start_date"]), first["auto_renew"], first["notes"], first["acv"]) == (
        "C1", 5000.0, "2024-01-02", True, None, None)
    assert (got[1]["contract_id"], got[1]["total_value"], got[1]["start_date"], got[1]["auto_renew"]) == (None, None, None, None)
    assert len({r["row_lineage_id"] for r in got}) == 2 and first["_source_sheet_id"] == "s"


def test_output_order_hides_internal_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "zz int, contract_id int, _x int, account_id int")
    assert mapping.canonical_order(df).columns == ["account_id", "contract_id", "zz"]


def test_schema_views_and_alias_rule():
    schema = CanonicalSchema.default()
    assert len(schema.fields) == 37
    assert schema.names(required=True) == ["contract_id", "total_value", "start_date", "end_date"]
    assert schema.names(level="line_item", category="descriptive") == ["product", "product_family", "description"]
    assert schema.names(type="boolean") == ["auto_renew"]
    for header, name in {"Contract #": "contract_id", "account_ref": "account_id", "Close Date": "close_date", "vendor_name": "vendor",
                         "contract_value": "acv", "Deal Value": "total_value", "company_name": "account_name", "stage": "stage",
                         "memo": "description", "term (months)": "term_months", "startdate": "start_date", "Sales Rep": "owner",
                         "Opportunity : Account Name : Account ID": "account_name", "auto-renew": "auto_renew"}.items():
        assert schema.lookup(header) == name, header
    assert schema.lookup("totally_random_xyz") is None
    own = CanonicalSchema.from_dict({"version": "v7", "fields": {"a": {"type": "string", "aliases": ["X", "y"]}, "b": {"type": "date", "aliases": ["x"]}}})
    assert own.lookup("x") == "b" and own.version == "v7" and own.struct_type()["b"].dataType.typeName() == "date"


def test_suggestions(spark):
    df = spark.createDataFrame([("C-1001", "5,000", "2024-01-01", "q", "$12", "2024-05-05", "9"), ("C-1002", "7", "2024-02-01", "r", "$5", "2024-05-06", "8")],
                               "`Contract ID` string, `Anual Cost` string, beginning string, `totally_random_xyz` string, paid string, `paid at start` string, worth string")
    got = {r["raw"]: (r["canonical"], r["score"], r["method"]) for r in suggest.suggest_mappings([Sheet("s", df)]).collect()}
    assert got["Contract ID"] == ("contract_id", 100, "exact_alias")
    assert got["Anual Cost"][0] == "acv" and got["Anual Cost"][2] == "fuzzy" and 80 <= got["Anual Cost"][1] < 100
    assert got["beginning"] == ("start_date", 70, "content_detection")
    assert got["paid at start"] == (None, None, None)      # start_date went to the first such column
    assert got["paid"] == (None, None, None)               # acv is named by another header
    assert got["totally_random_xyz"] == (None, None, None)
    config = suggest.accept_suggestions(suggest.suggest_mappings([Sheet("s", df)]))
    assert config.for_sheet("s")["start_date"] == "beginning"


@pytest.mark.parametrize("header, alias, canonical, score, ok", [
    ("quote line arr", "quote line id", "contract_id", 88, False), ("deal id", "deal value", "total_value", 95, False),
    ("total id", "total value", "total_value", 95, True), ("xx yy", "zz yy", "owner", 85, False), ("sales rep x", "sales rep", "owner", 85, True)])
def test_veto(spark, header, alias, canonical, score, ok):
    df = spark.createDataFrame([(header, alias, canonical, float(score))], "h string, a string, c string, s double")
    assert df.select(suggest.sensible(F.col("h"), F.col("a"), F.col("c"), F.col("s"))).first()[0] is ok


def sequential_clusters(names, threshold):
    """The rule in its plainest form: first-seen order, compare with the cluster's seed."""
    assigned, clusters = {}, 0
    for i, name in enumerate(names):
        if name in assigned:
            continue
        assigned[name] = clusters
        for other in names[i + 1:]:
            if other not in assigned and S.name_score(S.expand(name), S.expand(other)) >= threshold:
                assigned[other] = clusters
        clusters += 1
    return assigned


@pytest.mark.parametrize("block", [7, 1000])
def test_clusters_equal_the_sequential_rule(spark, block):
    rng = random.Random(3)
    parts = ["amazon", "web", "services", "google", "cloud", "aws", "micro", "soft", "data", "sys", "inc", "gcp"]
    seen = list(dict.fromkeys(" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(90)))
    seen += ["AWS", "GCP", "amazn web servces"]
    rows = [(i, n) for i, n in enumerate(seen)] + [(1000 + i, rng.choice(seen)) for i in range(150)]
    df = spark.createDataFrame(rows, f"{ORD} long, vendor string").repartition(5)
    out = entities.resolve_names(df, "vendor", F.col(ORD), 85, block=block)
    expected = sequential_clusters(seen, 85)
    assert {r["vendor"]: r["vendor_cluster_id"] for r in out.collect()} == expected
    counts = {n: sum(1 for _, x in rows if x == n) for n in seen}
    best = {c: max((n for n in seen if expected[n] == c), key=lambda n: (counts[n], -seen.index(n))) for c in set(expected.values())}
    assert all(r["vendor_canonical"] == best[r["vendor_cluster_id"]] for r in out.collect())


def test_known_vendors_and_missing_names(spark):
    names = ["AWS", "Amazon Web Services", "Google Cloud", "GCP", None, " "]
    df = spark.createDataFrame(list(enumerate(names)), f"{ORD} long, vendor string")
    got = {r["vendor"]: r["vendor_cluster_id"] for r in entities.resolve_names(df, "vendor", F.col(ORD), 70).collect()}
    assert got["AWS"] == got["Amazon Web Services"] and got["Google Cloud"] == got["GCP"] and got["AWS"] != got["GCP"]
    assert got[None] is None and got[" "] is None
    absent = entities.resolve_names(df, "supplier", F.col(ORD)).first()
    assert absent["vendor_canonical"] is None


def test_names_with_tied_positions_all_get_a_cluster(spark):
    from keyfold.operators.entities import cluster_names

    names = spark.createDataFrame([(f"{c * 6}{i}", 1, 5) for i, c in enumerate("qwertzu")], "name string, n bigint, first_ord bigint")
    got = cluster_names(names, block=3).collect()
    assert sorted(r["name"] for r in got) == sorted(r["name"] for r in names.collect())
    assert all(r["cluster_id"] is not None for r in got)
