"""Messy sheets derived from the given tables, as SQL both Spark and DuckDB read.

The given tables are clean, so faults are planted by CASE expressions on the keys. Every
sheet keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_ORD = ("CAST(l_linenumber AS BIGINT) * 100000000000000000 + l_partkey * 10000000 + l_suppkey")
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) * 3 - 2 AS INTEGER), 3)"
_MDY = ("CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || "
        "CAST(year(o_orderdate) AS STRING)")
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_DOLLARS = f"CAST(floor({_CENTS} / 100) AS BIGINT)"
_THOUSANDS = f"CAST(floor({_CENTS} / 100000) AS BIGINT)"
_PLAIN = f"CAST({_DOLLARS} AS STRING) || '.' || lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')"
_GROUPED = (f"CASE WHEN {_THOUSANDS} > 0 THEN CAST({_THOUSANDS} AS STRING) || ',' || "
            f"lpad(CAST({_DOLLARS} % 1000 AS STRING), 3, '0') ELSE CAST({_DOLLARS} AS STRING) END || '.' || "
            f"lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')")

SQL: dict[str, str] = {
    # account_id + close_date sheets -------------------------------------------------
    "crm": f"""
        SELECT CASE WHEN o_orderkey % 193 = 0 THEN NULL ELSE 'ACC-' || CAST(o_custkey AS STRING) END AS account_id,
               CASE WHEN o_orderkey % 193 = 0 OR o_orderkey % 97 = 0 THEN NULL ELSE {_DAY} END AS close_date,
               o_totalprice AS deal_value, o_orderstatus AS stage
        FROM {{orders}}""",
    "billing": f"""
        SELECT CASE WHEN o_orderkey % 193 = 0 THEN NULL
                    WHEN o_orderkey % 4 = 0 THEN 'BIL-' || CAST(o_custkey AS STRING)
                    ELSE 'ACC-' || CAST(o_custkey AS STRING) END AS account_id,
               CASE WHEN o_orderkey % 193 = 0 OR o_orderkey % 97 = 0 THEN NULL ELSE {_DAY} END AS close_date,
               o_orderpriority AS priority,
               CASE WHEN o_orderkey % 50 = 1 THEN 'X' WHEN o_orderkey % 9 = 0 THEN NULL
                    ELSE ' ' || o_orderstatus || ' ' END AS stage
        FROM {{orders}}""",
    "usage": f"""
        SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'NEW-' || CAST(o_custkey AS STRING)
                    ELSE 'ACC-' || CAST(o_custkey AS STRING) END AS account_id,
               {_DAY} AS close_date, o_totalprice / 10 AS usage
        FROM {{orders}}""",
    "shipments": f"""
        SELECT 'ACC-' || CAST(o_custkey AS STRING) AS account_id, {_DAY} AS close_date,
               sum(l_quantity) AS shipped, max(l_returnflag) AS stage
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "crm_unique": f"""
        SELECT 'ACC-' || CAST(o_custkey AS STRING) AS account_id, {_DAY} AS close_date,
               min_by(o_totalprice, o_orderkey) AS deal_value,
               max(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END) AS stage
        FROM {{orders}} GROUP BY 1, 2""",
    "billing_unique": f"""
        SELECT CASE WHEN o_custkey % 4 = 0 THEN 'BIL-' ELSE 'ACC-' END || CAST(o_custkey AS STRING) AS account_id,
               {_DAY} AS close_date, max(o_orderpriority) AS priority, max(' ' || o_orderstatus) AS stage
        FROM {{orders}} GROUP BY 1, 2""",
    # line items and records ---------------------------------------------------------
    "lines": f"""
        SELECT CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 'C-' || CAST(l_orderkey AS STRING) END AS contract_id,
               'ACC-' || CAST(o_custkey AS STRING) AS account_id,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS total_value,
               l_quantity AS quantity,
               CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS discount,
               CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + 30 * l_linenumber AS end_date,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 400 END AS renewal_date,
               CAST(12 * l_linenumber AS DOUBLE) AS term_months,
               CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END AS auto_renew,
               p_name AS product, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE s_name END AS vendor,
               l_tax AS tax, {_ORD} AS _ord
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
             JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "quotes": f"""
        SELECT 'C-' || CAST(l_orderkey AS STRING) AS quote_id,
               CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS booking_date,
               l_extendedprice AS amount, l_returnflag AS flag, CAST(l_suppkey AS STRING) AS meta_source_tab,
               {_ORD} AS _ord
        FROM {{lineitem}}""",
    "faulty": f"""
        SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 1 THEN 'C-' || CAST(o_orderkey - 1 AS STRING)
                    ELSE 'C-' || CAST(o_orderkey AS STRING) END AS contract_id,
               CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN -o_totalprice
                    WHEN o_orderkey % 997 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS total_value,
               CASE WHEN o_orderkey % 59 = 0 THEN '12x' WHEN o_orderkey % 61 = 0 THEN '-5.5'
                    ELSE {_PLAIN} END AS unit_price,
               CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN o_orderkey % 43 = 0 THEN CAST(o_orderdate AS DATE)
                    WHEN o_orderkey % 47 = 0 THEN CAST(o_orderdate AS DATE) - 10
                    ELSE CAST(o_orderdate AS DATE) + 365 END AS end_date,
               CAST(CASE WHEN o_orderkey % 71 = 0 THEN 240 WHEN o_orderkey % 7 = 0 THEN NULL ELSE 12 END AS DOUBLE) AS term_months,
               CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 9 END AS DOUBLE) AS quantity,
               CAST(o_orderdate AS DATE) AS close_date, o_orderkey AS _ord
        FROM {{orders}}""",
    "suspect": f"""
        SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 1 THEN 'C-' || CAST(o_orderkey - 1 AS STRING)
                    ELSE 'C-' || CAST(o_orderkey AS STRING) END AS Contract_ID,
               CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE o_orderpriority END AS Vendor,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ACC-' || CAST(o_custkey AS STRING) END AS Account_ID,
               CASE WHEN o_orderkey % 41 = 0 THEN -o_totalprice WHEN o_orderkey % 997 = 0 THEN o_totalprice * 1000
                    ELSE o_totalprice END AS ACV,
               CAST(CASE WHEN o_orderkey % 71 = 0 THEN 240 ELSE 12 END AS INTEGER) AS Term_Months,
               CAST(o_orderdate AS DATE) AS Effective_Date,
               CASE WHEN o_orderkey % 47 = 0 THEN CAST(o_orderdate AS DATE) - 10 ELSE CAST(o_orderdate AS DATE) + 365 END AS Expiry_Date,
               CAST(o_orderdate AS DATE) AS Contract_Close_Date
        FROM {{orders}}""",
    "gaps": """
        SELECT CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'C-' || CAST(o_orderkey AS STRING) END AS Contract_ID,
               CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS ACV, o_orderkey AS _ord
        FROM {orders}""",
    # raw text -------------------------------------------------------------------------
    "raw_text": f"""
        SELECT o_orderkey AS _ord, CAST(o_orderkey AS STRING) AS "Deal No",
               CASE o_orderkey % 5 WHEN 0 THEN '$' || {_GROUPED}
                    WHEN 1 THEN CAST(CAST(floor({_CENTS} / 100000) AS BIGINT) AS STRING) || '.' || CAST(CAST(floor({_CENTS} / 10000) AS BIGINT) % 10 AS STRING) || 'k'
                    WHEN 2 THEN 'N/A' WHEN 3 THEN '#REF!' ELSE ' ' || {_PLAIN} END AS "Annual Cost",
               CASE o_orderkey % 6 WHEN 0 THEN {_MDY} WHEN 1 THEN {_DAY}
                    WHEN 2 THEN {_MON} || ' ' || CAST(day(o_orderdate) AS STRING) || ', ' || CAST(year(o_orderdate) AS STRING)
                    WHEN 3 THEN CAST(day(o_orderdate) AS STRING) || ' ' || {_MON} || ' ' || CAST(year(o_orderdate) AS STRING)
                    WHEN 4 THEN 'Auto-renew' ELSE {_MDY} || ' to ' || {_MDY} END AS "Signed Date",
               CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'X' WHEN 3 THEN 'checked'
                    WHEN 4 THEN '' WHEN 5 THEN 'FALSE' ELSE NULL END AS "Auto Renew",
               CASE WHEN o_orderkey % 17 = 0 THEN '#N/A' WHEN o_orderkey % 19 = 0 THEN ' #div/0! ' ELSE o_orderpriority END AS "Notes"
        FROM {{orders}}""",
    "names": """
        SELECT p_partkey AS _ord,
               CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
                    WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE p_name || ' ' END AS vendor
        FROM {part}""",
    "doc_rows": """
        SELECT trim(text) AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang,
               CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS source, doc_id AS _ord
        FROM {documents}""",
    "order_text": f"""
        SELECT CAST(o_orderkey AS STRING) AS order_id, CAST(o_custkey AS STRING) AS customer_id,
               CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
               {_PLAIN} AS amount, {_DAY} AS order_date, o_orderkey AS _ord
        FROM {{orders}}""",
    "customer_text": """
        SELECT CAST(c_custkey AS STRING) AS customer_id, c_name AS name, CAST(c_nationkey AS STRING) AS nation_id,
               c_mktsegment AS segment FROM {customer}""",
    "nation_text": """
        SELECT CAST(n_nationkey AS STRING) AS nation_id, n_name AS name, CAST(n_regionkey AS STRING) AS region_id FROM {nation}""",
    "region_text": "SELECT CAST(r_regionkey AS STRING) AS region_id, r_name AS name FROM {region}",
    "line_codes": """
        SELECT CAST(l_orderkey AS STRING) AS order_id, CAST(l_partkey AS STRING) AS part_number,
               l_returnflag AS flag, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_quantity AS INTEGER) AS quantity
        FROM {lineitem}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived sheet as a lazy DataFrame."""
    text = SQL[name].replace('"', "`")
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(name: str) -> str:
    """The same sheet for DuckDB, over its registered views."""
    text = SQL[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def ctes(*names: str) -> str:
    """'WITH a AS (...), b AS (...)' for the oracle texts."""
    return "WITH " + ", ".join(f"{n} AS ({duck(n)})" for n in names)
