import zipfile

import pytest
from pyspark.sql import functions as F

from keyfold.model import ORD, Sheet
from keyfold.operators import checks, suggest
from keyfold.operators.mapping import MappingConfig
from keyfold.plans import audit, consolidate
from keyfold.sources import catalog, master, sinks, tables, workbooks
from keyfold.streaming.append import append_stream


def test_csv_reading(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_bytes(
        '﻿ id ,name,,note\n1,"two\nlines",x,NA\n2,"say ""hi""",,n/a\n,,,\n3,null,,"plain, comma"\n'.encode())
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), multiline=True)
    assert [c for c in df.columns if c != ORD] == ["id", "name", "note"]
    assert rows(df.drop(ORD)) == sorted([("1", "two\nlines", None), ("2", 'say "hi"', None), ("3", None, "plain, comma")], key=repr)


def test_ordinals_do_not_depend_on_the_split_size(spark, tmp_path, rows):
    folder = tmp_path / "parts"
    folder.mkdir()
    for name in ("b", "a", "c"):
        (folder / f"{name}.csv").write_text("k,v\n" + "".join(f"{name}{i},{'x' * (i % 50)}\n" for i in range(400)))
    found = {}
    for size in ("1k", "7k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        df = tables.read_csv(spark, str(folder))
        found[size] = rows(df.select(ORD, "k")), df.rdd.getNumPartitions()
    for key in ("maxPartitionBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")
    assert found["1k"][0] == found["7k"][0] == found["128m"][0] and found["1k"][1] > found["128m"][1]
    in_order = [k for _, k in sorted(found["1k"][0])]
    assert in_order == [f"{n}{i}" for n in "abc" for i in range(400)]


def test_folders_skip_junk_files(spark, tmp_path):
    (tmp_path / "deals.csv").write_text("id,value\n1,2\nNA,\n")
    (tmp_path / "pivot.csv").write_text("total,,,\n1,2,3,4\n")
    (tmp_path / "none.csv").write_text("id,value\nNA,n/a\n")
    report = {r["sheet"]: (r["kept"], r["reason"]) for r in tables.sheet_report(tables.scan_folder(spark, str(tmp_path))).collect()}
    assert report == {"deals": (True, ""), "none": (False, "empty"), "pivot": (False, "looks like a pivot table")}
    kept = tables.read_folder(spark, str(tmp_path))
    assert [(s.name, s.df.count()) for s in kept] == [("deals", 1)]


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    old = spark.range(5).toDF("a")
    sinks.write_raw([Sheet("s", old)], str(tmp_path))
    broken = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("id")).alias("a"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_raw([Sheet("s", broken)], str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/raw/s").count() == 5
    sinks.write_raw([Sheet("s", spark.range(9).toDF("a"))], str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/raw/s").count() == 9
    with pytest.raises(Exception, match="stop"):
        sinks.write_report(broken, f"{tmp_path}/report")
    sinks.write_report(old, f"{tmp_path}/report")
    sinks.write_report(old.limit(2), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "a.csv").write_text("x,z\n1,2\n3,4\n")
    (tmp_path / "c.txt").write_text("no")
    make_workbook(tmp_path / "w.xlsx", {"T": [["h1", "h2"], ["1", "2"]]})
    sheets = tables.read_folder(spark, str(tmp_path))
    assert [s.name for s in sheets] == ["a", "b", "T"]
    assert [s.df.count() for s in sheets] == [2, 1, 1]
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_any(spark, str(tmp_path / "c.txt"))
    assert tables.read_any(spark, str(tmp_path / "a.csv"))[0].name == "a"


def test_junk_sheets(spark):
    frames = {
        "good": spark.createDataFrame([("1", "2", None)], "a string, b string, `Unnamed: 2` string"),
        "pivot": spark.createDataFrame([("1", "2", "3")], "a string, `_c1` string, `_c2` string"),
        "one": spark.createDataFrame([("1",)], "a string"),
        "empty": spark.createDataFrame([(None, None)], "a string, b string")}
    sheets = [Sheet(n, d) for n, d in frames.items()]
    report = {r["sheet"]: (r["kept"], r["reason"]) for r in tables.sheet_report(sheets).collect()}
    assert report["good"] == (True, "") and report["pivot"][0] is False and report["one"][0] is False and report["empty"] == (False, "empty")
    assert tables.keep_data_sheets(sheets)[0].df.columns == ["a", "b"]


def test_frame_cleaning(spark):
    df = spark.createDataFrame([("1", None, "x", "p"), (None, None, None, None)], "` a ` string, gone string, `Unnamed: 2` string, `q : r` string")
    out = tables.clean_frame(df)
    assert out.columns == ["a", "r"] and out.count() == 1


def make_workbook(path, sheets):
    """A minimal workbook: inline strings, numbers, one date-styled number per ('date', n)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def cell(c, r, v):
        ref = f"{chr(65 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[1]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="t"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_folder(spark, tmp_path, rows):
    make_workbook(tmp_path / "one.xlsx", {"Deals": [["id", "amount", None, "day"], ["A", 12, None, ("date", 45306)], [None] * 4, ["B", 1.5, None, "N/A"]],
                                          "Junk": [["only"], ["x"]]})
    (tmp_path / "broken.xlsx").write_bytes(b"not a workbook")
    sheets = workbooks.read_workbooks(spark, str(tmp_path))
    assert [s.name for s in sheets] == ["Deals", "Junk"]
    kept = tables.keep_data_sheets(sheets)
    assert [s.name for s in kept] == ["Deals"]
    assert rows(kept[0].df.drop(ORD)) == [("A", "12", "2024-01-15 00:00:00"), ("B", "1.5", None)]
    errors = workbooks.parse_workbooks(spark, str(tmp_path)).where("error is not null").collect()
    assert [e["file"] for e in errors] == ["broken.xlsx"]


def test_fingerprint_is_about_content_only(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") > 9, "x").alias("b"))
    same = catalog.fingerprint(df).first()
    assert same == catalog.fingerprint(df.repartition(7)).first()
    assert same != catalog.fingerprint(df.union(df.limit(1))).first()
    assert same["content_hash"] != catalog.fingerprint(df.na.fill("")).first()["content_hash"]


def test_catalog_and_raw_snapshot(spark, tmp_path):
    sheets = [Sheet("s1", spark.range(3).toDF("a"), "f.csv"), Sheet("s2", spark.range(2).selectExpr("id a", "'x' b"))]
    got = {r["sheet"]: r for r in catalog.catalog(sheets).collect()}
    assert got["s1"]["row_count"] == 3 and got["s1"]["source_file"] == "f.csv" and got["s2"]["columns"] == ["a", "b"]
    sinks.write_raw(sheets, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/raw/s1").count() == 3
    assert spark.read.parquet(f"{tmp_path}/catalog").where("content_hash is not null").count() == 2


def test_run_log_and_reproducible_runs(spark, tmp_path):
    path = f"{tmp_path}/log"
    for run, versions in [("r1", {"schema": "v1", "map": "v2"}), ("r2", {"map": "v2", "schema": "v1"}), ("r3", {"schema": "v9"})]:
        sinks.append_run_log(spark, path, run, "d", versions, "mixed", 10, 5)
    log = sinks.read_run_log(spark, path)
    assert log.count() == 3
    assert [r["runs"] for r in sinks.reproducible_runs(log).collect()] == [["r1", "r2"]]
    assert sinks.same_versions(log, "r1", "r2") and not sinks.same_versions(log, "r1", "r3")


def test_csv_export_is_key_ordered(spark, tmp_path):
    df = spark.createDataFrame([("b", "1"), (None, "1"), ("a", "2")], "account_id string, close_date string")
    sinks.export_csv(df.repartition(3), f"{tmp_path}/out")
    back = tables.read_csv(spark, f"{tmp_path}/out")
    assert back.count() == 3 and set(back.columns) == {"account_id", "close_date", ORD}


def test_layered_run_end_to_end(spark, tmp_path):
    contracts = spark.createDataFrame([
        ("C-100", "A1", "AWS", "$1,000", "2024-01-01", "2024-12-31", "12", "yes"), ("C-100", "A1", "AWS", "500", "2024-02-01", "2025-01-31", "24", "no"),
        ("C-200", "A2", "Amazon Web Services", "2k", "2024-03-01", "2025-03-01", "12", "no"), ("C-200", "A2", "AWS", "3k", "2024-03-01", "2025-03-01", "12", None),
        ("C-300", "A3", "Oracle", "#REF!", "2024-03-01", "2025-03-01", None, None)],
        "`Contract #` string, `Account ID` string, Vendor string, `Total Value` string, `Start Date` string, `End Date` string, `Term (months)` string, `Auto Renew` string")
    accounts = spark.createDataFrame([("A1", "Gold"), ("A2", "Tin")], "`Account Ref` string, Segment string")
    with_order = lambda df: df.coalesce(1).withColumn(ORD, F.monotonically_increasing_id())
    result = consolidate.run_layers([Sheet("contracts", with_order(contracts)), Sheet("accounts", with_order(accounts))],
                                    as_of=F.to_date(F.lit("2026-01-01")), primary="contracts")
    got = {r["contract_id"]: r for r in result.contracts.collect()}
    assert result.levels == {"contracts": "mixed", "accounts": "mixed"}
    assert (got["C-100"]["total_value"], got["C-100"]["line_item_count"], got["C-100"]["term_months"]) == (1500.0, 2, 24.0)
    assert got["C-200"]["vendor_canonical"] == "AWS" and got["C-200"]["account_segment"] == "Tin"
    assert got["C-100"]["contract_duration_days"] == 396 and got["C-200"]["churn_flag"] is True
    assert result.contracts.columns[:2] == ["account_id", "contract_id"]
    assert result.passed and result.ready_for_ml() and result.line_items.count() == 5
    sinks_meta = consolidate.store_layers(result, str(tmp_path), run_id="r1").first()
    assert sinks_meta["contract_count"] == 3 and sinks_meta["line_item_count"] == 5
    assert spark.read.parquet(f"{tmp_path}/canonical/contracts").count() == 3
    log = sinks.read_run_log(spark, f"{tmp_path}/run_log").first()
    assert (log["rows_before"], log["rows_after"], log["validation_status"]) == (5, 3, "passed")


def test_required_fields_can_be_missing(spark):
    config = MappingConfig([("contract_id", "s", "id")])
    result = consolidate.run_layers([Sheet("s", spark.createDataFrame([("a",), ("b",)], "id string"))], config)
    assert not result.passed
    assert [r["type"] for r in result.issues.collect()] == ["required_fields_missing"]
    assert isinstance(checks.passed(result.issues), bool)


def test_appending_files_as_they_arrive(spark, tmp_path, rows):
    root, inbox = str(tmp_path / "root"), tmp_path / "in"
    inbox.mkdir()
    master.create_master(spark.createDataFrame([("A", "d1", "x")], "account_id string, close_date string, stage string"), root, parts=4)
    mapping = {"acc": "account_id", "day": "close_date", "tier": "tier"}

    def run():
        append_stream(spark, str(inbox), ["acc", "day", "tier"], mapping, root, str(tmp_path / "cp")).awaitTermination()

    (inbox / "1.csv").write_text("acc,day,tier\nA,d1,gold\nB,d2,NA\n")
    run()
    assert rows(master.read_master(spark, root)) == [("A", "d1", "x", "gold"), ("B", "d2", None, None)]
    (inbox / "2.csv").write_text("acc,day,tier\nB,d2,tin\n")
    run()
    assert rows(master.read_master(spark, root)) == [("A", "d1", "x", "gold"), ("B", "d2", None, "tin")]


def test_broken_and_numbered_tabs(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        make_workbook(tmp_path / folder / "x.xlsx", {"01": [["h1", "h2"], ["1", folder]], "2024": [["h1"], ["q"], ["r"]]})
    with zipfile.ZipFile(tmp_path / "a" / "x.xlsx") as book:
        parts = {n: book.read(n) for n in book.namelist()}
    broken = next(n for n in parts if n.endswith("sheet2.xml"))
    parts[broken] = parts[broken][: parts[broken].rindex(b"<row")] + b"<row r='x'><c"
    with zipfile.ZipFile(tmp_path / "a" / "x.xlsx", "w") as book:
        for name, data in parts.items():
            book.writestr(name, data)
    found = {s.name.rsplit("/", 2)[-2] + "/" + s.name.rsplit(":", 1)[-1]: s.df.count() for s in workbooks.read_workbooks(spark, f"{tmp_path}/*/")}
    assert found == {"a/01": 1, "b/01": 1, "b/2024": 2}
    errors = workbooks.parse_workbooks(spark, f"{tmp_path}/*/").where("error is not null").collect()
    assert [(e["sheet"], e["path"].rsplit("/", 2)[-2]) for e in errors] == [("2024", "a")]


def test_audit_tables(spark):
    df = spark.createDataFrame([("C1", "5", "2024-01-01", "2024-02-01", "q"), ("C1", "7", "2024-01-01", "2024-02-01", "r")], "`Contract ID` string, amount string, start string, stop string, zz string")
    sheets = [Sheet("s", df)]
    config = MappingConfig([("contract_id", "s", "Contract ID"), ("total_value", "s", "amount"), ("start_date", "s", "start"), ("end_date", "s", "stop")], "v2")
    result = consolidate.run_layers(sheets, config)
    run = {r["metric"]: r["value"] for r in audit.audit_run(sheets, result, "d").collect()}
    assert (run["rows_ingested"], run["final_rows"], run["line_items_merged"], run["mapping_version"]) == ("2", "1", "1", "v2")
    hints = suggest.suggest_mappings(sheets)
    found = {r["raw"]: (r["canonical"], r["method"]) for r in audit.audit_mapping(sheets, config, hints).collect()}
    assert found["Contract ID"] == ("contract_id", "exact_alias") and found["stop"] == ("end_date", "confirmed") and found["zz"] == (None, None)
    assert {r["method"] for r in audit.audit_mapping(sheets, config).collect()} == {"confirmed", None}
    assert [tuple(r) for r in audit.audit_sheets(sheets, result.levels).collect()] == [("s", 2, result.levels["s"])]


def test_rows_are_numbered_range_by_range(spark, tmp_path, monkeypatch):
    """Places count on over ranges and files; no window ranks all rows at once."""
    monkeypatch.setattr(tables, "PLACE_BITS", 2)
    ordinals = [i << tables.FILE_ROWS | n for i in (1, 2) for n in range(0, 30, 3)] + [None]
    df = spark.createDataFrame([(n, f"r{n}") for n in ordinals], f"{ORD} bigint, `a.b` string").repartition(3)
    placed = tables.with_place(df)
    assert [(r["position"], r[ORD]) for r in sorted(placed.collect(), key=lambda r: r["position"])] == list(enumerate([None, *ordinals[:-1]], 1))
    assert placed.columns == ["position", ORD, "a.b"]
    assert "row_number() windowspecdefinition(__range" in placed._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_written_beside_the_contracts(spark, tmp_path, monkeypatch):
    """Both writes run at a time, and one that fails is not passed over."""
    import threading

    both, write = threading.Barrier(2, timeout=60), sinks.replace_table

    def meet(df, path, *args, **options):
        if path.endswith(("/contracts", "/line_items")):
            both.wait()
        write(df, path, *args, **options)

    monkeypatch.setattr(sinks, "replace_table", meet)
    contracts, items = spark.range(3).select("id"), spark.range(5).select("id", F.lit(1).alias("_ord"))
    meta = sinks.write_canonical(contracts, items, str(tmp_path / "a"), "d", {}).first()
    assert (meta["contract_count"], meta["line_item_count"], meta["line_item_columns"]) == (3, 5, ["id"])
    with pytest.raises(Exception, match="no such line"):
        sinks.write_canonical(contracts, items.select(F.raise_error(F.concat(F.lit("no such line "), "id")).cast("string").alias("id")), str(tmp_path / "b"), "d", {})
