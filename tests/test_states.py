import pytest
from pyspark.sql import functions as F

from keyfold.model import Sheet
from keyfold.sources import catalog, sinks, states


def some(spark, begin, end):
    return spark.range(begin, end).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), F.col("id"))).alias("b c"))


def test_states_of_appends_add_up_to_a_full_read(spark, tmp_path):
    root = str(tmp_path)
    parts = [states.append_sheet(Sheet("deals", some(spark, *span)), root, n) for n, span in enumerate([(0, 40), (40, 41), (30, 70)])]
    whole = states.read_sheet(spark, root, "deals")
    read = catalog.fingerprint(whole.select("a", "b c")).first()
    sum_ = states.total(parts)
    assert (sum_.n_rows, sum_.content_hash) == tuple(read) and sum_.filled == {"a": 81, "b c": whole.where("`b c` is not null").count()}
    row = states.stored_catalog(spark, root).first()
    assert (row["row_count"], row["content_hash"], row["columns"], row["inferred_types"]) == (81, read["content_hash"], ["a", "b c"], ["string", "string"])
    filled = {r["column"]: (r["non_null"], r["total"]) for r in states.stored_completeness(spark, root).collect()}
    assert filled == {"a": (81, 81), "b c": (sum_.filled["b c"], 81)}


def test_a_repeated_append_counts_once(spark, tmp_path):
    root = str(tmp_path)
    for span in ((0, 10), (10, 20), (10, 20)):
        states.append_sheet(Sheet("s", some(spark, *span)), root, span[0] // 10)
    assert states.stored_catalog(spark, root).first()["row_count"] == states.read_sheet(spark, root, "s").count() == 20


def test_empty_rows_and_unequal_columns(spark, tmp_path):
    none = states.append_sheet(Sheet("s", some(spark, 0, 0)), str(tmp_path), 0)
    assert (none.n_rows, none.content_hash) == tuple(catalog.fingerprint(some(spark, 0, 0)).first())
    with pytest.raises(ValueError, match="different columns"):
        states.total([none, states.append_sheet(Sheet("t", spark.range(2).toDF("z")), str(tmp_path), 0)])


def test_runs_log_what_they_wrote(spark, tmp_path):
    root, versions = str(tmp_path), {"schema": "1", "map": "2"}
    for run, df in (("r1", some(spark, 0, 30)), ("r2", some(spark, 0, 30).repartition(5)), ("r3", some(spark, 0, 29).unionByName(some(spark, 40, 41)))):
        state = sinks.write_run(df, root, run, "d", versions)
        assert state.content_hash == catalog.fingerprint(df).first()["content_hash"]
    log = sinks.read_run_log(spark, f"{root}/run_log")
    row = sinks.reproducible_runs(log).first()
    assert row["runs"] == ["r1", "r2", "r3"] and row["equal"] is False
    assert sinks.reproducible_runs(log.where("run_id <> 'r3'")).first()["equal"] is True
    assert [(r["run_id"], r["first_run"]) for r in sinks.differing_runs(log).collect()] == [("r3", "r1")]
    sinks.append_run_log(spark, f"{root}/run_log", "r4", "d", versions, "mixed", 1, 1)  # a run without a fingerprint proves nothing
    assert sinks.reproducible_runs(sinks.read_run_log(spark, f"{root}/run_log")).first()["equal"] is None
