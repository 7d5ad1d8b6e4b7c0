import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_part(tmp_path):
    for name in ("keyfold", "workload"):
        shutil.copytree(os.path.join(REPO, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'merge_full_outer' in q and 'pipeline' not in q and set(o) <= set(q); assert not any(n.startswith('op1') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode != 0


def test_workers_get_the_package(tmp_path):
    """From another folder, without the package on the workers' path."""
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import functions as F
from keyfold.session import build_session
from keyfold.model import Sheet
from keyfold.operators import entities, suggest
spark = build_session("far", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {str(tmp_path / "shared")!r}}})
df = spark.createDataFrame([(1, "AWS", "x"), (2, "Amazon Web Services", "y")], "n int, vendor string, `Anual Cost` string")
assert suggest.suggest_mappings([Sheet("s", df)]).where("canonical = 'acv'").count() == 1
assert entities.resolve_names(df, "vendor", F.col("n")).select("vendor_cluster_id").distinct().count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True)
