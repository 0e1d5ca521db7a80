"""What the driver calls, and where things are written."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern import workdir
from quern.shards import ShardPlan

REPO = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_queries_and_sql_belong_together():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 120 and len(sql) > 100


def test_the_core_needs_no_subpackage():
    code = "import sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e"
    blocked = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert blocked.returncode == 0, blocked.stderr
    for p in (REPO / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "quern.llm" not in p.read_text()


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["horizon", "n", "mean_return", "up_rate", "continuation_rate"] and df.count() == 3


def test_folders_are_fresh_and_cleaned(spark):
    a, b = workdir.fresh_dir(spark, "x"), workdir.fresh_dir(spark, "x")
    assert a != b and a.startswith(workdir.shared_root(spark))
    spark.range(3).write.parquet(a)
    assert workdir.exists(spark, a)
    workdir.clean(spark)
    assert not workdir.exists(spark, a)


def test_shards_cover_time_without_gaps(spark):
    plan = ShardPlan(7, 10)
    rows = spark.range(-50, 50).select(F.col("id").alias("t"), plan.of(F.col("id")).alias("s"))
    assert rows.where(~F.col("t").between(plan.first(F.col("s")), plan.last(F.col("s")))).count() == 0
    one = ShardPlan(7, 1)
    assert spark.range(-50, 50).select(one.of(F.col("id")).alias("s")).distinct().count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_workers_get_the_package_wherever_the_driver_starts(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
from quern.session import local_session
print("rows", e.queries()["wicked_renko"](local_session(2, 2), {str(DATA)!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows " in run.stdout, run.stderr[-2000:]
