"""Writers: rows as CSV, JSON or Parquet, run folders, manifests and reuse by hash."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.adjust import merge_latest
from quern.plans.job import JobSpec
from quern.workdir import exists, remove_dir, rename

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Folders that a table of a run has at most; each costs the time of many thousand rows, to write and to read.
MOST_FOLDERS = 1000


def write_rows(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ("symbol",)) -> None:
    """Columns by name; decimals as doubles; a folder for each value of ``by``."""
    kinds = dict(df.dtypes)
    cols = [F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in sorted(df.columns)]
    writer = df.select(*cols).write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns])
    if form == "csv":
        writer.option("header", True).option("timestampFormat", _ISO).option("nullValue", "").csv(path)
    elif form == "json":
        writer.option("timestampFormat", _ISO).json(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no format {form!r}")


def write_with_policy(df: DataFrame, path: str, policy: str, keys: Sequence[str], version: Sequence[str]) -> None:
    """overwrite, append, or merge: rows already there and new ones, of one key the latest."""
    spark = df.sparkSession
    if policy == "merge" and exists(spark, path):
        both = merge_latest(spark.read.parquet(path), df, keys, version)
        # Written next to what there is and then renamed: of old and new, one is always whole.
        both.write.mode("overwrite").parquet(f"{path}.next")
        rename(spark, path, f"{path}.old")
        rename(spark, f"{path}.next", path)
        remove_dir(spark, f"{path}.old")
    else:
        df.write.mode("append" if policy == "append" else "overwrite").parquet(path)


def write_json(spark: SparkSession, path: str, data: object) -> None:
    """A small document, written from the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(data, indent=1, sort_keys=True, default=str).encode()))
    out.close()


def folders_by(df: DataFrame, by: Sequence[str] = ("symbol",), most: int = MOST_FOLDERS) -> list[str]:
    """Columns of ``by`` that ``df`` has, if they have at most ``most`` values, else none; counted in a pass of its own."""
    own = [c for c in by if c in df.columns]
    return own if own and df.select(*own).distinct().limit(most + 1).count() <= most else []


def save_run(spark: SparkSession, root: str, job: JobSpec, tables: Mapping[str, DataFrame], metrics: Mapping[str, object] | None = None, form: str = "parquet") -> bool:
    """A run's tables below ``root/<hash>``, with a manifest written last; False if that run is there already.

    A table has a folder for each symbol.  One of more than ``MOST_FOLDERS`` symbols has no
    folders: all its rows, with the symbol as a column, lie in files sorted by it.  The
    manifest says by which columns each table has folders.  Rows of a symbol are brought
    together first, so the number of files does not grow with that of tasks.
    """
    at = f"{root}/{job.hash()[:16]}"
    if exists(spark, f"{at}/manifest.json"):
        return False
    by = {name: folders_by(df) for name, df in tables.items()}
    for name, df in tables.items():
        if "symbol" in df.columns:
            df = df.hint("rebalance", "symbol").sortWithinPartitions("symbol")  # symbols too large for one task are split
        write_rows(df, f"{at}/{name}", form, by[name])
    write_json(spark, f"{at}/metrics.json", metrics or {})
    write_json(spark, f"{at}/manifest.json", {"job_id": job.job_id, "hash": job.hash(), "tables": sorted(tables), "folders": by, "format": form})
    return True


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with their number; equal runs give none."""
    cols = sorted(set(a.columns) & set(b.columns))
    left, right = (x.select(*cols) for x in (a, b))
    return left.exceptAll(right).withColumn("only_in", F.lit("a")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("b")))
