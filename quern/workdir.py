"""Folders that every executor can reach.

Whatever an operator writes on the way (state tables, stores, cut lineage) goes
below ``spark.checkpoint.dir`` of the session, or the folder set by
``setCheckpointDir``.  Only where a session on one machine has none, as in tests, a
temporary folder is made and set; on a cluster that is an error.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; sets one of its own only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get().rstrip("/")
    root = getattr(spark.sparkContext, "_quern_root", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
        spark.sparkContext._quern_root = root
    return root


_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path, used by nobody yet, below the shared folder."""
    path = f"{shared_root(spark)}/quern/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Remove all folders that this process asked for; results that read them must be done with."""
    while _made:
        remove_dir(spark, _made.pop())


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, on whatever storage it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder to a name that is free, or is freed."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise RuntimeError(f"cannot move {old} to {new}")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, of which there may be none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []


class Manifest:
    """What a store below ``path`` holds now, as JSON; the highest numbered file counts.

    A change is written beside the files there are and then renamed, so a reader sees
    either the old state or the new one, and whatever a failed attempt left is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.at = f"{path}/_manifest"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._lines = lambda stream: jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.at)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.at))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self) -> dict | None:
        """The state, or None where there is no store yet."""
        have = self._numbers()
        if not have:
            return None
        reader = self._lines(self._fs.open(self._path(f"{self.at}/{have[-1]:09d}.json")))
        try:
            return json.loads(reader.readLine())
        finally:
            reader.close()

    def save(self, state: dict) -> None:
        have = self._numbers()
        new = self._path(f"{self.at}/{(have[-1] if have else 0) + 1:09d}.json")
        part = self._path(f"{self.at}/{uuid.uuid4().hex}.part")
        out = self._fs.create(part, True)
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()
        if not self._fs.rename(part, new):
            raise RuntimeError(f"{new} was written by another process")
        for old in have[:-1]:
            self._fs.delete(self._path(f"{self.at}/{old:09d}.json"), False)
