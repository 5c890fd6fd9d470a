"""Cutting lineage safely: tables written once to the shared folder, and dropped as soon as nothing needs them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_STAGED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='overlace-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made inside give their shuffle files back when they end; loops would otherwise pile them up until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, written once, so that a lost executor costs no recomputation.

    The table stays until ``drop`` is called with the result, or the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.select("*").write.parquet(path)  # a plan of its own, as the mode is fixed when a plan is made
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


#: The name of ``stage`` in loops, where each round's table replaces the one before.
cut = stage


def counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The staged table, and its rows as ``n`` and further aggregates, which are taken while it is written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]))
    return out, seen.get


class Ledger:
    """A staged table that grows by parts; a part is written once, and all parts are read as one table by one scan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.schema = spark, [], None
        self._staged_at = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        _STAGED[self._staged_at] = spark

    def append(self, df: DataFrame, **measures: Column) -> dict:
        """Writes the next part; gives its rows as ``n`` and further aggregates."""
        seen = Observation()
        with dropping_shuffles(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]).write.parquet(f"{self._staged_at}/part={len(self.rows)}")
        self.schema = self.schema or df.schema
        self.rows.append(seen.get["n"])
        return seen.get

    def __len__(self) -> int:
        return len(self.rows)

    def part(self, *which: int) -> DataFrame:
        """The rows of some parts."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self._staged_at}/part={k}" for k in which])

    def last(self, n: int = 1) -> DataFrame:
        return self.part(*range(max(0, len(self) - n), len(self)))

    def table(self) -> DataFrame:
        """The rows of all parts; ``drop`` takes the result as well as the ledger."""
        out = self.spark.read.schema(self.schema).parquet(self._staged_at).select(self.schema.names)
        out._staged_at = self._staged_at
        return out


def adopt(spark: SparkSession, path: str) -> str:
    """Lets ``release`` delete a folder in the shared one that was written otherwise."""
    _STAGED[path] = spark
    return path


def staged() -> list[str]:
    """The folders that are there now."""
    return sorted(_STAGED)


def drop(*tables: DataFrame | Ledger | None) -> None:
    """Deletes staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path in _STAGED:
            _delete(_STAGED.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Deletes all staged tables; results that still read them must have been written before."""
    while _STAGED:
        path, spark = _STAGED.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its folder goes with it
            return


atexit.register(release)
