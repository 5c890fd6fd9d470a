"""Writers of hypergraph files. Text formats with a header are single files by nature; Parquet is the format for large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.operators.relabel import running_sums
from overlace.operators.structure import dual
from overlace.sources.readers import ADJACENCY, MATRIX_MARKET, WEIGHTED_ADJACENCY


def _text(lines: DataFrame, path: str) -> None:
    """lines: (k, i, value) in order of k and i, in one file."""
    lines.repartitionByRange(1, "k", "i").sortWithinPartitions("k", "i").select("value").write.mode("overwrite").text(path)


def write_matrix_market(inc: DataFrame, path: str) -> None:
    """A general coordinate file, 1-based, with the weight column if there is one."""
    weight = "weight" in inc.columns
    kind = "pattern" if not weight else "real" if inc.schema["weight"].dataType.typeName() in ("double", "float") else "integer"
    n0, n1, nnz = inc.agg(F.coalesce(F.max("edge") + 1, F.lit(0)), F.coalesce(F.max("node") + 1, F.lit(0)), F.count(F.lit(1))).first()
    head = inc.sparkSession.createDataFrame([(0, 0, f"{MATRIX_MARKET} matrix coordinate {kind} general"), (0, 1, f"{n0} {n1} {nnz}")], "k long, i long, value string")
    body = inc.select((F.col("edge") + 1).alias("k"), F.col("node").alias("i"), F.concat_ws(" ", F.col("edge") + 1, F.col("node") + 1, *(["weight"] if weight else [])).alias("value"))
    _text(head.unionByName(body), path)


def write_csv(inc: DataFrame, path: str) -> None:
    """Line i holds the 1-based nodes of hyperedge i; ids without incidences are empty lines."""
    top = inc.agg(F.coalesce(F.max("edge"), F.lit(-1))).first()[0]
    rows = inc.groupBy("edge").agg(F.array_join(F.sort_array(F.collect_list(F.col("node") + 1)), ",").alias("value"))
    every = inc.sparkSession.range(top + 1).withColumnRenamed("id", "edge").join(rows, "edge", "left")
    _text(every.select(F.col("edge").alias("k"), F.lit(0).cast("long").alias("i"), F.coalesce("value", F.lit("")).alias("value")), path)


def write_adjacency(inc: DataFrame, path: str) -> None:
    """Counts, then offsets, lists and (with a weight column) weights of the nodes, then of the hyperedges; a token a line."""
    weight = "weight" in inc.columns
    parts, counts = [], []
    for k, side in ((2, dual(inc)), (5, inc)):
        top = side.agg(F.coalesce(F.max("edge"), F.lit(-1))).first()[0]
        size = side.groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
        every = side.sparkSession.range(top + 1).withColumnRenamed("id", "edge").join(size, "edge", "left").fillna(0, ["n"])
        run = running_sums(every, "edge", "n", "v")
        counts += [top + 1, side.count()]
        parts.append(run.select(F.lit(k).cast("long").alias("k"), F.col("edge").alias("i"), F.lit(0).cast("long").alias("j"), F.col("v").cast("string").alias("value")))
        for step, c in enumerate(["node", *(["weight"] if weight else [])]):
            parts.append(side.select(F.lit(k + 1 + step).cast("long").alias("k"), F.col("edge").alias("i"), F.col("node").alias("j"), F.col(c).cast("string").alias("value")))
    head = inc.sparkSession.createDataFrame([(0, 0, i, str(x)) for i, x in enumerate([WEIGHTED_ADJACENCY if weight else ADJACENCY, *counts])], "k long, i long, j long, value string")
    for p in parts:
        head = head.unionByName(p)
    head.repartitionByRange(1, "k", "i", "j").sortWithinPartitions("k", "i", "j").select("value").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """Lines "size count" in order of size."""
    _text(histogram.select(F.col("size").alias("k"), F.lit(0).cast("long").alias("i"), F.concat_ws(" ", "size", "count").alias("value")), path)


def append_log(rows: DataFrame, path: str) -> None:
    """Benchmark results as JSON lines."""
    rows.write.mode("append").json(path)
