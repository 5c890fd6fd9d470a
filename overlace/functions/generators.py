"""Seeded random hypergraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlace.operators.relabel import dense_ranks


def _stubs(degrees: DataFrame, name: str, seed: int) -> DataFrame:
    """(k, name): each id repeated by its degree, in an order shuffled by a seeded hash."""
    stubs = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("copy"))
    turn = F.xxhash64("id", "copy", F.lit(seed))
    return dense_ranks(stubs.withColumn("turn", turn), [F.asc("turn"), F.asc("id"), F.asc("copy")], "k").select("k", F.col("id").alias(name))


def configuration_model(edge_degrees: DataFrame, node_degrees: DataFrame, seed: int = 0, contiguous_id_space: bool = False) -> DataFrame:
    """(edge, node) with the given degrees (id, degree) as far as both sums agree; pairs can repeat.

    With ``contiguous_id_space`` both sides share one id space: nodes are numbered behind the largest hyperedge id that is given.
    """
    out = _stubs(edge_degrees, "edge", seed).join(_stubs(node_degrees, "node", seed + 1), "k").select("edge", "node")
    if not contiguous_id_space:
        return out
    shift = edge_degrees.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    return out.withColumn("node", F.col("node") + shift)


def _draw(*keys: str | int) -> Column:
    """Even over 0..1: the first 52 bits of the MD5 digest of the keys between bars, the same on every engine and machine."""
    parts = [F.col(k) if isinstance(k, str) else F.lit(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def power_law(ids: DataFrame, exponent: float = 2.5, least: int = 1, most: int = 1000, seed: int = 0) -> DataFrame:
    """(id, degree) of the rows of ``ids`` (id): degrees of ``least``..``most`` whose frequency falls with their power of -``exponent`` (above 1).

    The inverse of the continuous distribution, cut to whole numbers, at a seeded draw for each id.
    """
    a = 1.0 - exponent
    low, high = float(least) ** a, float(most + 1) ** a
    degree = F.floor(F.pow(F.lit(low) + _draw("id", seed) * (high - low), 1.0 / a)).cast("long")
    return ids.select("id", F.least(F.lit(most), F.greatest(F.lit(least), degree)).cast("long").alias("degree"))


def labels(ids: DataFrame, prefix: str) -> DataFrame:
    """(id, label): names like e0, e1 for the rows of ``ids`` (id)."""
    return ids.select("id", F.concat(F.lit(prefix), F.col("id")).alias("label"))


def labelled(inc: DataFrame, edge_prefix: str = "e", node_prefix: str = "n") -> DataFrame:
    """(edge, node, edge_label, node_label): incidences with both names."""
    return inc.select("edge", "node", F.concat(F.lit(edge_prefix), F.col("edge")).alias("edge_label"), F.concat(F.lit(node_prefix), F.col("node")).alias("node_label"))


def from_histogram(spark: SparkSession, histogram: list[tuple[int, int]]) -> DataFrame:
    """(id, degree) from (degree, count) pairs, ids in the order given."""
    rows, at = [], 0
    for degree, n in histogram:
        rows.append((at, degree, n))
        at += n
    df = spark.createDataFrame(rows, "at long, degree long, n long").where("n > 0")
    return df.select(F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("id"), "degree")


def cell_weights(rows: list[float], columns: list[float]) -> list[list[float]]:
    """The cells of ``rmat`` for independent distributions of the two sides: products of their probabilities."""
    return [[a * b for b in columns] for a in rows]


def rmat(spark: SparkSession, weights: list[list[float]], levels: int, n: int, seed: int = 0) -> DataFrame:
    """n incidences (edge, node) by recursive choice of a cell of ``weights`` at each of ``levels`` levels; pairs can repeat.

    A draw is that of the row, the seed and the level.
    """
    cells = [(i, j, w) for i, row in enumerate(weights) for j, w in enumerate(row)]
    total = sum(w for *_, w in cells)
    out = spark.range(n).select("id", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("node"))
    for level in range(levels):
        out = out.withColumn("u", _draw("id", seed, level))
        pick_i, pick_j, upto = F.lit(cells[-1][0]), F.lit(cells[-1][1]), 1.0
        for i, j, w in reversed(cells):
            pick_i, pick_j = F.when(F.col("u") < upto, i).otherwise(pick_i), F.when(F.col("u") < upto, j).otherwise(pick_j)
            upto -= w / total
        out = out.withColumns({"edge": F.col("edge") * len(weights) + pick_i, "node": F.col("node") * len(weights[0]) + pick_j})
    return out.select("edge", "node")
