"""Sizes, degrees and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(inc: DataFrame, key: str = "edge", universe: str = "observed") -> DataFrame:
    """(key, size); with the dense universe also ids of 0..max that have no incidence, of size 0."""
    seen = inc.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    if universe == "observed":
        return seen
    top = inc.agg(F.coalesce(F.max(key), F.lit(-1))).first()[0]
    every = inc.sparkSession.range(top + 1).withColumnRenamed("id", key)
    return every.join(seen, key, "left").select(key, F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def histogram(inc: DataFrame, key: str = "edge") -> DataFrame:
    """(size, count)."""
    return sizes(inc, key).groupBy("size").agg(F.count(F.lit(1)).alias("count"))


def summary(inc: DataFrame) -> DataFrame:
    """One row for each side (edge, node): count, max, total, avg and the upper median of sizes, exact.

    The median is read from the histogram, whose rows are distinct sizes, so no list of all sizes is built.
    """
    out = None
    for side in ("edge", "node"):
        h = histogram(inc, side)
        cells = h.agg(
            F.sum("count").alias("n"), F.max("size").alias("max_size"), F.sum(F.col("size") * F.col("count")).alias("total"),
            F.sort_array(F.collect_list(F.struct("size", "count"))).alias("h"),
        )
        walk = "aggregate(h, struct(0L as seen, cast(null as bigint) as m), (a, x) -> struct(a.seen + x.count as seen, if(a.m is null and a.seen + x.count > n div 2, x.size, a.m) as m)).m"
        row = cells.select(F.lit(side).alias("side"), "n", "max_size", "total", (F.col("total") / F.col("n")).alias("avg_size"), F.expr(walk).alias("median_size"))
        out = row if out is None else out.unionByName(row)
    return out


def above_below(inc: DataFrame, limit: int) -> DataFrame:
    """(side, n_above, n_below, share_above, share_below): sizes above ``limit``, and at most it."""
    out = None
    for side in ("edge", "node"):
        row = sizes(inc, side).agg(F.count_if(F.col("size") > limit).alias("n_above"), F.count_if(F.col("size") <= limit).alias("n_below"))
        n = F.col("n_above") + F.col("n_below")
        row = row.select(F.lit(side).alias("side"), "n_above", "n_below", (F.col("n_above") / n).alias("share_above"), (F.col("n_below") / n).alias("share_below"))
        out = row if out is None else out.unionByName(row)
    return out


def filtered_sizes(inc: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """(edge, size): nodes of each hyperedge whose degree is in low..high; hyperedges without any have 0."""
    degree = inc.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    fits = (F.col("d") >= low) & (F.lit(True) if high is None else F.col("d") <= high)
    return inc.join(degree, "node").groupBy("edge").agg(F.count_if(fits).alias("size"))


def counts(inc: DataFrame) -> DataFrame:
    """One row: dense counts (largest id and one), and observed counts, of both sides."""
    return inc.agg(
        (F.max("edge") + 1).alias("edges_dense"), (F.max("node") + 1).alias("nodes_dense"), F.countDistinct("edge").alias("edges"), F.countDistinct("node").alias("nodes"), F.count(F.lit(1)).alias("incidences")
    )
