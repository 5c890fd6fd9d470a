"""New ids: by degree, squeezed, and one id space for both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from overlace.plans.lineage import cut


def dense_ranks(df: DataFrame, order: list, name: str = "new_id", split: list | None = None) -> DataFrame:
    """Numbers the rows 0.. in ``order``, which must be total, without gathering them in one task.

    Rows are range-partitioned by ``split`` (a coarser order, or ``order`` itself) and sorted. The place in its partition is
    written with each row; one number a partition, the rows before it, is summed on the driver and joined.
    """
    spread = cut(df.repartitionByRange(*(split or order)).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)  # monotonically_increasing_id counts in the lower 33 bits
    sizes = sorted(spread.groupBy(part.alias("_part")).count().collect())
    before, n = [], 0
    for p, k in sizes:
        before.append((p, n - (p << 33)))
        n += k
    shift = df.sparkSession.createDataFrame(before, "_part long, _shift long")
    out = spread.withColumn("_part", part).join(F.broadcast(shift), "_part")  # a row for each partition
    return out.withColumn(name, F.col(name) + F.col("_shift")).drop("_part", "_shift")


def running_sums(df: DataFrame, key: str, value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all rows of a smaller ``key``, which is unique; summed within ranges, then shifted."""
    spread = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    shift, n = [], 0
    for p, k in sorted(spread.groupBy("_part").agg(F.sum(value)).collect()):
        shift.append((p, n))
        n += k or 0
    shift = df.sparkSession.createDataFrame(shift, "_part int, _shift long")
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(F.broadcast(shift), "_part")  # a row for each partition
    return out.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("_shift")).drop("_part", "_shift")


def frontier(perm: DataFrame, shift: tuple[int, int], kind: str = "E") -> DataFrame:
    """(id): the new ids of one side, 'E' or 'N', of an adjoined graph that was relabelled by ``perm`` (old_id, new_id)."""
    return split(perm.select(F.col("old_id").alias("id"), "new_id"), shift).where(F.col("kind") == kind).select(F.col("new_id").alias("id"))


def renamed(graph: DataFrame, perm: DataFrame) -> DataFrame:
    """The edges (src, dst) of a graph under a permutation (old_id, new_id) of its ids."""
    new = lambda k: perm.select(F.col("old_id").alias(k), F.col("new_id").alias(f"_{k}"))
    return graph.join(new("src"), "src").join(new("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def degree_permutation(inc: DataFrame, key: str = "edge", descending: bool = False) -> DataFrame:
    """(old_id, new_id): ids in order of size, ties by old id."""
    d = inc.groupBy(F.col(key).alias("old_id")).agg(F.count(F.lit(1)).alias("_d"))
    return dense_ranks(d, [F.desc("_d") if descending else F.asc("_d"), F.asc("old_id")]).select("old_id", "new_id")


def relabel_by_degree(inc: DataFrame, key: str = "edge", descending: bool = False) -> DataFrame:
    perm = degree_permutation(inc, key, descending)
    return inc.join(perm, F.col(key) == F.col("old_id")).withColumn(key, F.col("new_id")).select(*inc.columns)


def squeeze(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A line graph (src, dst, ...) with endpoints renumbered 0.. in order of old id, and the mapping (old_id, new_id)."""
    ids = pairs.select(F.col("src").alias("old_id")).union(pairs.select("dst")).distinct()
    m = dense_ranks(ids, [F.asc("old_id")])
    a, b = m.select(F.col("old_id").alias("src"), F.col("new_id").alias("_a")), m.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").withColumns({"src": F.col("_a"), "dst": F.col("_b")}).select(*pairs.columns), m


def offsets(inc: DataFrame) -> tuple[int, int]:
    """(of edges, of nodes) in one id space: the smaller side is shifted behind the larger. Negative ids are refused, as sides are told apart by place."""
    e, n, least = inc.agg(F.coalesce(F.max("edge"), F.lit(-1)) + 1, F.coalesce(F.max("node"), F.lit(-1)) + 1, F.coalesce(F.least(F.min("edge"), F.min("node")), F.lit(0))).first()
    if least < 0:
        raise ValueError("one id space for both sides takes ids from 0 on; number them with dense_ranks first")
    return (n, 0) if e < n else (0, e)


def adjoin(inc: DataFrame, shift: tuple[int, int] | None = None) -> DataFrame:
    """(src, dst): the bipartite graph in one id space, src the hyperedge."""
    e, n = shift or offsets(inc)
    return inc.select((F.col("edge") + e).alias("src"), (F.col("node") + n).alias("dst"))


def split(labels: DataFrame, shift: tuple[int, int], ids: str = "id") -> DataFrame:
    """Undoes ``adjoin`` on a table with an id column: adds kind ('E' or 'N') and gives each side its own ids."""
    e, n = shift
    edge = F.col(ids) >= e if e else F.col(ids) < n
    return labels.withColumns({"kind": F.when(edge, "E").otherwise("N"), ids: F.when(edge, F.col(ids) - e).otherwise(F.col(ids) - n)})


def run_on_adjoin(inc: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a graph algorithm, edges (src, dst) to a table with id, on the adjoined graph and splits its result."""
    shift = offsets(inc)
    return split(fn(adjoin(inc, shift)), shift)


def clean(pairs: DataFrame) -> DataFrame:
    """(src, dst) with src < dst: upper triangle, without loops and repetitions."""
    return pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
