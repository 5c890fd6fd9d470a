"""Equivalence classes, toplexes and singletons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.plans.lineage import drop, stage


def dual(inc: DataFrame) -> DataFrame:
    return inc.select(F.col("node").alias("edge"), F.col("edge").alias("node"), *[c for c in inc.columns if c not in ("edge", "node")])


def edge_classes(inc: DataFrame) -> DataFrame:
    """(id, rep): each hyperedge and the smallest id of those with the same nodes.

    Node sets are told apart by their size and two 64-bit exclusive-or hashes first; only hyperedges that agree in these have
    their sets gathered and compared, so no class and no set of a lone hyperedge is ever held in a row.
    """
    inc = inc.select("edge", "node").distinct()
    keys = ["n", "h1", "h2"]
    digest = inc.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("h2"))
    digest = stage(digest)
    twins = stage(digest.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    shared = stage(digest.join(twins, keys))
    sets = stage(inc.join(shared, "edge").groupBy("edge", *keys).agg(F.sort_array(F.collect_list("node")).alias("nodes")))
    reps = stage(sets.groupBy(*keys, "nodes").agg(F.min("edge").alias("rep")))
    found = sets.join(reps, [*keys, "nodes"]).select(F.col("edge").alias("id"), "rep")
    lone = digest.join(shared.select("edge"), "edge", "left_anti").select(F.col("edge").alias("id"), F.col("edge").alias("rep"))
    out = stage(lone.unionByName(found))
    drop(digest, twins, shared, sets, reps)
    return out


def collapse_edges(inc: DataFrame) -> DataFrame:
    """(rep, class_size, members): hyperedges of one node set; rep is the smallest id, members are sorted.

    A row lists a whole class; ``edge_classes`` has the same in rows.
    """
    same = edge_classes(inc).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return same.select("rep", F.size("members").cast("long").alias("class_size"), "members")


def collapse_nodes(inc: DataFrame) -> DataFrame:
    """The same of nodes that lie in the same hyperedges."""
    return collapse_edges(dual(inc))


def collapse_nodes_and_edges(inc: DataFrame) -> DataFrame:
    """Nodes are collapsed first, then hyperedges over the nodes' representatives."""
    reps = edge_classes(dual(inc))
    return collapse_edges(inc.join(reps, F.col("node") == F.col("id")).select("edge", F.col("rep").alias("node")).distinct())


def collapsed(inc: DataFrame) -> DataFrame:
    """The incidences of one hyperedge for each class."""
    return inc.join(edge_classes(inc).where("id = rep").select(F.col("rep").alias("edge")), "edge", "left_semi")


def toplexes(inc: DataFrame, keep: str = "first") -> DataFrame:
    """(edge): hyperedges that no other contains; of equal ones the smallest id stays, or the largest with ``keep='last'``.

    Equal hyperedges are merged before the join, so copies cost nothing. A hyperedge that contains another has the other's
    rarest node, so each meets only the larger ones at its rarest node; of those, only pairs are verified where the larger one's signature,
    a bit of 64 for each node's hash, has all bits of the smaller one's, which loses no pair.
    """
    same = edge_classes(inc)
    classes = stage(same.groupBy(F.col("rep").alias("edge")).agg(F.max("id").alias("last")))
    one = stage(inc.select("edge", "node").distinct().join(classes.select("edge"), "edge", "left_semi"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("node"), F.lit(64)).cast("int"))
    sizes = stage(one.groupBy("edge").agg(F.count(F.lit(1)).alias("size"), F.bit_or(bit).alias("bits")))
    degree = stage(one.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    rarest = one.join(degree, "node").groupBy("edge").agg(F.min(F.struct("degree", "node")).alias("r"))
    small = stage(rarest.join(sizes, "edge").where("r.degree > 1").select(F.col("edge").alias("src"), F.col("r.node").alias("node"), F.col("size").alias("m"), F.col("bits").alias("mine")))
    large = stage(one.join(sizes, "edge").select(F.col("edge").alias("dst"), "node", "size", "bits"))
    pairs = stage(small.join(large, "node").where("size > m and (mine & ~bits) = 0").select("src", "dst", "m"))
    common = pairs.join(one.withColumnRenamed("edge", "src"), "src").join(one.withColumnRenamed("edge", "dst"), ["dst", "node"])
    inside = common.groupBy("src", "dst", "m").agg(F.count(F.lit(1)).alias("n")).where("n = m").select(F.col("src").alias("edge"))
    out = stage(classes.join(inside, "edge", "left_anti").select(F.col("last" if keep == "last" else "edge").alias("edge")))
    drop(same, classes, one, sizes, degree, small, large, pairs)
    return out


def singletons(inc: DataFrame) -> DataFrame:
    """(edge): hyperedges of one node that lies in no other."""
    lone = inc.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    rare = inc.groupBy("node").agg(F.count(F.lit(1)).alias("d")).where("d = 1")
    return lone.join(rare, "node", "left_semi").select("edge")
