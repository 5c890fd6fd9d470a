"""Distances and paths of line graphs: levels for hops, buckets of distances for weights, words of bits for many sources."""

from __future__ import annotations

from math import inf, nextafter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.operators.relabel import dense_ranks
from overlace.operators.traverse import symmetric
from overlace.plans.lineage import Ledger, counted, cut, drop

WORD = 64


def _roots(edges: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(id): ``sources``, or every endpoint."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")) if sources is None else sources.select("id")
    return ids.distinct()


def levels(edges: DataFrame, sources: DataFrame | None = None) -> Ledger:
    """(root, id, depth, sigma), a part for each depth, from every vertex of the graph, or from ``sources`` (id); sigma counts shortest paths.

    A neighbour of a vertex at depth k is at k - 1, k or k + 1, so a level is compared with the last two only. The last part is empty.
    """
    adj = symmetric(edges.select("src", "dst")).distinct().persist()
    out = Ledger(edges.sparkSession)
    n = out.append(_roots(edges, sources).select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("depth"), F.lit(1.0).alias("sigma")))["n"]
    while n:
        near = out.last().withColumnRenamed("id", "src").join(adj, "src").groupBy("root", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        n = out.append(near.join(out.last(2).select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(len(out)).cast("long").alias("depth"), "sigma"))["n"]
    adj.unpersist()
    return out


def all_pairs(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(root, id, depth, sigma) of every pair that is connected, a vertex and itself too."""
    return levels(edges, sources).table()


def shortest_path(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """(path): the lexicographically smallest of the shortest paths, as an array of ids; no row if there is none.

    The levels have ids alone; the path is read back from the goal, and a level of it has the vertices of shortest paths only.
    """
    spark = edges.sparkSession
    adj = cut(symmetric(edges.select("src", "dst")).distinct())
    found = Ledger(spark)
    n, there = found.append(spark.createDataFrame([(src,)], "id long")), src == dst
    while n["n"] and not there:
        near = found.last().withColumnRenamed("id", "src").join(adj, "src").select(F.col("dst").alias("id")).distinct()
        n = found.append(near.join(found.last(2), "id", "left_anti"), there=F.coalesce(F.max(F.col("id") == dst), F.lit(False)))
        there = n["there"]
    cur = cut(spark.createDataFrame([(dst, [dst])] if there else [], "id long, path array<long>"))
    for k in range(len(found) - 2, -1, -1) if there else ():
        back = cur.join(adj, F.col("id") == F.col("dst")).groupBy("src").agg(F.min("path").alias("path"))
        held, cur = cur, cut(back.join(found.part(k), F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.concat(F.array("src"), "path").alias("path")))
        drop(held)
    drop(adj, found)
    return cur.select("path")


def delta_stepping(edges: DataFrame, sources: DataFrame | None = None, delta: float | None = None, weight: str = "overlap", report: dict | None = None) -> DataFrame:
    """(root, id, distance): least sums of weights from every endpoint, or from ``sources`` (id), to all that they reach.

    Distances are settled in buckets of width ``delta`` (the largest weight if not given), the least first. Only rows of the current bucket are
    relaxed: by the edges of up to delta until the bucket doesn't change, then once by all edges into later buckets. An edge leads from a bucket to at most
    largest weight / delta buckets before it, so offers are compared with those alone, and what is settled is never written again.
    Weights are 0 or more, long or double as they are. ``report`` gets the buckets, the rounds and the rows written.
    """
    kind = "double" if edges.schema[weight].dataType.typeName() in ("double", "float", "decimal") else "long"
    adj = symmetric(edges.select("src", "dst", F.col(weight).cast(kind).alias("w"))).persist()
    least, most = adj.agg(F.min("w"), F.max("w")).first()
    if least is not None and least < 0:
        raise ValueError("weights must not be negative")
    delta = delta or most or 1
    back = int((most or 0) // delta) + 2
    settled, seen = Ledger(edges.sparkSession), {"buckets": 0, "rounds": 0, "rows": 0}
    keys, low = ["root", "id"], F.min("distance")
    step = lambda front: front.withColumnRenamed("id", "src").join(adj, "src").select("root", F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), "w")
    ahead, now = counted(_roots(edges, sources).select(F.col("id").alias("root"), "id", F.lit(0).cast(kind).alias("distance")), least=low)
    while now["n"]:
        seen["buckets"], seen["rows"] = seen["buckets"] + 1, seen["rows"] + now["n"]
        end = max((now["least"] // delta + 1) * delta, nextafter(now["least"], inf))
        bucket = front = ahead.where(F.col("distance") < F.lit(end))
        first = now["least"]
        while least is not None and least <= delta and first + least < end:  # an edge can stay in the bucket
            offers = step(front).where((F.col("w") <= F.lit(delta)) & (F.col("distance") < F.lit(end))).groupBy(*keys).agg(low.alias("offer"))
            if len(settled):
                offers = offers.join(settled.last(back).select(*keys), keys, "left_anti")
            better = offers.join(bucket, keys, "left").where("distance is null or offer < distance").select(*keys, F.col("offer").alias("distance"))
            held, (front, got) = front, counted(better, least=low)
            drop(held)
            first = got["least"]
            seen["rounds"], seen["rows"] = seen["rounds"] + 1, seen["rows"] + got["n"]
            if not got["n"]:
                break
            held, (bucket, got) = bucket, counted(bucket.unionByName(front).groupBy(*keys).agg(low.alias("distance")))
            drop(held)
            seen["rows"] += got["n"]
        seen["rows"] += settled.append(bucket)["n"]
        drop(bucket, front)
        later = ahead.where(F.col("distance") >= F.lit(end)).unionByName(step(settled.last()).where(F.col("distance") >= F.lit(end)).drop("w"))
        held, (ahead, now) = ahead, counted(later.groupBy(*keys).agg(low.alias("distance")).join(settled.last(back + 1).select(*keys), keys, "left_anti"), least=low)
        drop(held)
    if not len(settled):
        settled.append(ahead)
    drop(ahead)
    adj.unpersist()
    if report is not None:
        report.update(seen)
    return settled.table()


def weighted_distances(edges: DataFrame, source: int, weight: str = "overlap", delta: float | None = None, report: dict | None = None) -> DataFrame:
    """(id, distance): least sums of weights from a vertex, itself included even where it has no edge."""
    found = delta_stepping(edges, edges.sparkSession.createDataFrame([(source,)], "id long"), delta, weight, report)
    out = found.select("id", "distance")
    out._staged_at = found._staged_at
    return out


def relaxed_distances(edges: DataFrame, source: int, weight: str = "overlap", report: dict | None = None) -> DataFrame:
    """The same by rounds over all known distances, as a plain form to compare with; every round writes the whole table."""
    kind = "double" if edges.schema[weight].dataType.typeName() in ("double", "float", "decimal") else "long"
    adj = symmetric(edges.select("src", "dst", F.col(weight).cast(kind).alias("w"))).persist()
    known = cut(edges.sparkSession.createDataFrame([(source, 0, True)], "id long, distance long, new boolean").withColumn("distance", F.col("distance").cast(kind)))
    rows, news = 1, 1
    while news:
        offer = known.where("new").join(adj, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        both = known.select("id", "distance").join(offer, "id", "full").select("id", F.least("distance", "offer").alias("distance"), F.coalesce(F.col("offer") < F.col("distance"), F.col("distance").isNull()).alias("new"))
        held, (known, got) = known, counted(both, new=F.count_if("new"))
        drop(held)
        rows, news = rows + got["n"], got["new"]
    adj.unpersist()
    if report is not None:
        report["rows"] = rows
    return known.select("id", "distance")


def word_levels(edges: DataFrame, sources: DataFrame | None = None, words: DataFrame | None = None) -> tuple[Ledger, DataFrame]:
    """Breadth-first levels of 64 sources at once: parts of (word, id, bits), a bit for each source that reaches id at the part's depth; and (root, word, bit).

    A step is a join and a bit-wise or, so it handles a row where ``levels`` handles up to 64. Bits of the last two levels are
    taken away, as a neighbour of a level is in it or beside it.
    """
    adj = symmetric(edges.select("src", "dst")).distinct().persist()
    if words is None:
        ranked = dense_ranks(_roots(edges, sources).withColumnRenamed("id", "root"), [F.asc("root")], "k")
        words = cut(ranked.select("root", F.expr(f"k div {WORD}").alias("word"), F.expr(f"cast(k % {WORD} as int)").alias("bit")))
    out = Ledger(edges.sparkSession)
    one = F.expr("shiftleft(1L, bit)")
    n = out.append(words.groupBy("word", F.col("root").alias("id")).agg(F.bit_or(one).alias("bits")))["n"]
    while n:
        near = out.last().withColumnRenamed("id", "src").join(adj, "src").groupBy("word", F.col("dst").alias("id")).agg(F.bit_or("bits").alias("new"))
        seen = out.last(2).groupBy("word", "id").agg(F.bit_or("bits").alias("old"))
        fresh = near.join(seen, ["word", "id"], "left").select("word", "id", F.expr("new & ~coalesce(old, 0L)").alias("bits"))
        n = out.append(fresh.where("bits <> 0"))["n"]
    adj.unpersist()
    return out, words
