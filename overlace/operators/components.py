"""Connected components of any edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.operators.structure import dual
from overlace.plans.lineage import counted, cut, drop


def _observed(df: DataFrame) -> tuple[DataFrame, tuple]:
    """The staged table and its count and sum of row hashes, taken while it is written."""
    out, got = counted(df, h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    return out, (got["n"], got["h"])


#: Rows from which on the minima of a round are staged: a join with them then reads two plain exchanges, so AQE can split the
#: rows of a hub over many tasks. Below it a hub's task is small, and a table more costs more than it saves.
HUBS_FROM = 10_000


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u, reduced before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every endpoint; component is the smallest id reachable.

    Each round rewires every vertex to the smallest id in its neighbourhood (two pre-aggregated minima and two
    equi-joins, which AQE splits on hub vertices), so the number of rounds is logarithmic in practice whatever the
    diameter. A round's tables go when the next one's exist. Null endpoints and self-loops are ignored; an empty
    table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    cur, now = _observed(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = (0, None)
    while now != before and now[0]:
        before = now
        kept = cut if now[0] >= HUBS_FROM else lambda df: df
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(_lowest(both))
        large = kept(both.join(low.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = kept(_lowest(large))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, now = _observed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(cur, low, large, least)
        cur = new
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def afforest(edges: DataFrame, sample: int = 1024, report: dict | None = None) -> DataFrame:
    """The result of ``connected_components``, for graphs with a giant component.

    First only two neighbours of each vertex are linked, the smallest and that of the smallest hash; on most graphs that joins nearly all of a giant
    component. It is told by the labels of about ``sample`` vertices. Then only edges that lead out of it, or lie outside and join different labels, are
    gone through, as edges between labels: exact, whatever the sample says. ``report`` gets the edges, those linked first and those that were left.
    """
    pairs, got = counted(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    few = both.groupBy("u").agg(F.min("v").alias("a"), F.min_by("v", F.xxhash64("v")).alias("b"))
    few, linked = counted(few.select(F.col("u").alias("src"), F.explode(F.array_distinct(F.array("a", "b"))).alias("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    labels, n = counted(connected_components(few))
    share = min(1.0, sample / max(1, n["n"]))
    some = labels.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    giant = some.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    giant = None if giant is None else giant[0]
    outside = cut(labels.where(F.col("component") != F.lit(giant).cast("long")))
    at = lambda k: outside.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    ends = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left").where("cu is not null or cv is not null")
    own = lambda k: F.coalesce(f"c{k}", F.lit(giant).cast("long"))
    left, rest = counted(ends.select(own("u").alias("src"), own("v").alias("dst")).where("src <> dst").distinct())
    if report is not None:
        report.update(edges=got["n"], linked=linked["n"], left=rest["n"])
    merged = connected_components(left).withColumnsRenamed({"id": "label", "component": "low"})
    out = cut(labels.join(merged, F.col("component") == F.col("label"), "left").select("id", F.coalesce("low", "component").alias("component")))
    drop(pairs, few, labels, outside, left)
    return out


def hyper_components(inc: DataFrame, seed: str = "edge", components=None) -> DataFrame:
    """(kind, id, label) of both sides of a hypergraph; label is the smallest id of the ``seed`` side in the component.

    The other side is numbered behind the seed side, whatever the signs of the ids, so the smallest id of a component is the seed side's. Both ranges of
    ids together must fit 64 bits. ``components`` is the function that finds them, ``connected_components`` unless given.
    """
    first, second = ("edge", "node") if seed == "edge" else ("node", "edge")
    top, low = inc.agg(F.coalesce(F.max(first), F.lit(-1)), F.coalesce(F.min(second), F.lit(0))).first()
    shift = top - low + 1
    found = (components or connected_components)(inc.select(F.col(first).alias("src"), (F.col(second) + shift).alias("dst")))
    one, other = ("E", "N") if seed == "edge" else ("N", "E")
    own = F.col("id") <= top
    return found.select(F.when(own, one).otherwise(other).alias("kind"), F.when(own, F.col("id")).otherwise(F.col("id") - shift).alias("id"), F.col("component").alias("label"))


def propagate_labels(inc: DataFrame, seed: str = "edge", active: list[int] | None = None) -> DataFrame:
    """The result of ``hyper_components`` by labels that go to and fro between the sides.

    The seed side begins with its own ids as labels. A half round sends the labels of one side's frontier, the members whose label fell in the half
    round before, over their incidences; the other side's least offers below its labels make its frontier. So a member is sent on only when
    its label fell. There are as many half rounds as the longest shortest path; ``active`` gets the rows of each frontier.
    """
    inc = (inc if seed == "edge" else dual(inc)).select("edge", "node").distinct().persist()
    labels = {"edge": cut(inc.select(F.col("edge").alias("id"), F.col("edge").alias("label"), F.lit(True).alias("new")).distinct()), "node": None}
    at, to, n = "edge", "node", 1
    while n:
        front = labels[at].where("new").select(F.col("id").alias(at), "label")
        offer = front.join(inc, at).groupBy(F.col(to).alias("id")).agg(F.min("label").alias("offer"))
        held = labels[to]
        known = offer.select("id", F.col("offer").alias("label"), F.lit(True).alias("new"))
        if held is not None:
            both = held.select("id", "label").join(offer, "id", "left")
            known = both.select("id", F.least("label", "offer").alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("new"))
        labels[to], got = counted(known, new=F.count_if("new"))
        drop(held)
        n = got["new"]
        if active is not None:
            active.append(n)
        at, to = to, at
    inc.unpersist()
    one, other = ("E", "N") if seed == "edge" else ("N", "E")
    return labels["edge"].select(F.lit(one).alias("kind"), "id", "label").unionByName(labels["node"].select(F.lit(other).alias("kind"), "id", "label"))


def component_lists(found: DataFrame) -> DataFrame:
    """(label, edges, nodes): sorted member lists of the components that ``hyper_components`` found.

    A row holds a whole component, so this is a report for small ones; the labels serve large graphs.
    """
    side = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("id"))))
    return found.groupBy("label").agg(side("E").alias("edges"), side("N").alias("nodes"))
