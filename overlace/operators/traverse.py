"""Breadth-first search, on hypergraphs and on line graphs, with deterministic parents.

Levels are parts of one staged table, each compared with the few parts that its vertices could be in already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.plans.lineage import Ledger, drop, stage


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select("dst", "src", *rest))


def _with_degrees(inc: DataFrame) -> DataFrame:
    """(edge, node, de, dn): incidences with the sizes of both their ends."""
    inc = inc.select("edge", "node").distinct()
    size = lambda k, name: inc.groupBy(k).agg(F.count(F.lit(1)).alias(name))
    return inc.join(size("edge", "de"), "edge").join(size("node", "dn"), "node").select("edge", "node", "de", "dn")


def hyper_bfs(inc: DataFrame, source: int, alpha: float = 15.0, beta: float = 18.0, steps: list[dict] | None = None) -> DataFrame:
    """(kind, id, depth, parent) of what a hyperedge reaches; 'E' at even depths, 'N' at odd ones.

    The source is its own parent; any other parent is the smallest id of the level before. A step goes top-down, from the frontier's incidences
    to their other ends, or bottom-up, from the incidences of what is not yet reached to the frontier. It turns bottom-up once the frontier's
    incidences exceed those of the unreached by 1 / ``alpha`` (never for 0), and back once the frontier has less than 1 / ``beta`` of its side. Top-down a
    level is compared with the one before the last alone, as in a bipartite graph neighbours of a level lie in the next or the one before;
    bottom-up the unreached incidences are a staged table that shrinks, and nothing is compared afterwards. ``steps`` gets a dict for each step.
    """
    adj = stage(_with_degrees(inc))
    all_rows, n_e, n_n = adj.agg(F.count(F.lit(1)), F.countDistinct("edge"), F.countDistinct("node")).first()
    sides = {"edge": n_e, "node": n_n}
    found = Ledger(inc.sparkSession)
    start = adj.where(F.col("edge") == source).limit(1).select(F.lit("E").alias("kind"), F.col("edge").alias("id"), F.lit(0).cast("long").alias("depth"), F.col("edge").alias("parent"), F.col("de").alias("degree"))
    total = F.coalesce(F.sum("degree"), F.lit(0))
    now = found.append(start, degree=total)
    reached = {"edge": now["degree"], "node": 0}  # incidences of what was reached on each side
    rest: dict[str, DataFrame] = {}
    upward = False
    while now["n"]:
        depth = len(found)
        at, to, kind = ("edge", "node", "N") if depth % 2 else ("node", "edge", "E")
        unreached = all_rows - reached[to]
        upward = now["n"] * beta >= sides[at] if upward else now["degree"] * alpha > unreached
        front = found.last().select(F.col("id").alias(at))
        degree = F.first("dn" if to == "node" else "de").alias("degree")
        if upward:
            held = rest.get(to)
            own = found.table().where(F.col("kind") == kind).select(F.col("id").alias(to))
            rest[to] = stage((adj if held is None else held).join(own, to, "left_anti"))
            drop(held)
            near = rest[to].join(front, at)
        else:
            near = adj.join(front, at)
        near = near.groupBy(F.col(to).alias("id")).agg(F.min(at).alias("parent"), degree)
        if not upward and depth > 1:
            near = near.join(found.part(depth - 2).select("id"), "id", "left_anti")
        if steps is not None:
            steps.append({"depth": depth, "way": "up" if upward else "down", "frontier": now["n"], "incidences": unreached if upward else now["degree"]})
        now = found.append(near.select(F.lit(kind).alias("kind"), "id", F.lit(depth).cast("long").alias("depth"), "parent", "degree"), degree=total)
        reached[to] += now["degree"]
    drop(adj, *rest.values())
    out = found.table().drop("degree")
    out._staged_at = found._staged_at
    return out


def verify_hyper_bfs(inc: DataFrame, found: DataFrame, source: int) -> DataFrame:
    """One row of violation counts, all zero for a breadth-first tree of ``inc`` from ``source``.

    bad_source: the source is missing or not its own parent at depth 0. bad_parent: a parent that is not incident or not one
    level above. bad_step: incident pairs whose depths differ by more than 1. bad_reach: incidences with one
    end reached.
    """
    e = found.where("kind = 'E'").select(F.col("id").alias("edge"), F.col("depth").alias("de"), F.col("parent").alias("pe"))
    n = found.where("kind = 'N'").select(F.col("id").alias("node"), F.col("depth").alias("dn"), F.col("parent").alias("pn"))
    both = inc.select("edge", "node").distinct().join(e, "edge", "left").join(n, "node", "left")
    a = both.agg(F.count_if(F.col("de").isNull() != F.col("dn").isNull()).alias("bad_reach"), F.count_if(F.abs(F.col("de") - F.col("dn")) != 1).alias("bad_step"))
    good_e = both.where("pe = node and dn = de - 1").select("edge").distinct().count()
    good_n = both.where("pn = edge and de = dn - 1").select("node").distinct().count()
    root = found.where((F.col("kind") == "E") & (F.col("id") == source) & (F.col("depth") == 0) & (F.col("parent") == source)).count()
    return a.select(F.lit(abs(1 - root)).cast("long").alias("bad_source"), F.lit(found.count() - root - good_e - good_n).cast("long").alias("bad_parent"), "bad_step", "bad_reach")


def graph_bfs(edges: DataFrame, source: int) -> DataFrame:
    """(id, depth, parent) of what a vertex of an undirected graph (src, dst) reaches; the smallest parent of the level before."""
    adj = symmetric(edges.select("src", "dst")).distinct().persist()
    found = Ledger(edges.sparkSession)
    n = found.append(edges.sparkSession.createDataFrame([(source, 0, source)], "id long, depth long, parent long"))["n"]
    while n:
        near = found.last().select(F.col("id").alias("src")).join(adj, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        n = found.append(near.join(found.last(2).select("id"), "id", "left_anti").select("id", F.lit(len(found)).cast("long").alias("depth"), "parent"))["n"]
    adj.unpersist()
    return found.table()
