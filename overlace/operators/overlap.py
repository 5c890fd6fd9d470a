"""The s-overlap self-join: pairs of hyperedges that share at least s nodes, and how many they share.

All physical variants give the same relation. ``join`` is the default: an equi self-join on the node with the upper triangle in
its condition, then a count with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from overlace.operators import relabel
from overlace.operators.traverse import symmetric
from overlace.plans.lineage import Ledger, drop, stage

#: Bytes that a share of the work may shuffle before compression: so many for an incidence, so many at least. The shuffle files of a share go before the
#: next one's are made, so the disk in use doesn't grow with the pairs.
SHARE_EACH, SHARE_LEAST, PAIR_BYTES = 128, 1 << 31, 36
#: Of a pair of blocks: incidences of a side, shared nodes met, and of those as many as a task holds at once.
BLOCK_MEMBERS, BLOCK_PAIRS, AT_ONCE = 1 << 21, 1 << 22, 1 << 21

VARIANTS = ("join", "explode", "candidates", "prefix", "bounded", "naive")
#: Toggles of ``counted_overlap``.
HEURISTICS = frozenset({"degree_pruning", "skip_visited", "short_circuit", "upper_triangular"})


class Counters:
    """Row counts at named places of a plan, taken while it runs."""

    def __init__(self):
        self.seen: dict[str, list[Observation]] = {}

    def at(self, name: str, df: DataFrame, measure: Column | None = None) -> DataFrame:
        """Counts rows, or takes ``measure``; of plans with the same name the counts are summed.

        A place below a shuffle that gives no rows is lost, as the rest of the plan is dropped then.
        """
        self.seen.setdefault(name, []).append(Observation())
        return df.observe(self.seen[name][-1], F.coalesce(F.count(F.lit(1)) if measure is None else measure, F.lit(0)).alias("n"))

    def get(self) -> dict[str, int]:
        """The counts, once the plans have run."""
        return {k: sum(x.get["n"] for x in v) for k, v in self.seen.items()}


def at_least(inc: DataFrame, s: int) -> DataFrame:
    """Incidences of the hyperedges with s nodes or more; others cannot take part, so they leave before the join."""
    if s <= 1:
        return inc
    big = inc.groupBy("edge").count().where(F.col("count") >= s).select("edge")
    return inc.join(big, "edge", "left_semi")


def _sets(inc: DataFrame, name: str) -> DataFrame:
    return inc.groupBy("edge").agg(F.sort_array(F.collect_set("node")).alias("nodes")).select(F.col("edge").alias(name), F.col("nodes").alias(f"{name}_nodes"))


def _pairs(inc: DataFrame, triangle: bool = True, left: DataFrame | None = None) -> DataFrame:
    """(src, dst) for each node that two hyperedges share; src from ``left`` if given."""
    a, b = (inc if left is None else left).alias("a"), inc.alias("b")
    order = F.col("a.edge") < F.col("b.edge") if triangle else F.col("a.edge") != F.col("b.edge")
    return a.join(b, (F.col("a.node") == F.col("b.node")) & order).select(F.col("a.edge").alias("src"), F.col("b.edge").alias("dst"))


def _share_of(key: str, n: int, k: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)) == k


def _shares(volume: float, incidences: int) -> int:
    return max(1, ceil(volume / max(SHARE_LEAST, SHARE_EACH * incidences)))


def _volumes(inc: DataFrame) -> tuple[int, int]:
    """Incidences, and pairs of them that share a node."""
    d = inc.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    return tuple(d.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0))).first())


def _in_shares(spark, n: int, find: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of ``find`` for each of n shares of the work, one after the other, as one staged table."""
    found = Ledger(spark)
    for k in range(n):
        found.append(find(k))
    return found.table()


def _flat(sets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hyperedges in order, their numbers of nodes, and all nodes one after the other."""
    sets = sets.combine_chunks().sort_by("edge")
    lists = sets["nodes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    return sets["edge"].to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _shared(left: pa.Table, right: pa.Table, s: int, same: bool) -> Iterator[pa.Table]:
    """(src, dst, overlap) of the pairs of a left and a right set that share s nodes or more; of each pair once if the two blocks are the ``same``.

    The right sets are listed by node; the left ones look their nodes up there, so many sets at once that about AT_ONCE members are met.
    """
    (a, an, x), (b, bn, y) = _flat(left), _flat(right)
    both = np.concatenate([x, y])
    low, high = int(both.min()), int(both.max())
    both = both - low if high - low < 4 * len(both) else np.unique(both, return_inverse=True)[1]
    x, y = both[: len(x)], both[len(x) :]
    owners = np.repeat(np.arange(len(b)), bn)[np.argsort(y, kind="stable")]
    degree = np.bincount(y, minlength=int(both.max()) + 1)
    first = np.cumsum(degree) - degree
    met, ends = degree[x], np.cumsum(an)
    upto = np.concatenate([[0], np.cumsum(met)])[ends]
    row = begin = before = 0
    while row < len(a):
        stop = max(row + 1, int(np.searchsorted(upto, before + AT_ONCE, "right")))
        n = met[begin : ends[stop - 1]]
        who = np.repeat(np.repeat(np.arange(row, stop), an[row:stop]), n)
        other = owners[np.repeat(first[x[begin : ends[stop - 1]]] - (np.cumsum(n) - n), n) + np.arange(len(who))]
        code = who * len(b) + other
        code, count = np.unique(code[who < other] if same else code, return_counts=True)
        code, count = code[count >= s], count[count >= s]
        one, two = a[code // len(b)], b[code % len(b)]
        yield pa.table({"src": np.minimum(one, two), "dst": np.maximum(one, two), "overlap": count.astype("int64")})
        row, begin, before = stop, ends[stop - 1], upto[stop - 1]


def _by_blocks(inc: DataFrame, s: int) -> DataFrame:
    """(src, dst, overlap) by pairs of blocks of hyperedges, a task for each: sets go to the pairs of their block, and no pair of sets is ever shuffled.

    A block has about BLOCK_MEMBERS incidences at most, so a task is bounded; rows of blocks are taken in shares.
    """
    inc = stage(inc)
    n, w = _volumes(inc)
    blocks = max(1, ceil(n / BLOCK_MEMBERS), ceil(sqrt(w / BLOCK_PAIRS)))
    shares = min(blocks, _shares((blocks + 1) * n * 8, n))
    sets = stage(_sets(inc, "edge").withColumnRenamed("edge_nodes", "nodes").withColumn("block", F.pmod(F.xxhash64("edge"), F.lit(blocks)).cast("int")))

    def task(key, both):
        left, right = (both.filter(pc.equal(both["side"], k)).select(["edge", "nodes"]) for k in (0, 1))
        none = pa.table({k: pa.array([], "int64") for k in ("src", "dst", "overlap")})
        return pa.concat_tables([none, *_shared(left, right, s, key[0] == key[1])]) if left.num_rows and right.num_rows else none

    def find(k: int) -> DataFrame:
        left = sets.where(F.col("block") % shares == k).select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), F.lit(0).alias("side"), "edge", "nodes")
        upto = F.filter(F.sequence(F.lit(0), "block"), lambda i: i % shares == k)
        right = sets.select(F.explode(upto).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "edge", "nodes")
        return left.unionByName(right).groupBy("i", "j").applyInArrow(task, "src long, dst long, overlap long")

    found = _in_shares(inc.sparkSession, shares, find)
    drop(inc, sets)
    return found


def _by_rarity(inc: DataFrame) -> DataFrame:
    """(edge, nodes, n): node lists in one order for all, the rarest first."""
    degree = inc.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = inc.join(degree, "node").groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("degree", "node"))).alias("r"))
    return ranked.select("edge", F.expr("transform(r, x -> x.node)").alias("nodes"), F.size("r").alias("n"))


def _bounded(inc: DataFrame, s: int, triangle: bool = True, distinct: bool = True, counters: Counters | None = None) -> DataFrame:
    """(src, dst, overlap) by prefixes with places: a pair ends as soon as s is out of its reach.

    Two hyperedges that share s nodes share one among their n - s + 1 rarest. Where such a node lies at places i and j, they share at most
    min(i, j) before it and the shorter rest behind it, which ends a pair before it is shuffled. The nodes shared up to the last such place are all
    counted then, so with the shorter rest behind it they bound the pair again, and only those rests of what is left are intersected.
    """
    at = counters.at if counters else lambda _, df: df
    sets = stage(_by_rarity(inc))
    places = sets.where(F.col("n") >= s).select("edge", "n", F.posexplode(F.expr(f"slice(nodes, 1, n - {s} + 1)")).alias("i", "node"))
    a, b = places.alias("a"), places.alias("b")
    order = F.col("a.edge") < F.col("b.edge") if triangle else F.col("a.edge") != F.col("b.edge")
    met = a.join(b, (F.col("a.node") == F.col("b.node")) & order)
    met = met.select(F.col("a.edge").alias("src"), F.col("b.edge").alias("dst"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), (F.col("a.n") - F.col("a.i") - 1).alias("ri"), (F.col("b.n") - F.col("b.i") - 1).alias("rj"))
    met = at("visited", met).where(F.least("i", "j") + 1 + F.least("ri", "rj") >= s)
    pairs = met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("i"), F.max("j").alias("j"), F.min("ri").alias("ri"), F.min("rj").alias("rj"))
    pairs = at("verified", at("counted", pairs).where(F.col("c") + F.least("ri", "rj") >= s))
    side = lambda k: sets.select(F.col("edge").alias(k), F.col("nodes").alias(f"{k}_nodes"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    rest = F.size(F.array_intersect(F.expr("slice(src_nodes, i + 2, ri)"), F.expr("slice(dst_nodes, j + 2, rj)")))
    return both.select("src", "dst", (F.col("c") + rest).cast("long").alias("overlap")).where(F.col("overlap") >= s)


def _listed(inc: DataFrame, s: int, prefix: bool = True, rest: bool = False, triangle: bool = True, counters: Counters | None = None) -> DataFrame:
    """(src, dst, overlap) by rows (edge, node, list) that meet at a node and compare their lists there, so only pairs that share s nodes are shuffled.

    ``prefix``: rows of the size - s + 1 rarest nodes alone. A list has all nodes of the hyperedge, or with ``rest`` those behind its node in the order of
    rarity: at the first node that two hyperedges share the rests hold all others, at later ones fewer, so the largest count is the overlap, and rests too
    short for s are not compared. Lists go with nodes, in shares of these.
    """
    at = counters.at if counters else lambda _, df: df
    sets = stage(_by_rarity(inc))
    places = f"least(n, n - {s} + 1)" if prefix else "n"
    some = sets.where(f"{places} > 0")
    members, n, listed = some.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr(places)), F.lit(0)), F.coalesce(F.sum(F.expr(f"{places} * cast(n as long)")), F.lit(0))).first()
    shares = _shares(n * PAIR_BYTES + listed * (4 if rest else 8), members)
    behind = "slice(nodes, x.i + 2, n)" if rest else "nodes"

    def find(k: int) -> DataFrame:
        held = f"filter(transform(slice(nodes, 1, {places}), (v, i) -> named_struct('node', v, 'i', i)), x -> pmod(xxhash64(x.node), {shares}) = {k})"
        mine = some.select("edge", F.expr(f"inline(transform({held}, x -> named_struct('node', x.node, 'list', {behind})))"))
        a, b = mine.alias("a"), mine.alias("b")
        order = F.col("a.edge") < F.col("b.edge") if triangle else F.col("a.edge") != F.col("b.edge")
        met = a.join(b, (F.col("a.node") == F.col("b.node")) & order).select(F.col("a.edge").alias("src"), F.col("b.edge").alias("dst"), F.col("a.list").alias("x"), F.col("b.list").alias("y"))
        met = at("verified", at("visited", met))
        met = met.where(1 + F.least(F.size("x"), F.size("y")) >= s) if rest else met
        return met.select("src", "dst", (F.size(F.array_intersect("x", "y")) + int(rest)).cast("long").alias("overlap")).where(F.col("overlap") >= s)

    met = _in_shares(inc.sparkSession, shares, find)
    found = stage(met.groupBy("src", "dst").agg(F.max("overlap").alias("overlap")))
    drop(sets, met)
    return found


def overlap(inc: DataFrame, s: int = 1, variant: str = "join", prune: bool = True) -> DataFrame:
    """(src, dst, overlap) with src < dst and overlap >= s; ``inc`` is (edge, node).

    A node of degree k makes k(k-1)/2 rows in ``join``; AQE splits such a node's partition. ``prefix`` compares hyperedges only
    where they share one of their size - s + 1 rarest nodes, then counts exactly; use it for hub nodes and s > 1. ``bounded`` does so too, and compares
    only the nodes behind a shared one, where enough of them are left. ``candidates`` meets blocks of hyperedges in pairs and counts what their sets share there; ``explode`` pairs within a
    node's list; ``naive`` compares all pairs of blocks in the same way, for s < 1 all pairs of hyperedges, and serves tests only.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}: one of {', '.join(VARIANTS)}")
    inc = at_least(inc, s) if prune else inc
    if variant == "join":
        return _pairs(inc).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= s)
    if variant == "explode":
        lists = inc.groupBy("node").agg(F.sort_array(F.collect_list("edge")).alias("edges")).where(F.size("edges") > 1)
        left = lists.select("edges", F.posexplode("edges").alias("i", "src"))
        right = left.select("src", F.explode(F.expr("slice(edges, i + 2, size(edges))")).alias("dst")).where("src < dst")
        return right.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= s)
    if variant == "candidates":
        return _by_blocks(inc, s)
    if variant == "prefix":
        return _listed(inc, s)
    if variant == "bounded":
        return _listed(inc, s, rest=True)
    if s > 0:
        return _by_blocks(inc, s)
    src, dst = _sets(inc, "src"), _sets(inc, "dst")  # pairs that share nothing count too
    both = src.join(dst, F.col("src") < F.col("dst"))
    return both.select("src", "dst", F.size(F.array_intersect("src_nodes", "dst_nodes")).cast("long").alias("overlap")).where(F.col("overlap") >= s)


def counted_overlap(inc: DataFrame, s: int, heuristics: frozenset[str] = HEURISTICS) -> tuple[DataFrame, dict[str, int]]:
    """The overlap as a staged table, and what its run did: rows visited, pairs counted, pairs verified, edges made.

    The toggles change the work and not the result. degree_pruning: hyperedges under s nodes leave first. upper_triangular: a pair is visited in
    one direction. skip_visited: a pair that is met again is verified once. short_circuit: pairs meet at rare nodes and end once s is out of reach.
    """
    if heuristics - HEURISTICS:
        raise ValueError(f"unknown heuristics: {', '.join(sorted(heuristics - HEURISTICS))}")
    counters, triangle = Counters(), "upper_triangular" in heuristics
    inc = at_least(inc, s) if "degree_pruning" in heuristics else inc
    if "short_circuit" in heuristics:
        out = _bounded(inc, s, triangle, counters=counters)
    elif "skip_visited" in heuristics:
        inc = stage(inc)
        n, w = _volumes(inc)
        shares = _shares(w * PAIR_BYTES * (1 if triangle else 2), n)

        def find(k: int) -> DataFrame:
            pairs = _pairs(inc, triangle, inc if shares == 1 else inc.where(_share_of("edge", shares, k)))
            counted = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("overlap"))
            return counters.at("visited", counters.at("counted", counted), F.sum("overlap")).where(F.col("overlap") >= s)

        out = _in_shares(inc.sparkSession, shares, find)
        drop(inc)
    else:
        out = _listed(inc, s, prefix=False, triangle=triangle, counters=counters)
    held, out = out, stage(counters.at("edges", out.where("src < dst")))
    drop(held)
    return out, counters.get()


def frontier_overlap(graph: DataFrame, front: DataFrame, s: int) -> DataFrame:
    """(src, dst, overlap): members of the work list ``front`` (id) with the later ids that share s neighbours or more.

    ``graph`` is (src, dst) in one id space, such as an adjoined and relabelled one, so that ids are places in a permutation. Only the
    work list is expanded, over its neighbours to vertices of its own kind; a list of one side's all ids gives the whole overlap of that side.
    """
    both = stage(symmetric(graph.select("src", "dst")).distinct())
    large = both.groupBy(F.col("src").alias("id")).count().where(F.col("count") >= s).select("id")
    work = front.select("id").distinct().join(large, "id", "left_semi")
    one = stage(both.join(work, F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("via")))
    two = both.select(F.col("src").alias("via"), F.col("dst").alias("b")).join(large.select(F.col("id").alias("b")), "b", "left_semi")
    two = stage(two.join(one.select("via").distinct(), "via", "left_semi"))
    number = lambda side, name: side.groupBy("via").agg(F.count(F.lit(1)).alias(name))
    n, w = number(one, "n").join(number(two, "m"), "via").agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.expr("n * m div 2")), F.lit(0))).first()
    shares = _shares(w * PAIR_BYTES, n)

    def find(k: int) -> DataFrame:
        met = (one if shares == 1 else one.where(_share_of("a", shares, k))).join(two, "via").where("a < b")
        return met.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= s)

    found = _in_shares(graph.sparkSession, shares, find)
    drop(both, one, two)
    return found


def adjoined_overlap(inc: DataFrame, s: int, descending: bool = False, work: DataFrame | None = None) -> DataFrame:
    """(src, dst, overlap) with src < dst, by a work list over the adjoined graph whose ids are places in order of degree.

    ``work`` is (edge), the hyperedges to expand against those of later places; all unless given. Results have the ids of ``inc`` again.
    """
    inc = stage(inc.select("edge", "node").distinct())
    shift = relabel.offsets(inc)
    graph = relabel.adjoin(inc, shift)
    perm = stage(relabel.degree_permutation(symmetric(graph).withColumnsRenamed({"src": "edge", "dst": "node"}), "edge", descending))
    front = relabel.frontier(perm, shift)
    if work is not None:
        chosen = perm.join(work.select((F.col("edge") + shift[0]).alias("old_id")), "old_id", "left_semi")
        front = front.join(chosen.select(F.col("new_id").alias("id")), "id", "left_semi")
    found = frontier_overlap(relabel.renamed(graph, perm), front, s)
    old = lambda k: perm.select(F.col("new_id").alias(k), (F.col("old_id") - shift[0]).alias(f"_{k}"))
    out = found.join(old("src"), "src").join(old("dst"), "dst")
    out = stage(out.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"), "overlap"))
    drop(inc, perm, found)
    return out


def wedges(inc: DataFrame) -> DataFrame:
    """One row (wedges): pairs of incidences that share a node, the work of the self-join."""
    d = inc.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    return d.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).cast("long").alias("wedges"))
