"""Searches, components, scores and bounded overlaps against plain Python, and the work that they do."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from overlace.model import Hypergraph, LineGraph
from overlace.operators import centrality, components, paths, relabel, traverse
from overlace.operators.overlap import HEURISTICS, adjoined_overlap, counted_overlap, overlap
from overlace.plans import lineage


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def table(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture(scope="module")
def net():
    """Weights of the edges of a graph of some components."""
    random.seed(1)
    return {(min(a, b), max(a, b)): random.randint(0, 9) for a, b in ((random.randrange(16), random.randrange(16)) for _ in range(17)) if a != b}


def frame(spark, net, kind="long", shift=0):
    return spark.createDataFrame([(a, b, w + shift) for (a, b), w in net.items()], f"src long, dst long, overlap {kind}")


def distances(net, hops=False):
    near: dict = {}
    for (a, b), w in net.items():
        near.setdefault(a, []).append((b, 1 if hops else w))
        near.setdefault(b, []).append((a, 1 if hops else w))
    out = {}
    for s in near:
        heap, seen = [(0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v not in seen:
                seen.add(v)
                out[s, v] = d
                for u, w in near[v]:
                    heapq.heappush(heap, (d + w, u))
    return out


def test_delta_stepping(spark, net):
    """Buckets wider and narrower than the weights, zero weights, doubles, all sources at once; a source without an edge."""
    want = distances(net)
    source = min(a for a, _ in want)
    assert table(paths.weighted_distances(frame(spark, net), source, delta=4)) == {v: d for (s, v), d in want.items() if s == source}
    half = {k: w + 0.5 for k, w in net.items()}
    assert {(r.root, r.id): r.distance for r in paths.delta_stepping(frame(spark, half, "double"), delta=2.5).collect()} == distances(half)
    assert rows(paths.weighted_distances(frame(spark, net), 999)) == [(999, 0)]
    assert paths.delta_stepping(frame(spark, net).limit(0)).count() == 0
    with pytest.raises(ValueError):
        paths.delta_stepping(frame(spark, net, shift=-5))


def test_delta_stepping_writes_less_on_a_chain(spark):
    chain = spark.range(14).selectExpr("id as src", "id + 1 as dst", "3L as overlap")
    one, all_of_it = {}, {}
    assert rows(paths.weighted_distances(chain, 0, delta=3, report=one)) == rows(paths.relaxed_distances(chain, 0, report=all_of_it))
    assert one["buckets"] == 15 and one["rows"] <= 32 < 100 < all_of_it["rows"]


def test_weighted_graphs_agree_with_themselves(spark):
    g = LineGraph.from_arrays(spark, [0, 1, 0], [1, 2, 2], [1, 1, 10])
    assert g.s_distance(0, 2) == 2 and g.s_diameter() == (2, True)
    assert table(g.s_eccentricity()) == {0: 2, 1: 1, 2: 2} and table(g.s_closeness_centrality()) == {0: 2 / 3, 1: 1.0, 2: 2 / 3} and table(g.s_harmonic_closeness_centrality()) == {0: 1.5, 1: 2.0, 2: 1.5}


def test_hop_scores_by_words_and_bounds(spark, net):
    edges = frame(spark, net)
    hops = distances(net, hops=True)
    ids = {a for a, _ in hops}
    far = {v: max(d for (s, _), d in hops.items() if s == v) for v in ids}
    flat = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df)]
    assert flat(centrality.word_scores(edges)) == flat(centrality.distance_scores(edges))
    found, words = paths.word_levels(edges)
    assert found.rows[0] == len(ids) and sum(found.rows) < 0.6 * len(hops)
    assert table(centrality.eccentricities(edges, 2).select("id", "farthest")) == far
    many = LineGraph(spark.range(1, 121).selectExpr("id div 3 as src", "id as dst"))
    report: dict = {}
    assert many.s_diameter(report=report) == many.s_diameter(bounds=False) and report["searches"] <= 40 and report["vertices"] == 121


def test_betweenness_in_batches(spark, net):
    edges = frame(spark, net)
    report: dict = {}
    one, some = centrality.betweenness(edges, 16, False), centrality.betweenness(edges, 16, False, batch=6, report=report)
    assert report["batches"] > 1 and {k: round(v, 9) for k, v in table(one).items()} == {k: round(v, 9) for k, v in table(some).items()}
    assert rows(centrality.verify_betweenness(edges, some)) == [(0, 0, 0)]
    wrong = some.where("id > 3").withColumn("value", F.col("value") + (F.col("id") == max(v for e in net for v in e)).cast("int"))
    assert rows(centrality.verify_betweenness(edges, wrong))[0][0] == 1 and rows(centrality.verify_betweenness(edges, wrong))[0][2] == len({v for e in net for v in e if v <= 3})


def test_searches_keep_few_tables(spark):
    """A long chain leaves one table a search, and no more than a few while it runs."""
    chain = spark.range(12).selectExpr("id as edge", "id as node").union(spark.range(12).selectExpr("id as edge", "id + 1 as node"))
    before, steps = len(lineage.staged()), []
    found = traverse.hyper_bfs(chain, 0, steps=steps)
    assert len(lineage.staged()) == before + 1 and len(steps) == 24
    assert found.agg(F.max("depth")).first()[0] == 23 and rows(traverse.verify_hyper_bfs(chain, found, 0)) == [(0, 0, 0, 0)]
    lineage.drop(found)
    assert paths.shortest_path(chain.selectExpr("edge as src", "node as dst").where("src <> dst"), 0, 6).first().path == list(range(7))
    assert len(lineage.staged()) <= before + 1


@pytest.mark.parametrize("alpha, beta, ways", [(0, 18, {"down"}), (15, 18, {"down", "up"}), (float("inf"), float("inf"), {"up"})])
def test_bottom_up_steps(spark, alpha, beta, ways):
    random.seed(4)
    inc = spark.createDataFrame([(random.randrange(40), random.randrange(50)) for _ in range(200)], "edge long, node long").distinct().cache()
    source, steps = inc.agg(F.min("edge")).first()[0], []
    found = traverse.hyper_bfs(inc, source, alpha, beta, steps)
    assert {s["way"] for s in steps} == ways and rows(traverse.verify_hyper_bfs(inc, found, source)) == [(0, 0, 0, 0)]
    assert rows(found) == rows(traverse.hyper_bfs(inc, source, 0))
    assert traverse.hyper_bfs(inc, 999).count() == 0


def test_components_by_other_ways(spark, net):
    """A giant component, small ones beside it, and negative ids on either side."""
    random.seed(7)
    giant = spark.createDataFrame([(random.randrange(300), random.randrange(300)) for _ in range(1500)] + [(400, 401), (401, 402), (405, 405), (None, 3)], "src long, dst long")
    report: dict = {}
    assert rows(components.afforest(giant, report=report)) == rows(components.connected_components(giant))
    assert report["linked"] < report["edges"] / 2 and report["left"] < report["edges"] / 20
    edges = frame(spark, net)
    assert rows(components.afforest(edges, sample=4)) == rows(components.connected_components(edges))
    assert components.afforest(giant.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, -5), (2, -5), (3, 7), (-4, 7), (-9, 8)], "edge long, node long")
    by_edge = [("E", -9, -9), ("E", -4, -4), ("E", 1, 1), ("E", 2, 1), ("E", 3, -4), ("N", -5, 1), ("N", 7, -4), ("N", 8, -9)]
    active: list = []
    assert rows(components.hyper_components(odd)) == by_edge == rows(components.propagate_labels(odd, active=active))
    assert active == [3, 2, 0] and rows(Hypergraph(odd).connected_components("node", "labels")) == rows(Hypergraph(odd).connected_components("node", "afforest"))
    with pytest.raises(ValueError):
        relabel.offsets(odd)


def test_overlap_by_bounds_work_lists_and_toggles(spark):
    random.seed(9)
    inc = spark.createDataFrame([(random.randrange(60), min(random.randrange(40), random.randrange(40))) for _ in range(500)], "edge long, node long").distinct().cache()
    size = table(inc.groupBy("edge").count())
    for s in (1, 3, 5):
        want = rows(overlap(inc, s, "naive"))
        assert rows(overlap(inc, s, "bounded")) == want == rows(adjoined_overlap(inc, s)) == rows(adjoined_overlap(inc, s, descending=True))
    work = inc.where("edge % 2 = 0").select("edge")
    first = lambda a, b: a if (size[a], a) < (size[b], b) else b
    assert rows(adjoined_overlap(inc, 3, work=work)) == [r for r in rows(overlap(inc, 3)) if first(*r[:2]) % 2 == 0]
    want, seen = rows(overlap(inc, 4)), {}
    for off in ((), ("short_circuit",), ("upper_triangular",), ("short_circuit", "skip_visited", "degree_pruning")):
        found, seen[off] = counted_overlap(inc, 4, HEURISTICS - set(off))
        assert rows(found) == want and seen[off]["edges"] == len(want), off
    assert seen[()]["verified"] <= seen[()]["counted"] < seen[("short_circuit",)]["counted"] and seen[("upper_triangular",)]["visited"] == 2 * seen[()]["visited"]
    with pytest.raises(ValueError):
        counted_overlap(inc, 2, frozenset({"luck"}))


def test_classes_leave_few_tables(spark):
    """Toplexes and classes drop what they staged but for their results."""
    inc = spark.createDataFrame([(e, n) for e in range(12) for n in range(e % 4 + 1)] + [(20, 9), (21, 9), (21, 3)], "edge long, node long")
    before = len(lineage.staged())
    tops = Hypergraph(inc).toplexes()
    assert len(lineage.staged()) == before + 1 and rows(tops) == [(3,), (21,)]
    assert rows(Hypergraph(inc).toplexes("last")) == [(11,), (21,)]
    classes = Hypergraph(inc).collapse_edges()
    assert {tuple(r.members) for r in classes.collect()} == {(0, 4, 8), (1, 5, 9), (2, 6, 10), (3, 7, 11), (20,), (21,)} and len(lineage.staged()) == before + 3
