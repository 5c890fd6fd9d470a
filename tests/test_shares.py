"""Overlaps whose work is taken in blocks and shares: the same rows, and little shuffled."""

import random

import pytest

from overlace.operators import overlap as made
from overlace.operators.overlap import HEURISTICS, adjoined_overlap, counted_overlap, overlap
from overlace.plans.lineage import Ledger


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sets(spark, n_edges, size, n_nodes, seed=3):
    random.seed(seed)
    return spark.createDataFrame([(e * 7 - 50, n * 3 - 90) for e in range(n_edges) for n in random.sample(range(n_nodes), size)], "edge long, node long").cache()


def shuffled(spark, run):
    """Bytes written for shuffles while ``run`` runs."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    run()
    return total() - before


@pytest.fixture
def small_shares(monkeypatch):
    """Blocks and shares so small that even tests have several."""
    for name, value in {"SHARE_EACH": 20, "SHARE_LEAST": 20_000, "BLOCK_MEMBERS": 100, "BLOCK_PAIRS": 100, "AT_ONCE": 50}.items():
        monkeypatch.setattr(made, name, value)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("variant", ["candidates", "naive"])
def test_blocks_give_the_pairs(spark, small_shares, variant):
    inc = sets(spark, 40, 12, 50)
    assert rows(overlap(inc, 4, variant)) == rows(overlap(inc, 4)) and rows(overlap(inc.limit(0), 4, variant)) == []


def test_candidates_carry_no_sets(spark, no_broadcast):
    """120 hyperedges of 300 nodes are 0.3 MB of members, their 7140 pairs with both sets 34 MB before compression."""
    inc = sets(spark, 120, 300, 400)
    inc.count()
    assert shuffled(spark, lambda: overlap(inc, 200, "candidates").count()) < 1e6


def test_naive_has_no_nested_loop(spark):
    plan = overlap(sets(spark, 10, 5, 20), 2, "naive")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_toggles_count_the_same_in_shares(spark, small_shares):
    inc = sets(spark, 40, 12, 50)
    pairs = [(a, b) for a in inc.collect() for b in inc.collect() if a.node == b.node and a.edge < b.edge]
    n, distinct, want = len(pairs), len({(a.edge, b.edge) for a, b in pairs}), rows(overlap(inc, 4))
    for off, visited, compared in (((), n, distinct), (("degree_pruning",), n, distinct), (("upper_triangular",), 2 * n, 2 * distinct), (("skip_visited",), n, n)):
        found, got = counted_overlap(inc, 4, HEURISTICS - {"short_circuit", *off})
        assert rows(found) == want and (got["visited"], got.get("counted", got.get("verified")), got["edges"]) == (visited, compared, len(want)), off


def test_pairs_met_again_carry_no_sets_in_shuffles(spark, no_broadcast):
    """60 hyperedges of 200 among 220 nodes: 1770 pairs that meet some 180 times each, so 320 000 rows with both sets before, 12 000 with one now."""
    inc = sets(spark, 60, 200, 220)
    inc.count()
    assert shuffled(spark, lambda: counted_overlap(inc, 150, HEURISTICS - {"short_circuit", "skip_visited"})) < 15e6


@pytest.mark.parametrize("variant", ["bounded", "prefix"])
def test_lists_meet_in_shares(spark, small_shares, variant):
    inc = sets(spark, 40, 12, 50)
    assert rows(overlap(inc, 4, variant)) == rows(overlap(inc, 4)) and rows(overlap(inc, 12, variant)) == []


@pytest.mark.parametrize("variant", ["bounded", "prefix"])
def test_lists_shuffle_no_pairs(spark, no_broadcast, variant):
    """300 hyperedges of 6 among 40 nodes: nearly all of the 44 850 pairs meet, and few share 4 nodes."""
    inc = sets(spark, 300, 6, 40)
    inc.count()
    assert shuffled(spark, lambda: overlap(inc, 4, variant).count()) < 3e5


@pytest.mark.parametrize("descending", [False, True])
def test_work_lists_go_in_shares(spark, small_shares, monkeypatch, descending):
    parts, append = [], Ledger.append
    monkeypatch.setattr(Ledger, "append", lambda self, df, **m: parts.append(append(self, df, **m)) or parts[-1])
    inc = sets(spark, 40, 12, 50).selectExpr("edge + 50 as edge", "node + 90 as node")
    assert rows(adjoined_overlap(inc, 4, descending)) == rows(overlap(inc, 4)) and len(parts) > 1
