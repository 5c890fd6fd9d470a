"""Hand fixtures with golden values, and agreement of the physical variants."""

import pytest
from pyspark.sql import functions as F

from overlace.__main__ import main
from overlace.functions import generators
from overlace.model import Hypergraph, LineGraph
from overlace.operators import components, relabel, stats, traverse
from overlace.operators.overlap import VARIANTS, overlap
from overlace.sources import readers, writers

# Public test inputs, 11 hyperedges over 7 nodes (and the small one of three hyperedges below); results are this repository's own.
ROWS = [0, 1, 2, 5, 9, 10, 0, 1, 2, 3, 4, 5, 0, 1, 3, 5, 6, 7, 1, 2, 5, 0, 1, 2, 3, 5, 4, 8, 5]
COLS = [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 5, 5, 6]
GAPS = ([0, 0, 1, 2, 2, 2, 3, 3, 5, 6, 6, 6, 7], [0, 1, 1, 2, 3, 4, 2, 3, 6, 2, 3, 4, 8])


@pytest.fixture(scope="module")
def big(spark):
    h = Hypergraph.from_arrays(spark, ROWS, COLS)
    h.inc = h.inc.cache()
    return h


@pytest.fixture(scope="module")
def gaps(spark):
    return Hypergraph.from_arrays(spark, *GAPS)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def table(df):
    return {r[0]: r[1] for r in df.collect()}


def test_sizes_and_degrees(big, gaps):
    assert table(big.edge_size_dist()) == dict(enumerate([4, 5, 4, 3, 2, 6, 1, 1, 1, 1, 1]))
    assert table(big.node_size_dist()) == dict(enumerate([6, 6, 6, 3, 5, 2, 1]))
    assert (big.size(5), big.dim(5), big.degree(3), big.size(99), big.dim(99), big.degree(1, 2, 4)) == (6, 5, 3, -1, -1, 4)
    assert (big.number_of_edges(), big.number_of_nodes()) == (11, 7)
    dense = Hypergraph(gaps.inc, universe="dense")
    assert dense.number_of_edges() == 8 and dense.size(4) == 0 and table(dense.edge_size_dist())[4] == 0 and gaps.size(4) == -1


def test_line_graphs(big):
    assert rows(big.s_linegraph(2).edges) == [(0, 1, 4), (0, 2, 3), (0, 3, 3), (0, 5, 4), (1, 2, 4), (1, 3, 3), (1, 5, 5), (2, 3, 2), (2, 5, 4), (3, 5, 3)]
    assert big.s_linegraph(1).edges.count() == 34
    assert big.s_linegraph(3).edges.count() == 9
    assert rows(big.s_linegraph(2, edges=False).edges) == [(0, 1, 4), (0, 2, 3), (0, 3, 3), (0, 4, 4), (1, 2, 4), (1, 3, 3), (1, 4, 5), (2, 3, 2), (2, 4, 4), (3, 4, 3)]
    one, two = big.s_linegraphs([2, 3])
    assert (one.edges.count(), two.edges.count()) == (10, 9)


@pytest.mark.parametrize("s", [1, 2, 3])
def test_variants_agree(big, s):
    want = rows(overlap(big.inc, s, "naive", prune=False))
    for v in VARIANTS:
        assert rows(overlap(big.inc, s, v)) == want, v


def test_classes(spark, big, gaps):
    big_classes = {r.rep: r.members for r in big.collapse_edges().collect()}
    assert {k: v for k, v in big_classes.items() if len(v) > 1} == {6: [6, 7], 9: [9, 10]}
    assert rows(big.toplexes()) == [(4,), (5,)] == rows(big.toplexes("last"))
    assert rows(gaps.toplexes()) == [(0,), (2,), (5,), (7,)] and rows(gaps.toplexes("last")) == [(0,), (5,), (6,), (7,)]
    assert rows(gaps.singletons()) == [(5,), (7,)] and rows(big.singletons()) == []
    three = Hypergraph.from_arrays(spark, [0, 0, 0, 1, 1, 1, 2], [0, 1, 2, 0, 1, 2, 0])
    assert rows(three.collapse_nodes_and_edges(), "rep", "members") == [(0, [0, 1]), (2, [2])]
    assert rows(three.collapse_nodes(), "rep", "members") == [(0, [0]), (1, [1, 2])]


def test_scores(big):
    g = big.s_linegraph(1)
    assert {k: round(v, 6) for k, v in table(g.s_closeness_centrality()).items()} == {0: 0.909091, 1: 0.909091, 5: 0.909091, 2: 0.769231, 3: 0.769231, 4: 0.714286, 6: 0.625, 7: 0.625, 9: 0.625, 10: 0.625, 8: 0.434783}
    assert round(table(g.s_harmonic_closeness_centrality())[8], 6) == 4.833333
    assert table(g.s_eccentricity()) == {i: 2 if i < 6 else 3 for i in range(11)} and g.s_diameter() == (3, True)
    raw = table(g.s_betweenness_centrality(normalized=False))
    assert {k: round(v, 6) for k, v in raw.items()} == {0: 8.666667, 1: 8.666667, 5: 8.666667, 2: 3, 3: 3, 4: 18, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0}
    assert g.s_path(8, 9) == [8, 4, 0, 9] and g.s_distance(1, 2) == 1 and g.s_distance(8, 9) == 3
    assert table(big.s_linegraph(2).s_sssp(0)) == {0: 0, 1: 4, 2: 3, 3: 3, 5: 4}


def test_components_and_searches(big, gaps):
    assert rows(gaps.connected_components()) == [("E", i, c) for i, c in ((0, 0), (1, 0), (2, 2), (3, 2), (5, 5), (6, 2), (7, 7))] + [("N", i, c) for i, c in ((0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (6, 5), (8, 7))]
    found = big.bfs(0)
    parents = {(r.kind, r.id): (r.depth, r.parent) for r in found.collect()}
    assert [parents["E", i] for i in range(11)] == [(0, 0), (2, 0), (2, 0), (2, 1), (2, 1), (2, 0), (2, 2), (2, 2), (4, 5), (2, 0), (2, 0)]
    assert [parents["N", i] for i in range(7)] == [(1, 0), (1, 0), (1, 0), (3, 1), (1, 0), (3, 4), (3, 5)]
    assert rows(traverse.verify_hyper_bfs(big.inc, found, 0)) == [(0, 0, 0, 0)]
    broken = found.withColumn("depth", F.when((F.col("kind") == "E") & (F.col("id") == 8), 2).otherwise(F.col("depth")))
    assert rows(traverse.verify_hyper_bfs(big.inc, broken, 0)) != [(0, 0, 0, 0)]
    two = big.s_linegraph(2)
    assert rows(two.s_connected_components()) == [(0, [0, 1, 2, 3, 5])] and rows(two.get_singletons()) == [(i,) for i in (4, 6, 7, 8, 9, 10)]
    assert two.is_s_connected() and not two.is_s_connected(strict=True)


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}
    empty = chain.limit(0)
    assert components.connected_components(empty).count() == 0


def test_relabelling(big):
    perm = table(relabel.degree_permutation(big.inc, "edge", descending=True))
    assert [perm[i] for i in (5, 1, 0, 2, 3)] == [0, 1, 2, 3, 4]
    assert sorted(table(stats.sizes(relabel.relabel_by_degree(big.inc))).values()) == sorted([4, 5, 4, 3, 2, 6, 1, 1, 1, 1, 1])
    g, m = relabel.squeeze(big.s_linegraph(2).edges)
    assert table(m) == {0: 0, 1: 1, 2: 2, 3: 3, 5: 4} and g.agg(F.max("dst")).first()[0] == 4
    split = relabel.run_on_adjoin(big.inc, lambda e: e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    assert split.where("kind = 'E'").count() == 11 and split.where("kind = 'N'").count() == 7


def test_edge_list_graph(spark):
    g = LineGraph(spark.createDataFrame([(3, 1), (1, 3), (4, 3), (2, 2)], "src long, dst long"))
    assert rows(g.edges) == [(1, 3, 1), (3, 4, 1)] and table(g.s_degrees()) == {0: 0, 1: 1, 2: 0, 3: 2, 4: 1}


def test_weights(spark):
    h = Hypergraph.from_arrays(spark, [0, 0, 1, 1, 2], [0, 1, 0, 1, 0], [0.5, 1.5, 2.5, 3.0, 1.0])
    assert rows(h.weighted) == [(0, 0, 0.5), (0, 1, 1.5), (1, 0, 2.5), (1, 1, 3.0), (2, 0, 1.0)]
    assert rows(Hypergraph(h.weighted.unionByName(h.weighted.withColumn("weight", F.lit(1.25)))).weighted) == [(0, 0, 1.25), (0, 1, 1.5), (1, 0, 2.5), (1, 1, 3.0), (2, 0, 1.25)]
    assert rows(Hypergraph.from_arrays(spark, [0, 1], [0, 0]).weighted) == [(0, 0, 0), (1, 0, 0)]
    small = Hypergraph(h.weighted, collapse=True)
    assert rows(small.weighted) == [(0, 0, 0.0), (0, 1, 0.0), (2, 0, 0.0)] and rows(small.inc) == [(0, 0), (0, 1), (2, 0)]
    with pytest.raises(ValueError):
        Hypergraph.from_arrays(spark, [0, 1], [0])
    assert rows(h.edge_neighbor_counts()) == [(0, 1, 2), (0, 2, 1), (1, 2, 1)] and rows(h.node_neighbor_counts()) == [(0, 1, 2)]
    h.release()
    g = LineGraph.from_arrays(spark, [0, 0, 1, 3], [1, 2, 2, 4], [0.5, 2.0, 0.25, 1.0])
    assert (g.s_distance(0, 2), g.s_distance(0, 2, weighted=False), g.s_distance(0, 4)) == (0.75, 1, -1) and g.edge_overlap
    assert LineGraph.from_arrays(spark, [0, 1], [1, 2]).s_distance(0, 2) == 2


def test_component_lists(gaps):
    found = components.component_lists(gaps.connected_components())
    assert rows(found) == [(0, [0, 1], [0, 1]), (2, [2, 3, 6], [2, 3, 4]), (5, [5], [6]), (7, [7], [8])]


def test_ranks_and_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).cast("long").alias("v")).repartition(5)
    assert relabel.dense_ranks(df, ["k"]).where("new_id <> k").count() == 0 and relabel.dense_ranks(df.limit(0), ["k"]).count() == 0
    assert relabel.running_sums(df, "k", "v").where("before <> 2 * k").count() == 0
    inc = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (1, 2)], "edge long, node long")
    shift = relabel.offsets(inc)
    perm = relabel.degree_permutation(relabel.adjoin(inc, shift).select(F.col("src").alias("edge"), F.col("dst").alias("node")), "edge")
    assert rows(relabel.frontier(perm, shift)) == [(0,), (1,)]


def test_large_files_are_read_in_several_tasks(spark, tmp_path):
    """Lines and tokens are counted over the blocks of a file."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        h = spark.range(3000).selectExpr("id % 700 as edge", "id % 61 as node").distinct()
        for name, write in (("a.csv", writers.write_csv), ("a.adj", writers.write_adjacency), ("a.mm", writers.write_matrix_market)):
            write(h, str(tmp_path / name))
            assert spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 3
            assert rows(readers.read_hypergraph(spark, str(tmp_path / name))) == rows(h), name
        assert rows(readers.read_adjacency(spark, str(tmp_path / "a.adj"), side="node")) == rows(h)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_derived_readers_and_tools(spark, tmp_path):
    h = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)], "edge long, node long")
    source = str(tmp_path / "a.adj")
    writers.write_adjacency(h, source)
    joined, shift = readers.read_adjoined(spark, source)
    assert shift == (0, 3) and rows(joined) == [(e, n + 3) for e, n in rows(h)]
    for name, write in (("j.mm", writers.write_matrix_market), ("j.csv", writers.write_csv)):
        write(h, str(tmp_path / name))
        joined, shift = readers.read_adjoined(spark, str(tmp_path / name))
        assert shift == (0, 3) and rows(joined) == [(e, n + 3) for e, n in rows(h)], name
    assert rows(readers.sources(h, 2, seed=5)) == rows(readers.sources(h.repartition(3), 2, seed=5)) and readers.sources(h, 9).count() == 3
    renamed, perm = readers.read_relabelled(spark, source)
    assert table(perm) == {2: 0, 0: 1, 1: 2} and rows(renamed.groupBy("edge").count()) == [(0, 1), (1, 3), (2, 3)]
    for name in ("b.mm", "c.csv", "d.parquet"):
        readers.convert(spark, source, str(tmp_path / name), transpose=True)
        assert rows(readers.read_hypergraph(spark, str(tmp_path / name)), "edge", "node") == sorted((n, e) for e, n in rows(h)), name
    main(["convert", str(tmp_path / "b.mm"), str(tmp_path / "e.adj"), "--transpose"])
    assert rows(readers.read_hypergraph(spark, str(tmp_path / "e.adj"))) == rows(h)
    for name, n in (("toplexes", 1), ("s-components", 3), ("adjoin-bfs", 6), ("linegraph", 3)):
        main([name, source, "--out", str(tmp_path / name)])
        assert spark.read.parquet(str(tmp_path / name)).count() == n, name
    with pytest.raises(ValueError):
        readers.convert(spark, source, str(tmp_path / "x.zip"))
    (tmp_path / "s.mm").write_text("%%MatrixMarket matrix array integer general\n% sources\n3 1\n5\n1\n9\n")
    assert rows(readers.sources_from_file(spark, str(tmp_path / "s.mm"), 3)) == [(0,), (4,), (8,)]
    with pytest.raises(ValueError):
        readers.sources_from_file(spark, str(tmp_path / "s.mm"), 2)
    (tmp_path / "m.mm").write_text("%%MatrixMarket matrix coordinate integer symmetric\n3 3 2\n2 1 7\n3 3 5\n")
    assert rows(readers.read_matrix_market(spark, str(tmp_path / "m.mm"), symmetric=True)) == [(0, 1, 7), (1, 0, 7), (2, 2, 5)]
    writers.write_histogram(stats.histogram(h), str(tmp_path / "hist"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "hist")).collect()] == ["1 1", "3 2"]
    for k in (1, 2):
        writers.append_log(spark.createDataFrame([("q", k)], "query string, sec long"), str(tmp_path / "log"))
    assert rows(spark.read.json(str(tmp_path / "log")), "query", "sec") == [("q", 1), ("q", 2)]


def test_films(spark, tmp_path):
    (tmp_path / "titles").write_text("tconst\ttitleType\nt1\tmovie\nt2\tshort\nt3\tmovie\n")
    (tmp_path / "names").write_text('nconst\tprimaryName\nn1\tAnn "A\nn2\tBob\n')
    (tmp_path / "cast").write_text("tconst\tordering\tnconst\tcategory\nt1\t1\tn1\tactress\nt1\t2\tn2\tdirector\nt2\t1\tn1\tactress\nt3\t1\tn2\tactor\nt3\t2\tn1\tactress\n")
    got = readers.read_films(spark, *(str(tmp_path / x) for x in ("titles", "names", "cast")))
    assert rows(got, "title", "name") == [("t1", 'Ann "A'), ("t3", 'Ann "A'), ("t3", "Bob")]
    assert Hypergraph(got).overlaps(1).count() == 1
    assert rows(got, "edge", "node", "title", "person") == [(0, 0, "t1", "n1"), (1, 0, "t3", "n1"), (1, 1, "t3", "n2")]
    h = Hypergraph(got)
    assert rows(h.connected_components()) == [("E", 0, 0), ("E", 1, 0), ("N", 0, 0), ("N", 1, 0)]
    assert rows(relabel.run_on_adjoin(h.inc, components.connected_components), "kind", "id", "component") == [("E", 0, 0), ("E", 1, 0), ("N", 0, 0), ("N", 1, 0)]
    assert table(Hypergraph(got, universe="dense").edge_size_dist()) == {0: 1, 1: 2}
    main(["films", *(str(tmp_path / x) for x in ("titles", "names", "cast")), "--out", str(tmp_path / "found")])
    assert rows(spark.read.parquet(str(tmp_path / "found"))) == [("n1", 'Ann "A', 0, 0.0), ("n2", "Bob", 0, 0.0)]


def test_files(spark, tmp_path):
    h = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)], "edge long, node long")
    want = rows(h)
    (tmp_path / "a.mm").write_text("%%MatrixMarket matrix coordinate pattern general\n%%\n3 3 7\n1 1\n1 2\n1 3\n2 1\n2 2\n2 3\n3 1\n")
    (tmp_path / "a.csv").write_text("1,2,3\n1,2,3\n1\n")
    (tmp_path / "a.adj").write_text("\n".join("AdjacencyHypergraph 3 7 3 7 0 3 5 0 1 2 0 1 0 1 0 3 6 0 1 2 0 1 2 0".split()))
    for name in ("a.mm", "a.csv", "a.adj"):
        assert rows(readers.read_hypergraph(spark, str(tmp_path / name))) == want, name
    for write in (writers.write_matrix_market, writers.write_csv, writers.write_adjacency, writers.write_parquet):
        path = str(tmp_path / ("out.parquet" if write is writers.write_parquet else write.__name__))
        write(h, path)
        assert rows(readers.read_hypergraph(spark, path)) == want, write
    heavy = h.withColumn("weight", (F.col("edge") * 10 + F.col("node")).cast("double"))
    writers.write_adjacency(heavy, str(tmp_path / "w"))
    assert rows(readers.read_hypergraph(spark, str(tmp_path / "w"))) == rows(heavy)
    (tmp_path / "s.mm").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 1\n2 1\n")
    with pytest.raises(ValueError):
        readers.read_matrix_market(spark, str(tmp_path / "s.mm"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="not a node number"):
        readers.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_generators(spark):
    a, b = generators.from_histogram(spark, [(2, 3), (1, 4)]), generators.from_histogram(spark, [(5, 2)])
    made = generators.configuration_model(a, b, seed=5)
    assert table(made.groupBy("edge").count()) == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1} and table(made.groupBy("node").count()) == {0: 5, 1: 5}
    assert rows(made) == rows(generators.configuration_model(a, b, seed=5))
    r = generators.rmat(spark, [[1, 0], [0, 0]], 3, 10)
    assert set(rows(r)) == {(0, 0)}
    joined = generators.configuration_model(a, b, seed=5, contiguous_id_space=True)
    assert rows(joined.select("edge", F.col("node") - 7)) == rows(made)
    law = table(generators.power_law(spark.range(20000), 2.5, 2, 50, seed=1))
    share = [sum(d == k for d in law.values()) for k in (2, 4, 8)]
    assert min(law.values()) == 2 and max(law.values()) <= 50 and 3.5 < share[0] / share[1] < 8 and 3.5 < share[1] / share[2] < 8
    assert rows(generators.labelled(r.limit(1))) == [(0, 0, "e0", "n0")] and rows(generators.labels(spark.range(2), "x")) == [(0, "x0"), (1, "x1")]
    cells = generators.cell_weights([0.75, 0.25], [0.5, 0.5])
    assert cells == [[0.375, 0.375], [0.125, 0.125]]
    share = generators.rmat(spark, cells, 1, 4000).where("edge = 0").count() / 4000
    assert abs(share - 0.75) < 0.03
