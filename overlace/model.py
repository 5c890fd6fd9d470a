"""The two facades: a hypergraph over an incidence table, and the line graph derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlace.operators import centrality, components, paths, stats, structure, traverse
from overlace.operators.overlap import overlap
from overlace.plans.lineage import drop, stage

COMPONENTS = {"star": components.connected_components, "afforest": components.afforest}


class Hypergraph:
    """Hyperedges and nodes of an incidence table (edge, node[, weight]).

    Repeated incidences are removed unless ``dedupe`` is False; of their weights the largest stays. With the dense universe ids 0..max
    exist without incidences too; with the observed one they don't. ``collapse`` keeps one hyperedge of each class, with weights
    of 0. ``inc`` has the incidences, ``weighted`` the same with their weights (0 where none are given).
    """

    def __init__(self, inc: DataFrame, universe: str = "observed", dedupe: bool = True, collapse: bool = False):
        keep = [c for c in ("edge", "node", "weight") if c in inc.columns]
        if {"edge", "node"} - set(keep) or universe not in ("observed", "dense"):
            raise ValueError("an incidence table has the columns edge and node; the universe is observed or dense")
        inc = inc.where("edge is not null and node is not null").select(F.col("edge").cast("long"), F.col("node").cast("long"), *keep[2:])
        self.universe = universe
        weighted = inc if "weight" in keep else inc.withColumn("weight", F.lit(0).cast("long"))
        inc = inc.select("edge", "node")
        inc = inc.distinct() if dedupe else inc
        if collapse:
            self.inc = structure.collapsed(inc)
            self.weighted = self.inc.withColumn("weight", F.lit(0).cast(weighted.schema["weight"].dataType))
        else:
            self.inc = inc
            self.weighted = weighted.groupBy("edge", "node").agg(F.max("weight").alias("weight")) if dedupe else weighted
        self._counts: dict[bool, tuple[int, DataFrame]] = {}

    @classmethod
    def from_arrays(cls, spark: SparkSession, row, col, data=None, **how) -> Hypergraph:
        """From equally long sequences of hyperedge ids, node ids and weights (0 where absent)."""
        if len(row) != len(col) or (data is not None and len(data) not in (0, len(row))):
            raise ValueError("rows, columns and weights differ in length")
        data = data if data is not None and len(data) else [0] * len(row)
        kind, one = ("long", int) if all(float(c).is_integer() for c in data) else ("double", float)
        return cls(spark.createDataFrame([(int(a), int(b), one(c)) for a, b, c in zip(row, col, data, strict=True)], f"edge long, node long, weight {kind}"), **how)

    def dual(self) -> Hypergraph:
        return Hypergraph(structure.dual(self.inc), self.universe, dedupe=False)

    def edge_size_dist(self) -> DataFrame:
        return stats.sizes(self.inc, "edge", self.universe)

    def node_size_dist(self) -> DataFrame:
        return stats.sizes(self.inc, "node", self.universe)

    def edge_incidence(self, edge: int) -> DataFrame:
        return self.inc.where(F.col("edge") == edge).select("node")

    def node_incidence(self, node: int) -> DataFrame:
        return self.inc.where(F.col("node") == node).select("edge")

    def _number(self, key: str) -> int:
        row = self.inc.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("n") if self.universe == "dense" else F.countDistinct(key).alias("n")).first()
        return row[0]

    def number_of_edges(self) -> int:
        return self._number("edge")

    def number_of_nodes(self) -> int:
        return self._number("node")

    order = number_of_nodes

    def size(self, edge: int, min_degree: int = 1, max_degree: int | None = None) -> int:
        """Nodes of a hyperedge with a degree in the range; -1 if there is no such hyperedge."""
        return self._size(self.inc, edge, min_degree, max_degree)

    def degree(self, node: int, min_size: int = 1, max_size: int | None = None) -> int:
        """Hyperedges of a node with a size in the range; -1 if there is no such node."""
        return self._size(structure.dual(self.inc), node, min_size, max_size)

    def _size(self, inc: DataFrame, edge: int, low: int, high: int | None) -> int:
        mine = inc.where(F.col("edge") == edge).select("node")
        degree = inc.join(mine, "node", "left_semi").groupBy("node").count()
        row = degree.agg(F.count(F.lit(1)), F.count_if((F.col("count") >= low) & (F.lit(True) if high is None else F.col("count") <= high))).first()
        if row[0]:
            return row[1]
        top = inc.agg(F.max("edge")).first()[0] if self.universe == "dense" else None
        return 0 if top is not None and 0 <= edge <= top else -1

    def dim(self, edge: int) -> int:
        n = self.size(edge)
        return n if n < 0 else n - 1

    def collapse_edges(self) -> DataFrame:
        return structure.collapse_edges(self.inc)

    def collapse_nodes(self) -> DataFrame:
        return structure.collapse_nodes(self.inc)

    def collapse_nodes_and_edges(self) -> DataFrame:
        return structure.collapse_nodes_and_edges(self.inc)

    def toplexes(self, keep: str = "first") -> DataFrame:
        return structure.toplexes(self.inc, keep)

    def singletons(self) -> DataFrame:
        return structure.singletons(self.inc)

    def bfs(self, source: int, alpha: float = 15.0, beta: float = 18.0) -> DataFrame:
        return traverse.hyper_bfs(self.inc, source, alpha, beta)

    def connected_components(self, seed: str = "edge", method: str = "star") -> DataFrame:
        """(kind, id, label), by ``star`` rounds, ``afforest`` (for a giant component) or ``labels`` that go to and fro (for small diameters)."""
        if method == "labels":
            return components.propagate_labels(self.inc, seed)
        return components.hyper_components(self.inc, seed, COMPONENTS[method])

    def overlaps(self, min_s: int = 1, edges: bool = True) -> DataFrame:
        """(src, dst, overlap) for overlaps of min_s or more; staged, and counted anew only for a smaller min_s."""
        if edges not in self._counts or self._counts[edges][0] > min_s:
            self._counts[edges] = (min_s, stage(overlap(self.inc if edges else structure.dual(self.inc), min_s)))
        return self._counts[edges][1]

    def release(self) -> None:
        """Deletes the staged overlaps; line graphs made from them must have been used before."""
        while self._counts:
            drop(self._counts.popitem()[1][1])

    def edge_neighbor_counts(self) -> DataFrame:
        """(src, dst, overlap) of all hyperedges that share a node."""
        return self.overlaps(1)

    def node_neighbor_counts(self) -> DataFrame:
        """(src, dst, overlap) of all nodes that share a hyperedge."""
        return self.overlaps(1, edges=False)

    def s_linegraph(self, s: int = 1, edges: bool = True) -> LineGraph:
        inc = self.inc if edges else structure.dual(self.inc)
        return LineGraph(self.overlaps(s, edges).where(F.col("overlap") >= s), stats.sizes(inc, "edge", self.universe).select(F.col("edge").alias("id")), s, edges)

    def s_linegraphs(self, values: list[int], edges: bool = True) -> list[LineGraph]:
        """One counting pass at the smallest s serves them all."""
        self.overlaps(min(values), edges)
        return [self.s_linegraph(s, edges) for s in values]


class LineGraph:
    """An undirected graph: edges (src < dst, overlap) and vertices (id), isolated ones too.

    Without ``vertices`` any edge list (src, dst[, data or overlap]) is taken: loops leave, of repeated pairs the smallest weight stays (1 where
    none is given), ids are 0..max. With a column data the graph is ``weighted``: distances, and the diameter, closeness, eccentricity and harmonic centrality
    that come from them, are sums of weights; paths and betweenness are those of hops. ``edge_overlap`` tells whether the vertices are hyperedges.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, s: int = 1, edge_overlap: bool = True):
        self.weighted, self.edge_overlap = "data" in edges.columns, edge_overlap
        edges = edges.withColumn("overlap", F.col("data")).drop("data") if self.weighted else edges
        edges = edges if "overlap" in edges.columns else edges.withColumn("overlap", F.lit(1).cast("long"))
        edges = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("overlap").alias("overlap")) if vertices is None else edges
        if vertices is None:  # any edge list: ids 0..max
            top = edges.agg(F.coalesce(F.max("dst"), F.lit(-1))).first()[0]
            vertices = edges.sparkSession.range(top + 1)
        self.edges, self.vertices, self.s = edges, vertices, s

    def _active(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()

    def s_components(self, method: str = "star") -> DataFrame:
        """(id, component) of every vertex, by ``star`` rounds or ``afforest``."""
        found = COMPONENTS[method](self.edges)
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def s_connected_components(self) -> DataFrame:
        """(component, members) of the components of two vertices or more.

        A row holds a whole component, so this is a report for small ones; ``s_components`` has the same in rows.
        """
        return self.s_components().groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members")).where(F.size("members") > 1)

    def get_singletons(self) -> DataFrame:
        return self.vertices.join(self._active(), "id", "left_anti")

    def is_s_connected(self, strict: bool = False) -> bool:
        """Whether there is an edge; ``strict``: whether all vertices are in one component."""
        return self.s_components().select("component").distinct().count() <= 1 if strict else not self.edges.isEmpty()

    def s_neighbors(self, v: int) -> DataFrame:
        return traverse.symmetric(self.edges.select("src", "dst")).where(F.col("src") == v).select(F.col("dst").alias("id"))

    def s_degree(self, v: int) -> int:
        return self.s_neighbors(v).count()

    s_neighborhood_size = s_degree

    def s_degrees(self) -> DataFrame:
        d = traverse.symmetric(self.edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def s_bfs(self, source: int) -> DataFrame:
        return traverse.graph_bfs(self.edges, source)

    @classmethod
    def from_arrays(cls, spark: SparkSession, x, y, data=None, **how) -> LineGraph:
        """From equally long sequences of endpoints and weights (1 where absent)."""
        if len(x) != len(y) or (data is not None and len(data) not in (0, len(x))):
            raise ValueError("endpoints and weights differ in length")
        data = data if data is not None and len(data) else [1] * len(x)
        kind, one = ("long", int) if all(float(c).is_integer() for c in data) else ("double", float)
        return cls(spark.createDataFrame([(int(a), int(b), one(c)) for a, b, c in zip(x, y, data, strict=True)], f"src long, dst long, data {kind}"), **how)

    def s_distance(self, src: int, dst: int, weighted: bool | None = None) -> int | float:
        """Hops, or the least sum of weights (the default for a ``weighted`` graph); -1 if there is no path."""
        if self.weighted if weighted is None else weighted:
            row = self.s_sssp(src).where(F.col("id") == dst).first()
            return -1 if row is None else row["distance"]
        row = traverse.graph_bfs(self.edges, src).where(F.col("id") == dst).first()
        return -1 if row is None else row["depth"]

    def s_path(self, src: int, dst: int) -> list[int]:
        row = paths.shortest_path(self.edges, src, dst).first()
        return [] if row is None else row["path"]

    def s_sssp(self, source: int, delta: float | None = None) -> DataFrame:
        """(id, distance) by weights: the overlaps, or the column data of a ``weighted`` graph."""
        return paths.weighted_distances(self.edges, source, delta=delta)

    def _scores(self, v: int | None, words: bool = False) -> DataFrame:
        one = None if v is None else self.edges.sparkSession.createDataFrame([(v,)], "id long")
        found = centrality.word_scores(self.edges, one) if words and not self.weighted else centrality.distance_scores(self.edges, one, self.weighted)
        vertices = self.vertices if v is None else self.vertices.where(F.col("id") == v)
        return vertices.join(found, "id", "left")

    def s_diameter(self, bounds: bool = True, report: dict | None = None) -> tuple[int | float, bool]:
        """(largest finite distance, whether the graph is connected); by bounds from few searches, or (always if ``weighted``) by all pairs."""
        n = self.vertices.count()
        if bounds and not self.weighted:
            found = centrality.eccentricities(self.edges, diameter_only=True, report=report)
            far, active, parts = found.agg(F.coalesce(F.max("farthest"), F.lit(0)), F.count(F.lit(1)), F.countDistinct("component")).first()
            drop(found)
            return far, n <= 1 or (active == n and parts == 1)
        far, least = self._scores(None).agg(F.coalesce(F.max("farthest"), F.lit(0)), F.min(F.coalesce("reached", F.lit(0)))).first()
        return far, n <= 1 or least == n - 1

    def s_eccentricity(self, v: int | None = None, bounds: bool = True, report: dict | None = None) -> DataFrame:
        """(id, value): the largest distance, 0 where a vertex is out of reach.

        By bounds from few searches, none where the graph is not connected; by all pairs if ``weighted`` or not ``bounds``.
        """
        if v is None and bounds and not self.weighted:
            if not self.is_s_connected(strict=True):
                return self.vertices.select("id", F.lit(0).cast("long").alias("value"))
            found = centrality.eccentricities(self.edges, report=report)
            return self.vertices.join(found, "id", "left").select("id", F.coalesce("farthest", F.lit(0)).cast("long").alias("value"))
        n = self.vertices.count()
        scores = self._scores(v)
        return scores.select("id", F.when(F.col("reached") == n - 1, F.col("farthest")).otherwise(0).cast(scores.schema["farthest"].dataType).alias("value"))

    def s_closeness_centrality(self, v: int | None = None, words: bool = False) -> DataFrame:
        """(id, value), null for isolated vertices; ``words``: hops are searched from 64 sources at once."""
        return self._scores(v, words).select("id", F.col("closeness").alias("value"))

    def s_harmonic_closeness_centrality(self, v: int | None = None, words: bool = False) -> DataFrame:
        return self._scores(v, words).select("id", F.coalesce("harmonic", F.lit(0.0)).alias("value"))

    def s_betweenness_centrality(self, normalized: bool = True, sources: DataFrame | None = None, batch: int = 1024) -> DataFrame:
        """(id, value) by hops, from every vertex or from ``sources`` (id), about ``batch`` of them at once."""
        found = centrality.betweenness(self.edges, self.vertices.count(), normalized, sources, batch)
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
