"""Command line: ``python -m overlace convert SOURCE TARGET [--transpose]``, ``python -m overlace NAME FILE [--s S] [--source ID]`` and
``python -m overlace films TITLES NAMES PRINCIPALS [--s S]``.

NAME is one of the drivers below; FILE is a hypergraph file of any readable format. Results go to --out as Parquet, or are shown.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlace.model import Hypergraph, LineGraph
from overlace.operators import components, relabel, traverse
from overlace.plans.lineage import stage
from overlace.sources import readers


def _adjoin_bfs(h: Hypergraph, a: argparse.Namespace) -> DataFrame:
    first = relabel.offsets(h.inc)[0]
    return relabel.run_on_adjoin(h.inc, lambda g: traverse.graph_bfs(g, a.source + first))


def films(spark: SparkSession, titles: str, names: str, principals: str, s: int = 1) -> DataFrame:
    """(person, name, component, score): actors who share ``s`` films with another, the least number of their component, and their betweenness."""
    parts = stage(readers.read_films(spark, titles, names, principals))
    pairs, known = relabel.squeeze(Hypergraph(parts).s_linegraph(s, edges=False).edges)
    graph = LineGraph(stage(pairs), known.select(F.col("new_id").alias("id")))
    people = parts.select(F.col("node").alias("old_id"), "person", "name").distinct().join(known, "old_id").select(F.col("new_id").alias("id"), "person", "name")
    found = graph.s_components().join(graph.s_betweenness_centrality(), "id").join(people, "id")
    return found.select("person", "name", "component", F.col("value").alias("score"))


DRIVERS: dict[str, Callable[[Hypergraph, argparse.Namespace], DataFrame]] = {
    "bfs": lambda h, a: h.bfs(a.source),
    "adjoin-bfs": _adjoin_bfs,
    "cc": lambda h, a: h.connected_components(),
    "adjoin-cc": lambda h, a: relabel.run_on_adjoin(h.inc, components.connected_components),
    "toplexes": lambda h, a: h.toplexes(),
    "linegraph": lambda h, a: h.s_linegraph(a.s).edges,
    "s-components": lambda h, a: h.s_linegraph(a.s).s_components(),
    "s-bfs": lambda h, a: h.s_linegraph(a.s).s_bfs(a.source),
    "s-sssp": lambda h, a: h.s_linegraph(a.s).s_sssp(a.source),
    "s-betweenness": lambda h, a: h.s_linegraph(a.s).s_betweenness_centrality(),
    "s-diameter": lambda h, a: h.inc.sparkSession.createDataFrame([h.s_linegraph(a.s).s_diameter()], "diameter long, connected boolean"),
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="overlace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("name", choices=["convert", "films", *DRIVERS])
    p.add_argument("file")
    p.add_argument("target", nargs="?")
    p.add_argument("third", nargs="?")
    p.add_argument("--transpose", action="store_true")
    p.add_argument("--s", type=int, default=1)
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--out")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("overlace").getOrCreate()
    if a.name == "convert":
        if not a.target:
            p.error("convert needs a target")
        readers.convert(spark, a.file, a.target, a.transpose)
        return
    if a.name == "films":
        if not a.third:
            p.error("films needs three tables: titles, names and principals")
        found = films(spark, a.file, a.target, a.third, a.s)
    else:
        inc = stage(readers.read_hypergraph(spark, a.file))
        found = DRIVERS[a.name](Hypergraph(inc).dual() if a.transpose else Hypergraph(inc), a)
    found.write.mode("overwrite").parquet(a.out) if a.out else found.show(100, False)


if __name__ == "__main__":
    main()
