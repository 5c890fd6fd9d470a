"""Readers of hypergraph files: Matrix Market, CSV of members, adjacency files (weighted too), and film tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlace.operators import relabel
from overlace.operators.structure import dual
from overlace.plans.lineage import stage

# The first words of the file formats.
MATRIX_MARKET = "%%MatrixMarket"
ADJACENCY = "AdjacencyHypergraph"
WEIGHTED_ADJACENCY = "WeightedAdjacencyHypergraph"


def sniff(spark: SparkSession, path: str) -> str:
    """'mm', 'adjacency', 'weighted' or 'csv', from the first line."""
    row = spark.read.text(path).limit(1).first()
    first = (row[0].split() or [""])[0] if row else ""
    return {MATRIX_MARKET: "mm", ADJACENCY: "adjacency", WEIGHTED_ADJACENCY: "weighted"}.get(first, "csv")


def read_hypergraph(spark: SparkSession, path: str) -> DataFrame:
    """(edge, node[, weight]) of a file of any of the formats; a Parquet folder has the columns already."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return {"mm": read_matrix_market, "adjacency": read_adjacency, "weighted": read_weighted_adjacency, "csv": read_csv}[sniff(spark, path)](spark, path)


def read_matrix_market(spark: SparkSession, path: str, symmetric: bool = False) -> DataFrame:
    """Coordinates of one file, 1-based there and 0-based here; a symmetric one is refused unless asked for, then mirrored.

    The header is one line and the size line the first that is no comment, so lines are parsed in parallel and the size line is
    told by its place: the file's first line with digits.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).first()
    words = head[0].lower().split() if head else []
    if len(words) < 5 or words[0] != MATRIX_MARKET.lower() or words[2] != "coordinate":
        raise ValueError("not a Matrix Market coordinate file")
    if words[4] == "symmetric" and not symmetric:
        raise ValueError("a symmetric matrix is no incidence relation")
    body = lines.select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("at"))
    body = body.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = body.agg(F.min("at").alias("at"))
    body = body.join(F.broadcast(first), "at", "left_anti")  # the size line
    t = F.split(F.trim("value"), r"\s+")
    out = body.select((t[0].cast("long") - 1).alias("edge"), (t[1].cast("long") - 1).alias("node"), *([] if words[3] == "pattern" else [t[2].cast("double" if words[3] == "real" else "long").alias("weight")]))
    if words[4] == "symmetric":
        rest = out.columns[2:]
        out = out.unionByName(out.where("edge <> node").select(F.col("node").alias("edge"), F.col("edge").alias("node"), *rest))
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds n, the place of each row in the file (files in order of their names).

    ``rows`` has the columns file and start of the block that a row was read from. Rows are counted while they are
    written; the driver sums one number a block.
    """
    seen = stage(rows.withColumn("n", F.monotonically_increasing_id()))
    shift, before = [], 0
    for file, start, first, k in sorted(seen.groupBy("file", "start").agg(F.min("n"), F.count(F.lit(1))).collect()):
        shift.append((file, start, before - first))
        before += k
    shift = rows.sparkSession.createDataFrame(shift, "file string, start long, shift long")
    return seen.join(F.broadcast(shift), ["file", "start"]).withColumn("n", F.col("n") + F.col("shift")).drop("file", "start", "shift")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Line i of a file is hyperedge i; its numbers are 1-based nodes. A token that is no number is refused. Lines are read in parallel."""
    token = F.trim("token")
    cells = _numbered(_lines(spark, path)).select(F.col("n").alias("edge"), F.explode(F.split("value", ",")).alias("token")).where(token != "")
    checked = F.when(token.rlike(r"^\d+$"), token.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a node number: "), F.col("token"))).cast("long"))
    return cells.select("edge", (checked - 1).alias("node"))


def _tokens(spark: SparkSession, path: str, header: str) -> tuple[DataFrame, list[int]]:
    """(n, token) of a file in order, and the four counts behind its header."""
    words = _lines(spark, path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("token"), "file", "start").where("token <> ''")
    t = _numbered(words)
    first = [r.token for r in t.where("n < 5").orderBy("n").collect()]
    if first[:1] != [header]:
        raise ValueError(f"{header} expected, {first[:1]} found")
    return t, [int(x) for x in first[1:]]


def _half(t: DataFrame, at: int, n: int, m: int, weighted: bool, span: int = 64) -> DataFrame:
    """(owner, member[, weight]) of a block of n offsets, m members and, if weighted, m weights from token ``at`` on.

    A member's owner is found by a join on spans of ``span`` members, so a list of any length is spread and nothing is gathered.
    """
    part = lambda start, size, name: t.where((F.col("n") >= start) & (F.col("n") < start + size)).select((F.col("n") - start).alias("k"), F.col("token").alias(name))
    low = part(at, n, "lo").select(F.col("k").alias("owner"), F.col("lo").try_cast("long").alias("lo"))
    owners = low.join(low.select((F.col("owner") - 1).alias("owner"), F.col("lo").alias("hi")), "owner", "left").withColumn("hi", F.coalesce("hi", F.lit(m).cast("long")))
    owners = owners.where("hi > lo").withColumn("span", F.explode(F.expr(f"sequence(lo div {span}, (hi - 1) div {span})")))
    members = part(at + n, m, "member").withColumn("span", F.expr(f"k div {span}"))
    own = members.join(owners, "span").where("lo <= k and k < hi")
    if weighted:
        own = own.join(part(at + n + m, m, "weight"), "k")
    return own.select("owner", F.col("member").try_cast("long").alias("member"), *([F.col("weight").try_cast("double").alias("weight")] if weighted else []))


def read_adjacency(spark: SparkSession, path: str, weighted: bool = False, side: str = "edge") -> DataFrame:
    """(edge, node[, weight]) of an adjacency file: counts, node offsets and lists, then hyperedge offsets and lists.

    ``side`` says which half is read, that of the hyperedges or that of the nodes; in a sound file they agree.
    """
    t, (nv, mv, nh, mh) = _tokens(spark, path, WEIGHTED_ADJACENCY if weighted else ADJACENCY)
    if side == "node":
        return _half(t, 5, nv, mv, weighted).withColumnsRenamed({"owner": "node", "member": "edge"}).select("edge", "node", *(["weight"] if weighted else []))
    return _half(t, 5 + nv + mv * (2 if weighted else 1), nh, mh, weighted).withColumnsRenamed({"owner": "edge", "member": "node"})


def read_weighted_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return read_adjacency(spark, path, weighted=True)


def read_adjoined(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """The bipartite graph (src, dst) of a file of any format in one id space, and its offsets of edges and nodes."""
    inc = stage(read_hypergraph(spark, path))
    shift = relabel.offsets(inc)
    return relabel.adjoin(inc, shift), shift


def read_relabelled(spark: SparkSession, path: str, key: str = "edge", descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """The incidences of a file with the ids of one side in order of their size, and that permutation (old_id, new_id)."""
    inc = stage(read_hypergraph(spark, path))
    perm = stage(relabel.degree_permutation(inc, key, descending))
    return inc.join(perm, F.col(key) == F.col("old_id")).withColumn(key, F.col("new_id")).select(*inc.columns), perm


def read_films(spark: SparkSession, titles: str, names: str, principals: str) -> DataFrame:
    """(edge, node, title, person, name): films and their actors from three tab-separated tables with headers.

    edge and node number the films and people that have a part, from 0 on in order of their keys, so both sides are dense; title and
    person are those keys, which map the numbers back.
    """
    tsv = lambda p: spark.read.csv(p, sep="\t", header=True, quote="")
    films = tsv(titles).where("titleType = 'movie'").select(F.col("tconst").alias("title"))
    people = tsv(names).select(F.col("nconst").alias("person"), F.col("primaryName").alias("name"))
    cast = tsv(principals).where("category in ('actor', 'actress')").select(F.col("tconst").alias("title"), F.col("nconst").alias("person"))
    parts = stage(cast.join(films, "title").join(people, "person").distinct())
    edges = relabel.dense_ranks(parts.select("title").distinct(), [F.asc("title")], "edge")
    nodes = relabel.dense_ranks(parts.select("person").distinct(), [F.asc("person")], "node")
    return parts.join(edges, "title").join(nodes, "person").select("edge", "node", "title", "person", "name")


def sources(inc: DataFrame, n: int, seed: int = 27491095) -> DataFrame:
    """(id): n hyperedges that have a node, drawn by a seeded hash."""
    return inc.select(F.col("edge").alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def sources_from_file(spark: SparkSession, path: str, n: int = 0) -> DataFrame:
    """(id): the 0-based sources of a Matrix Market array of 1-based numbers; another count than ``n``, if given, is refused."""
    lines = spark.read.text(path)
    if not (lines.first() or [""])[0].lower().startswith(f"{MATRIX_MARKET.lower()} matrix array"):
        raise ValueError("not a Matrix Market array file")
    body = _numbered(_lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != "")))
    out = body.where("n > 0").select((F.trim("value").cast("long") - 1).alias("id"))  # the first line has the size
    if n and out.count() != n:
        raise ValueError(f"{path} has {out.count()} sources, not {n}")
    return out


def convert(spark: SparkSession, source: str, target: str, transpose: bool = False) -> None:
    """Writes a hypergraph file in another format, told by the ending of ``target``: .mm, .csv, .adj or .parquet; transposed if asked."""
    from overlace.sources import writers

    by = {"mm": writers.write_matrix_market, "mtx": writers.write_matrix_market, "csv": writers.write_csv, "adj": writers.write_adjacency, "parquet": writers.write_parquet}
    write = by.get(target.rstrip("/").rsplit(".", 1)[-1])
    if write is None:
        raise ValueError(f"the ending of {target} is none of {', '.join(by)}")
    inc = read_hypergraph(spark, source)
    write(dual(inc) if transpose else inc, target)
