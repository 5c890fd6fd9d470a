"""Centralities of line graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from overlace.operators.components import connected_components
from overlace.operators.paths import WORD, all_pairs, delta_stepping, levels, word_levels
from overlace.operators.traverse import symmetric
from overlace.plans.lineage import Ledger, counted, cut, drop


def distance_scores(edges: DataFrame, sources: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(id, reached, closeness, harmonic, farthest) of the vertices that have an edge, by hops or by sums of weights.

    closeness: reached others by the sum of their distances; harmonic: the sum of 1 / distance. A weighted distance of 0 makes them infinite.
    """
    d = delta_stepping(edges, sources) if weighted else all_pairs(edges, sources).withColumnRenamed("depth", "distance")
    x = F.col("distance").cast("double")
    return d.where("root <> id").groupBy(F.col("root").alias("id")).agg(
        F.count(F.lit(1)).alias("reached"), F.try_divide(F.count(F.lit(1)), F.sum(x)).alias("closeness"), F.sum(F.when(x == 0, float("inf")).otherwise(1 / x)).alias("harmonic"), F.max("distance").alias("farthest")
    )


def word_scores(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``distance_scores`` by hops, from searches of 64 sources at once: bits are counted per level, so no pair ever is a row."""
    found, words = word_levels(edges, sources)
    bits = F.array(*[F.sum(F.shiftright("bits", b).bitwiseAND(F.lit(1).cast("long"))) for b in range(WORD)])
    counts = None
    for depth in range(1, len(found) - 1):
        level = found.part(depth).groupBy("word").agg(bits.alias("counts")).select("word", F.lit(depth).alias("depth"), F.posexplode("counts").alias("bit", "n"))
        counts = level if counts is None else counts.unionByName(level)
        if depth % 16 == 0:
            counts = cut(counts)
    none = words.sparkSession.createDataFrame([], "word long, depth int, bit int, n long")
    d = words.join(none if counts is None else counts.where("n > 0"), ["word", "bit"]).groupBy(F.col("root").alias("id"))
    n, depth = F.sum("n"), F.col("depth")
    out = cut(d.agg(n.alias("reached"), (n / F.sum(F.col("n") * depth)).alias("closeness"), F.sum(F.col("n") / depth).alias("harmonic"), F.max("depth").cast("long").alias("farthest")))
    drop(found, words)
    return out


def eccentricities(edges: DataFrame, width: int = 8, diameter_only: bool = False, report: dict | None = None) -> DataFrame:
    """(id, component, farthest) of the vertices that have an edge: the largest distance in hops, exact, without all pairs.

    Every vertex has bounds. A round searches from some vertices of each component whose bounds are open, those of the highest upper and of the lowest
    lower bound, well connected ones first: ``width`` in the first round and twice as many in each further one. A search from r at distance d of v gives
    max(d, ecc(r) - d) <= ecc(v) <= ecc(r) + d; a vertex is done when its bounds meet. With ``diameter_only`` farthest is a lower bound but for one vertex
    at least, and rounds end once no upper bound exceeds the largest lower one. ``report`` gets the numbers of searches and of vertices.
    """
    pairs = symmetric(edges.select("src", "dst")).distinct()
    degree = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    ids = connected_components(edges).join(degree, "id")
    is_open = F.col("low") < F.col("high")
    measures = {"top": F.max(F.when(is_open, F.col("high"))), "best": F.max("low"), "open": F.count_if(is_open)}
    bounds, now = counted(ids.select("id", "component", "degree", F.lit(0).cast("long").alias("low"), F.lit(1 << 62).alias("high")), **measures)
    vertices, searches = now["n"], 0
    place = lambda *order: F.row_number().over(Window.partitionBy("component").orderBy(*order, F.desc("degree"), "id"))
    while now["open"] and not (diameter_only and now["top"] <= now["best"]):
        unsure = bounds.where(is_open & (F.col("high") > now["best"]) if diameter_only else is_open)
        some = [unsure.withColumn("k", place(by)).where(F.col("k") <= max(1, width // 2)).select("id") for by in (F.desc("high"), F.asc("low"))]
        some, got = counted(some[0].union(some[1]).distinct())
        found = levels(edges, some)
        d = found.table().select("root", "id", "depth")
        ecc = d.groupBy("root").agg(F.max("depth").alias("ecc"))
        low, high = F.max(F.greatest("depth", F.col("ecc") - F.col("depth"))), F.min(F.col("ecc") + F.col("depth"))
        new = d.join(ecc, "root").groupBy("id").agg(low.alias("new_low"), F.min(F.when(F.col("id") == F.col("root"), F.col("ecc"))).alias("own"), high.alias("new_high"))
        better = bounds.join(new, "id", "left").select("id", "component", "degree", F.greatest("low", "new_low").alias("low"), F.coalesce("own", F.least("high", "new_high")).alias("high"))
        held, (bounds, now) = bounds, counted(better, **measures)
        drop(held, found, some)
        searches, width = searches + got["n"], 2 * width
    if report is not None:
        report.update(searches=searches, vertices=vertices)
    out = bounds.select("id", "component", F.col("low").alias("farthest"))
    out._staged_at = bounds._staged_at
    return out


def betweenness(edges: DataFrame, n_vertices: int, normalized: bool = True, sources: DataFrame | None = None, batch: int = 1024, report: dict | None = None) -> DataFrame:
    """(id, value) of the vertices that have an edge: the sum over ordered pairs, by (n-1)(n-2) if normalized and n > 2.

    Brandes' accumulation by levels, about ``batch`` sources at once: dependencies flow from the deepest level back, each step a join of two
    neighbouring levels through the edges. A batch's levels go before the next batch, and scores are kept as one total per vertex, so
    the staged tables don't grow with the sources. ``report`` gets the batches and the most staged tables that were there.
    """
    adj = symmetric(edges.select("src", "dst")).distinct().persist()
    ids = adj.select(F.col("src").alias("id")).distinct()
    roots = cut(ids if sources is None else sources.select("id").distinct())
    batches = max(1, -(-roots.count() // batch))
    total = cut(ids.withColumn("value", F.lit(0.0)))
    for b in range(batches):
        mine = roots.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        tables, sums, delta = levels(edges, mine), Ledger(edges.sparkSession), None
        sums.append(total)
        for k in range(len(tables) - 2, 0, -1):  # the last level is empty
            here = tables.part(k).select("root", "id", "sigma")
            here = here.withColumn("delta", F.lit(0.0)) if delta is None else here.join(delta, ["root", "id"], "left").select("root", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
            give = here.join(adj, F.col("id") == F.col("src")).select("root", F.col("dst").alias("up"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            up = tables.part(k - 1).select("root", F.col("id").alias("up"), F.col("sigma").alias("up_sigma"))
            held, delta = delta, cut(give.join(up, ["root", "up"]).groupBy("root", F.col("up").alias("id")).agg(F.sum(F.col("share") * F.col("up_sigma")).alias("delta")))
            drop(held)
            if k > 1:  # a root has no dependency of its own
                sums.append(delta.groupBy("id").agg(F.sum("delta").alias("value")))
        held, total = total, cut(sums.table().groupBy("id").agg(F.sum("value").alias("value")))
        drop(held, delta, sums, tables)
    drop(roots)
    adj.unpersist()
    if report is not None:
        report["batches"] = batches
    scale = 1 / ((n_vertices - 1) * (n_vertices - 2)) if normalized and n_vertices > 2 else 1.0
    return total.select("id", (F.col("value") * scale).alias("value"))


def verify_betweenness(edges: DataFrame, found: DataFrame, sources: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row of violation counts for unnormalised scores (id, value), all zero where they are right.

    bad_score: vertices whose score is not the sum, over pairs of a root and a target, of the share of shortest paths through them, recomputed
    from counted paths and not by accumulation. bad_total: whether the scores don't sum to the inner vertices of all shortest paths (distance - 1 a
    pair). missing: vertices with an edge and no score. The recomputation joins all pairs with themselves, so it is for checks, or for a few ``sources``.
    """
    every = all_pairs(edges)
    pairs = cut(every)
    roots = pairs.select(F.col("root")).distinct() if sources is None else sources.select(F.col("id").alias("root")).distinct()
    whole = cut(pairs.join(roots, "root", "left_semi"))
    first = whole.where("depth > 0").select("root", F.col("id").alias("via"), F.col("depth").alias("d1"), F.col("sigma").alias("s1"))
    second = pairs.where("depth > 0").select(F.col("root").alias("via"), F.col("id").alias("to"), F.col("depth").alias("d2"), F.col("sigma").alias("s2"))
    third = whole.select("root", F.col("id").alias("to"), F.col("depth").alias("d"), F.col("sigma").alias("s"))
    want = first.join(second, "via").join(third, ["root", "to"]).where("d1 + d2 = d").groupBy(F.col("via").alias("id")).agg(F.sum(F.expr("s1 * s2 / s")).alias("want"))
    ids = pairs.where("depth = 0").select("id")
    both = ids.join(found, "id", "left").join(want, "id", "left")
    off = F.abs(F.col("value") - F.coalesce("want", F.lit(0.0))) > tolerance * F.greatest(F.lit(1.0), F.coalesce("want", F.lit(0.0)))
    row = both.agg(F.count_if(off).alias("bad_score"), F.count_if(F.col("value").isNull()).alias("missing"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")).first()
    inner = whole.where("depth > 1").agg(F.coalesce(F.sum(F.col("depth") - 1), F.lit(0))).first()[0]
    wrong = int(abs(row["total"] - inner) > tolerance * max(1.0, inner))
    out = edges.sparkSession.createDataFrame([(row["bad_score"], wrong, row["missing"])], "bad_score long, bad_total long, missing long")
    drop(every, pairs, whole)
    return out
