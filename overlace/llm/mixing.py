"""13. Mixing sources to target weights: whole copies of documents by pivotal dependent rounding.

Every document of a source is due the same number of copies, its source's target by its size; the whole part is given and the fraction
is rounded dependently. Two documents with fractions meet: words' worth of probability goes from one to the other, in a
random direction with even odds in expectation, until one of them is at 0 or 1. The source's words in expectation don't change
by that, so only the last fraction of a source can miss the target, by half a document at most. Leaves of the
reduction are buckets of about 4096 documents; the one fraction that a source leaves in a bucket goes up a tree of 64 buckets to one.
"""

from __future__ import annotations

from itertools import chain, groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices
from overlace.operators.relabel import dense_ranks, running_sums
from overlace.plans.lineage import drop, stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET, FAN = 12, 6  # bits


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text, 0 for a null one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, rows, place, target) of every row of ``sources`` (source, source_size, rows).

    Sources are in order of their names by code point, null last, and weigh ``weights`` in turn. All sizes are shared by weight; a target stops at
    ``most`` times its source's size, and what is above goes to the others by weight, round by round, until none is above. A round is one
    aggregate of the table of sources.
    """
    placed = dense_ranks(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stage(placed.withColumns({"weight": weight, "limit": most * F.col("source_size")}))
    total, all_weight = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    rate, full = total / all_weight, 0
    while True:
        above = F.col("limit") < rate * F.col("weight")
        n, held, rest = placed.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n <= full or rest == 0:
            break
        rate, full = (total - held) / rest, n
    return placed.select("source", "source_size", "rows", "place", F.least(F.col("limit"), F.lit(float(rate)) * F.col("weight")).alias("target"))


def pivotal(p: list[float], size: list[int], draws: np.ndarray) -> tuple[list[int], int, float]:
    """(0 or 1 for each, the place that is left or -1, its fraction): sums of p * size stay, whatever is drawn.

    ``p`` are fractions in 0..1 and ``size`` positive; the places are paired in the order given, the loser of a pair is settled and the other goes on.
    """
    tiny = 1e-12
    out, left, q = [0] * len(p), -1, 0.0
    for k, (x, s) in enumerate(zip(p, size, strict=True)):
        if x <= tiny or x >= 1 - tiny:
            out[k] = int(x > 0.5)
            continue
        if left < 0:
            left, q = k, x
            continue
        t = size[left]
        up, down = min((1 - q) * t, x * s), min(q * t, (1 - x) * s)  # words that can go to the one left, and from it
        move = up if draws[k] * (up + down) < down else -down
        q, x = q + move / t, x - move / s
        if tiny < q < 1 - tiny:
            out[k] = int(x > 0.5)
        else:
            out[left], left = int(q > 0.5), -1
            if tiny < x < 1 - tiny:
                left, q = k, x
            else:
                out[k] = int(x > 0.5)
    return out, left, q


_ROWS = "place long, number long, first long, last long, doc_id long, size long, source_size long, target double, whole long, p double, up int"


def _settle(rows: DataFrame, bits: int, seed: int) -> DataFrame:
    """Rows with ``up`` settled but for one of each source in each bucket of 2 ** bits numbers; a source that ends in its bucket is settled wholly."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches):
        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in slices(batches, 4096))
        for (bucket, place), group in groupby(every, itemgetter(0, 1)):
            cols = dict(zip(names, map(list, zip(*(g[1:] for g in group), strict=True)), strict=True))
            rng = np.random.default_rng([seed, bits, bucket, place])
            up, left, q = pivotal(cols["p"], cols["size"], rng.random(len(cols["p"])))
            if left >= 0:
                whole = cols["first"][0] >> bits == cols["last"][0] >> bits
                cols["p"][left] = q
                up[left] = int(q >= 0.5) if whole else None
            yield cols | {"up": up}

    dealt = rows.select(F.shiftright("number", bits).alias("bucket"), *names).repartition("bucket", "place").sortWithinPartitions("bucket", "place", F.desc("size"), "number")
    return map_arrow(dealt, run, _ROWS)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 13) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, source, text); taken is copies * size.

    Copies are the source's target by its size, rounded up or down, ``most`` at most. Rows are numbered by source and a hash of the id, so neither a
    large source nor the files' layout shapes a bucket, and runs over the same rows agree. Documents without words and sources of size 0 are not taken.
    A null source is a source, a null id a document; repeated rows are documents of their own, and other columns are left out.
    """
    counted = stage(sizes(docs).withColumn("turn", F.monotonically_increasing_id()))
    sources = counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    known = targets(stage(sources), weights, most)
    known = stage(running_sums(known, "place", "rows", "first"))
    names = known.select(F.col("source").alias("name"), "source_size", "place", "target", "first", (F.col("first") + F.col("rows") - 1).alias("last"))
    rows = counted.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(share)).withColumn("p", F.when(F.col("size") > 0, share - F.col("whole")).otherwise(0.0))
    # turn is last: rows that agree before it are alike, so it spreads them and changes no result
    order = ["place", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size", "turn"]
    rows = dense_ranks(rows, order, "number").withColumn("up", F.lit(None).cast("int"))
    out, bits = [], BUCKET
    while True:
        settled = stage(_settle(rows, bits, seed))
        out.append(settled.where("up is not null"))
        rows, bits = settled.where("up is null"), bits + FAN
        if rows.isEmpty():
            break
    drop(counted)
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    copies = F.col("whole") + F.col("up")
    return out[0].select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
