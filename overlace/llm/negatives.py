"""12. Hard-negative mining: exact integer inner products of anchors with all vectors, by Kronecker-packed products.

Components are whole numbers. Those of several candidates, biased to be non-negative, lie in separate fields of one wide integer, so
one multiplication by an anchor's component multiplies them all; the sums over the components unpack to exact scores. Fields are
as wide as the numbers of a block need: three or two candidates to a 64-bit integer as a rule, and Python's integers of any width
where a single score may exceed 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from overlace.llm.common import map_arrow, slices
from overlace.plans.lineage import drop, stage

ANCHORS, CANDIDATES, SHARD = 2048, 4096, 64  # vectors of a block, and most blocks of candidates that a task meets with one anchor block
WIDE = 8  # fields of a Python integer


def whole_components(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exact: 64-bit integers, or Python's where a component needs more."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(scale * x).astype(np.int64)
    one = lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(scale * v))
    return np.array([[one(v) for v in row] for row in x.tolist()], object)


class Packed:
    """Candidates (rows of whole components), a few to an integer; ``scores`` multiplies each integer once per component of an anchor."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        self.n = len(candidates)
        self.bias = -int(candidates.min()) if candidates.size else 0
        top = int(candidates.max()) + self.bias if candidates.size else 0
        self.reach = top * max((sum(map(abs, a)) for a in anchors.tolist()), default=0)
        self.bits = max(1, (2 * self.reach).bit_length())
        self.fields = 63 // self.bits
        small = candidates.dtype != object and anchors.dtype != object
        self.kind = np.int64 if self.fields and small else object
        self.fields = self.fields if self.kind is np.int64 else WIDE
        self.width = -(-self.n // self.fields)
        c = np.zeros((self.fields * self.width, candidates.shape[1]), self.kind)
        c[: self.n] = candidates.astype(self.kind) + self.bias
        self.words = np.zeros((candidates.shape[1], self.width), self.kind)
        for f in range(self.fields):
            self.words += c[f * self.width : (f + 1) * self.width].T << f * self.bits
        self.lift = sum(self.reach << f * self.bits for f in range(self.fields))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The exact inner products of ``anchors`` (some of those that the fields were made for) with all candidates."""
        a = anchors.astype(self.kind)
        sums = a @ self.words + self.lift
        mask = (1 << self.bits) - 1
        out = np.concatenate([(sums >> f * self.bits) & mask for f in range(self.fields)], 1)[:, : self.n]
        return out - (self.reach + self.bias * a.sum(1))[:, None]


def _matrices(block: tuple, other: tuple, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole components of two blocks, shorter vectors padded with zeros."""
    rows = [[np.frombuffer(d) for d in b[3]] for b in (block, other)]
    dim = max((len(v) for x in rows for v in x), default=0)
    return tuple(whole_components(np.array([np.pad(v, (0, dim - len(v))) for v in x]).reshape(len(x), dim), scale) for x in rows)


def usable(df: DataFrame, label: Column) -> DataFrame:
    """(row, id, label, v): rows with an id, a label and a vector without null or non-finite components; row numbers them as they lie."""
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("id is not null and label is not null and embedding is not null").where(good)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "embedding")


_BLOCK = "rows: array<long>, ids: array<long>, labels: array<long>, data: array<binary>, most: array<array<long>>"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, b) of about ``size`` rows each, in order of id inside, so that ties are in order; ``most`` is a column of ``rows`` or empty."""
    n = max(1, -(-rows.count() // size))

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, size)):
            if batch.num_rows:
                data = [x.values.to_numpy(zero_copy_only=False).tobytes() for x in batch.column(3)]
                yield {"block": [(part << 20) + k], "b": [{"rows": batch.column(0).to_pylist(), "ids": batch.column(1).to_pylist(), "labels": batch.column(2).to_pylist(), "data": data, "most": batch.column(4).to_pylist()}]}

    most = F.col("most") if "most" in rows.columns else F.array().cast("array<long>").alias("most")
    return map_arrow(rows.select("row", "id", "label", "embedding", most).repartitionById(n, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).sortWithinPartitions("id", "row"), run, f"block long, b struct<{_BLOCK}>")


def _best(anchors: DataFrame, candidates: DataFrame, scale: int, keep: int, find) -> DataFrame:
    """(row, anchor_id, k, other, other_id, score): of each anchor's lists k the first ``keep`` of a shard, which holds ``SHARD`` blocks of candidates at most.

    ``find`` takes an anchor's ``most``, the candidates' ids, their scores in order of id, and masks of those that share its label and do not; it
    gives (k, id, score). A task reads an anchor block, then the shard's blocks one after the other, and keeps each list's best between them, so the rows that leave
    it are as many as lists and shards, whatever the candidates.
    """
    n, keys = candidates.count(), sorted(r[0] for r in anchors.select("block").collect())  # a number for each 2048 anchors
    shards = max(1, -(-n // SHARD), min(n, anchors.sparkSession.sparkContext.defaultParallelism // max(1, len(keys))))
    to = F.array(*[F.lit(k).cast("long") for k in keys]) if keys else F.array().cast("array<long>")
    left = anchors.select("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(-1).cast("long").alias("other"), "b")
    right = candidates.select(F.explode(to).alias("block"), F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), F.col("block").alias("other"), "b")

    def run(batches):
        a = None
        best: dict = {}

        def leave():
            out = [(a[0][j], a[1][j], k, i, -s) for (j, k), x in best.items() for s, i in x]
            return dict(zip(("row", "anchor_id", "k", "id", "score"), map(list, zip(*out, strict=True)), strict=True)) if out else None

        for batch in slices(batches, 1):
            b = tuple(batch.column(3)[0].as_py().values())
            if batch.column(2)[0].as_py() < 0:  # the next anchor block
                if (out := leave()) is not None:
                    yield out
                a, best = b, {}
                continue
            xa, xb = _matrices(a, b, scale)
            packed = Packed(xb, xa)
            rows, ids, labels = (np.array(b[k], np.int64) for k in range(3))
            for i in range(0, len(xa), 64):
                for j, s in enumerate(packed.scores(xa[i : i + 64]), i):
                    fits = np.array([-(1 << 63) < v < 1 << 63 for v in s.tolist()]) if s.dtype == object else np.ones(len(s), bool)
                    s = np.where(fits, s, 0).astype(np.int64)
                    use = fits & (rows != a[0][j])
                    for k, found in find(a[4][j], ids, s, use & (labels == a[2][j]), use & (labels != a[2][j])):
                        known = best.get((j, k))
                        best[j, k] = found if known is None else sorted(known + found)[:keep]
        if (out := leave()) is not None:
            yield out

    dealt = left.unionByName(right).repartition("block", "shard").sortWithinPartitions("block", "shard", "other")
    return map_arrow(dealt, run, "row long, anchor_id long, k int, id long, score long")


def hard_negatives(df: DataFrame, label: Column | None = None, anchor: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``df`` (vec_id, embedding, label).

    A score is the inner product of two vectors' floor(``scale`` * x); higher scores come first, then smaller ids. Positives are an anchor's first
    ``positives`` other rows of its label; of each, the first ``negatives`` rows of other labels with low % to high % of the positive's score
    are returned. ``anchor`` says which rows are anchors (ids divisible by 100 unless given), ``label`` what their labels are.

    Rows without an id or label, and vectors that are null or hold null or non-finite components, take no part. Shorter vectors count as padded
    with zeros. Rows that share an id are rows of their own; a pair whose score does not fit 64 bits is left out. Other columns are ignored. An empty
    table, or one without anchors, gives no rows. Anchors meet all rows in blocks: the query set is stated, and no more than a block's best leave a task.
    """
    rows = stage(usable(df, F.col("label") if label is None else label))
    chosen = rows.where(F.col("id") % 100 == 0 if anchor is None else anchor)
    all_blocks = stage(blocks(rows, CANDIDATES))
    asked = stage(blocks(chosen, ANCHORS))

    def nearest(_, ids, s, same, __):
        at = np.flatnonzero(same)
        at = at[np.argsort(-s[at], kind="stable")[:positives]]
        return [(0, list(zip((-s[at]).tolist(), ids[at].tolist(), strict=True)))] if len(at) else []

    first = _best(asked, all_blocks, scale, positives, nearest)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    best = first.withColumn("place", place).where(F.col("place") <= positives)
    best = stage(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p")))  # ``positives`` at most
    most = F.flatten(F.transform("p", lambda x: F.array(x["id"], x["score"])))
    served = stage(blocks(chosen.join(best.select("row", most.alias("most")), "row"), ANCHORS))

    def harder(most, ids, s, _, others):
        at = np.flatnonzero(others)
        at = at[np.argsort(-s[at], kind="stable")]
        down, out = -s[at], []
        for k, p in enumerate(most[1::2]):
            least, top = -(-low * p // 100), high * p // 100  # of the scores that fit
            start, end = np.searchsorted(down, -top, "left"), np.searchsorted(down, -least, "right")
            some = slice(start, min(end, start + negatives))
            if start < end:
                out.append((k, list(zip(down[some].tolist(), ids[at[some]].tolist(), strict=True))))
        return out

    found = _best(served, all_blocks, scale, negatives, harder)
    rank = F.row_number().over(Window.partitionBy("row", "k").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    pick = lambda k: F.element_at(F.transform("p", lambda x: x[k]), F.col("k") + 1)
    out = found.join(best, "row").select("anchor_id", pick("id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), pick("score").alias("positive_score"), F.col("score").alias("negative_score"))
    out = stage(out)
    drop(rows, all_blocks, asked, best, served)
    return out
