"""2. Embedding near-dedup: an epsilon grid order join on leading principal dimensions.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t). They are sorted by grid cells of width eps on the leading
principal dimensions and cut into sequence intervals with bounding boxes. Intervals are joined recursively, first as rows of a
tree over the intervals, then inside each pair of blocks; pairs of boxes farther apart than eps are skipped.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices
from overlace.operators.components import connected_components
from overlace.plans.lineage import cut, drop, stage

FAN = 3  # bits of a level of the tree over intervals


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, digest, v): v holds the doubles; dim is 0 and v empty where a vector is null, zero, or not finite throughout."""

    def run(batches):
        for batch in slices(batches, 4096):
            dims, digests, data = [], [], []
            for x in batch.column(1):
                v = np.empty(0)
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                    with np.errstate(over="ignore"):
                        big = np.abs(v).max()
                    v = v / 2.0 ** np.floor(np.log2(big)) if np.isfinite(v).all() and big > 0 else np.empty(0)
                dims.append(len(v))
                data.append(v.tobytes())
                digests.append(hashlib.blake2b(data[-1], digest_size=16).digest())
            yield {"vec_id": batch.column(0), "dim": dims, "digest": digests, "v": data}

    return map_arrow(df.select(F.col(vec_id).cast("long").alias("vec_id"), embedding), run, "vec_id long, dim int, digest binary, v binary")


def principal(reps: DataFrame, dims: int, sample: int = 4096) -> np.ndarray:
    """Leading principal axes (width x dims) of a sample of about ``sample`` vectors, those of the smallest digests; pruning alone depends on it.

    Digests are even over their range, so a threshold draws the sample and only it goes to the driver.
    """
    share = sample / max(1, reps.count())
    first = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    some = reps.where(first < int(share * (1 << 32))) if share < 1 else reps
    got = [np.frombuffer(r[0]) for r in some.select("digest", "v").sort("digest").select("v").collect()]
    width = max((len(x) for x in got), default=1)
    x = np.array([np.pad(x, (0, width - len(x))) for x in got]) if got else np.zeros((1, 1))
    x = _unit(x) if got else x
    return np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:dims].T.copy()


def _project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Orthonormal axes shrink distances at most; components beyond the sample's width are left out, which shrinks them too."""
    n = min(x.shape[1], axes.shape[0])
    return x[:, :n] @ axes[:n]


def _matrix(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(d) for d in data]
    dim = np.array([len(r) for r in rows])
    if len(set(dim.tolist())) == 1:
        return _unit(np.array(rows)), dim
    return _unit(np.array([np.pad(r, (0, dim.max() - len(r))) for r in rows])), dim


def blocks(reps: DataFrame, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Sequence intervals in grid order: (part, seq, ids, weights, data, lo, hi); those of range partition ``part`` are numbered from 0.

    ``reps`` is (id, n, dim, v), n the weight of a vector.
    """
    m = axes.shape[1]

    def project(batches):
        for batch in slices(batches, 4096):
            x = _matrix(batch.column(3).to_pylist())[0]
            p = _project(x, axes)
            yield {f: batch.column(i) for i, f in enumerate(("id", "n", "dim", "v"))} | {"p": list(p), "cells": list(np.floor(p / eps).astype(np.int64))}

    placed = map_arrow(reps.select("id", "n", "dim", "v"), project, "id long, n long, dim int, v binary, p array<double>, cells array<long>")
    placed = stage(placed)
    parts = max(1, -(-placed.count() // block))
    order = [F.col("dim"), *[F.col("cells")[j] for j in range(m)], F.col("id")]

    def gather(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, block):
            p = np.array(batch.column(4).to_pylist(), float).reshape(batch.num_rows, m)
            if batch.num_rows:
                yield {"part": [part], "seq": [k], "ids": [batch.column(0)], "weights": [batch.column(1)], "data": [batch.column(3).to_pylist()], "lo": [p.min(0)], "hi": [p.max(0)]}
                k += 1

    return map_arrow(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order), gather, "part long, seq long, ids array<long>, weights array<long>, data array<binary>, lo array<double>, hi array<double>")


def interval_pairs(boxes: DataFrame, eps: float, m: int) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, whose boxes are within eps: the recursion over the tree of intervals, level by level."""
    last = boxes.agg(F.max("block")).first()[0]
    if last is None:
        return boxes.select(F.col("block").alias("a"), F.col("block").alias("b"))
    levels = []
    level = boxes.select(F.col("block").alias("node"), "lo", "hi")
    while True:
        levels.append(level)
        if last == 0:
            break
        last >>= FAN
        up = level.withColumn("node", F.shiftright("node", FAN))
        level = up.groupBy("node").agg(*[F.min(F.col("lo")[j]).alias(f"l{j}") for j in range(m)], *[F.max(F.col("hi")[j]).alias(f"h{j}") for j in range(m)])
        level = cut(level.select("node", F.array(*[f"l{j}" for j in range(m)]).alias("lo"), F.array(*[f"h{j}" for j in range(m)]).alias("hi")))
    gap = sum((F.greatest(F.lit(0.0), F.col("x.lo")[j] - F.col("y.hi")[j], F.col("y.lo")[j] - F.col("x.hi")[j]) ** 2 for j in range(m)), F.lit(0.0))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for depth in range(len(levels) - 2, -1, -1):
        node = levels[depth]
        kids = node.withColumn("up", F.shiftright("node", FAN))
        pairs = pairs.join(kids.select("up", F.struct("node", "lo", "hi").alias("x")), F.col("a") == F.col("up")).drop("up")
        pairs = pairs.join(kids.select("up", F.struct("node", "lo", "hi").alias("y")), F.col("b") == F.col("up"))
        pairs = pairs.where((F.col("x.node") <= F.col("y.node")) & (gap <= eps * eps * (1 + 1e-9))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs


def _join(x, y, px, py, same, dx, dy, t, eps, leaf, found):
    """Recursive interval join: splits both sequences, skips boxes farther apart than eps; found gets (rows, columns) of links."""

    def go(a, b, c, d):
        if same and c < a:
            return
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > eps * eps * (1 + 1e-9):
            return
        if b - a > leaf or d - c > leaf:
            i, j = ((a + b) // 2 if b - a > leaf else b), ((c + d) // 2 if d - c > leaf else d)
            for r in ((a, i), (i, b)):
                for s in ((c, j), (j, d)):
                    if r[0] < r[1] and s[0] < s[1]:
                        go(*r, *s)
            return
        near = x[a:b] @ y[c:d].T >= t
        if same and a == c:
            near = np.triu(near, 1)
        if near.any():
            i, j = np.nonzero(near)
            ok = dx[a + i] == dy[c + j]
            found(a + i[ok], c + j[ok])

    go(0, len(x), 0, len(y))


def near_vectors(df: DataFrame, threshold: float = 0.9, dims: int = 4, block: int = 4096, leaf: int = 512, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine >= threshold in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors of different
    lengths link. Vectors that are equal (up to a power of two) are one class with a weight, so copies are counted
    and not compared; classes are numbered, so vec_ids that repeat do no harm. Blocks give counts and a spanning forest instead of all
    links. Every row has a result; rows that share a vec_id count as vectors of their own. A null vec_id links with nothing, is its own
    null component and kept; other columns are dropped.
    """
    eps = float(np.sqrt(2 - 2 * threshold))
    seen = stage(vectors(df, vec_id, embedding))
    reps = stage(seen.where("dim > 0 and vec_id is not null").groupBy("dim", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id()))
    axes = principal(reps, dims)
    m = axes.shape[1]
    made = stage(blocks(reps, axes, eps, block))
    # Ids without wide gaps keep the tree over the intervals as low as their number allows.
    bits = (made.agg(F.max("seq")).first()[0] or 0).bit_length()
    made = made.withColumn("block", F.shiftleft("part", bits) + F.col("seq"))
    pairs = cut(interval_pairs(made.select("block", "lo", "hi"), eps, m))
    side = lambda k: made.select(F.col("block").alias(k), F.struct("ids", "weights", "data").alias(f"{k}_"))
    work = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_", "b_")

    def run(batches):
        for batch in slices(batches, 1):
            a, b = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            (x, dx), (y, dy) = (_matrix(batch.column(k)[0]["data"].as_py()) for k in (2, 3))
            ids = [batch.column(k)[0]["ids"].values.to_numpy() for k in (2, 3)]
            w = [batch.column(k)[0]["weights"].values.to_numpy() for k in (2, 3)]
            n = [np.zeros(len(i), np.int64) for i in ids]
            root = list(range(len(x) + (0 if a == b else len(y))))
            shift, links = (0 if a == b else len(x)), []

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            def found(i, j):
                np.add.at(n[0], i, w[1][j])
                np.add.at(n[0] if a == b else n[1], j, w[0][i])
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    r, s = top(p), top(q + shift)
                    if r != s:
                        root[s] = r
                        links.append((ids[0][p], ids[1][q]))

            _join(x, y, _project(x, axes), _project(y, axes), a == b, dx, dy, threshold, eps, leaf, found)
            some = [k > 0 for k in n]
            own = np.concatenate([i[s] for i, s in zip(ids, some, strict=True)])
            yield {
                "src": np.concatenate([own, [x[0] for x in links]]).astype(np.int64),
                "dst": np.concatenate([own, [x[1] for x in links]]).astype(np.int64),
                "n": np.concatenate([k[s] for k, s in zip(n, some, strict=True)] + [np.zeros(len(links), np.int64)]),
            }

    found = stage(map_arrow(work, run, "src long, dst long, n long"))
    counts = found.where("n > 0").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("others"))
    comps = stage(connected_components(found.where("src <> dst")).join(reps.select("id", "rep"), "id"))
    lowest = stage(comps.groupBy("component").agg(F.min("rep").alias("low")))
    per = reps.select("dim", "digest", "id", "rep", "n").join(counts, "id", "left").join(comps.join(lowest, "component").select("id", "low"), "id", "left")
    per = per.select("dim", "digest", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    drop(made, pairs)
    out = seen.select("vec_id", "dim", "digest").join(per, ["dim", "digest"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
