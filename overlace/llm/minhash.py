"""8. MinHash near-dedup with tensored banding.

Two collections A and B of ``m`` small keys (``k`` minhashes each) are computed per document; table (i, j) has the key
A_i with B_j, so m * m tables of 2k minhashes cost 2 * m * k minhash computations instead of m * m * 2k. Documents of
similarity s meet with probability (1 - (1 - s^k)^m)^2: 0.9996 at s = 0.8 with the defaults and more above. Pairs that
meet are first held against a bound from parity sketches, which loses none, and against their signatures, which lose one at the similarity itself
with about 2e-6; full sets confirm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices, texts
from overlace.llm.words import WordHasher, mix, shingle_hashes, words
from overlace.operators.components import connected_components
from overlace.plans.lineage import cut, drop, stage

K, M = 3, 12

#: Bits of a parity sketch; it rules out pairs of sets of up to some 700 shingles and lets larger ones pass to the signatures.
PARITY = 512


def _minhashes(s: np.ndarray, xor: np.ndarray, odd: np.ndarray, block: int = 2048) -> np.ndarray:
    """The minimum of each of the hash functions over a set, in blocks, so that memory is bounded whatever the set's size."""
    low = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), block):
        np.minimum(low, ((s[i : i + block] ^ xor[:, None]) * odd[:, None]).min(1), out=low)
    return low


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parity(s: np.ndarray) -> np.ndarray:
    """One bit of each of the ``PARITY`` places, as longs: whether an odd number of the set's hashes falls there.

    An element of both sets flips the same place of both, so two sketches differ in no more places than the sets in
    elements. This bounds the similarity from above without error: no pair that reaches it is lost.
    """
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def signatures(docs: DataFrame, shingle: int, k: int, m: int, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, halves, sig); empty values without words.

    halves holds the m keys of A, then those of B; sig one byte of each minhash, eight in a long, then the parity sketch.
    """

    def run(batches):
        r = np.random.default_rng(seed).integers(1, 1 << 63, (2, 2 * m * k), dtype=np.uint64)
        xor, odd, hasher = r[0], r[1] | np.uint64(1), WordHasher()
        side = np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches):
            n, digests, halves, sigs = [], [], [], []
            for text in texts(batch):
                s = shingle_hashes(words(text), shingle, hasher)
                n.append(len(s))
                digests.append(_digest(s))
                if not len(s):
                    halves.append([])
                    sigs.append([])
                    continue
                low = _minhashes(s, xor, odd).reshape(2 * m, k)
                key = side.copy()
                for c in range(k):
                    key = mix(key + low[:, c])
                halves.append(key.view(np.int64))
                sigs.append(np.concatenate([np.pad((low.ravel() >> np.uint64(32)).astype(np.uint8), (0, -low.size % 8)).view(np.int64), _parity(s)]))
            yield {"doc_id": batch.column(0), "n_shingles": n, "digest": digests, "halves": halves, "sig": sigs}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, digest binary, halves array<long>, sig array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(n_shingles, digest, s): s are the sorted distinct shingle hashes."""

    def run(batches):
        hasher = WordHasher()
        for batch in slices(batches):
            sets = [shingle_hashes(words(t), shingle, hasher) for t in texts(batch)]
            yield {"n_shingles": [len(s) for s in sets], "digest": [_digest(s) for s in sets], "s": [s.view(np.int64) for s in sets]}

    return map_arrow(docs.select("text"), run, "n_shingles long, digest binary, s array<long>")


def _least_alike(n: int, percent: int) -> int:
    """How many of n minhashes two sets of the similarity share, less 4.6 standard deviations.

    A pair at the similarity itself fails this with a probability of about 2e-6, far below that of meeting in no table.
    """
    p = percent / 100
    return max(0, int(n * p - 4.6 * (n * p * (1 - p)) ** 0.5))


def alike(x: str, y: str, n: int, percent: int) -> str:
    """SQL for: x and y (structs of n and sig) may be alike by their sizes and sketches, and their n minhashes agree as often as ``_least_alike`` asks."""
    fold = "(({0} | shiftrightunsigned({0}, 4)) & 1085102592571150095L)"  # the bits of each byte gather in its lowest
    fold2 = "(({0} | shiftrightunsigned({0}, 2)) & 217020518514230019L)"
    fold1 = "(({0} | shiftrightunsigned({0}, 1)) & 72340172838076673L)"
    xor, minhashes = f"({x}.sig[{{}}] ^ {y}.sig[{{}}])", -(-n // 8)
    differ = " + ".join(f"bit_count({fold1.format(fold2.format(fold.format(xor.format(i, i))))})" for i in range(minhashes))
    odd = " + ".join(f"bit_count({xor.format(i, i)})" for i in range(minhashes, minhashes + PARITY // 64))
    sizes = f"least({x}.n, {y}.n) * 100 >= greatest({x}.n, {y}.n) * {percent}"
    return f"{sizes} and ({odd}) * {100 + percent} <= ({x}.n + {y}.n) * {100 - percent} and {n} - ({differ}) >= {_least_alike(n, percent)}"


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (id, s) reach the similarity."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in slices(batches, 512):
            a, b = batch.column(0), batch.column(1)
            sa, sb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = sa[i].values.to_numpy(zero_copy_only=False), sb[i].values.to_numpy(zero_copy_only=False)
                common = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield {"a": a.take(keep), "b": b.take(keep)}

    return map_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def _against_components(work: DataFrame, comps: DataFrame, about: DataFrame, sets: DataFrame, n_hashes: int, percent: int, block: int = 200_000) -> DataFrame:
    """Links (a, b) of the classes of ``work`` (id, to, to_k) to members of their component ``to``: one for each class and block with one.

    Classes meet in blocks of about ``block`` shingles on either side, so a row is bounded by that and by the largest set. Every
    pair of blocks has a key of its own, so no component gathers in one task. Sizes, sketches and signatures are compared first, sets where
    those fit, and only links leave a task, never the pairs.
    """
    held = about.join(sets, "id").select("id", "n", F.struct("id", "n", "sig", "s").alias("item"))
    bins = lambda name: F.ceil(F.sum("n") / block).alias(name)
    targets = work.select("to").distinct()
    ours = cut(work.join(about.select("id", "n"), "id").select("to", "id", "n"))
    other = cut(comps.join(targets, F.col("component") == F.col("to")).join(about.select("id", "n"), "id").select("to", "id", "n"))
    to = cut(ours.groupBy("to").agg(bins("xs")).join(other.groupBy("to").agg(bins("ys")), "to"))
    gather = lambda df, of: df.select("to", "id").join(to.select("to", of), "to").join(held, "id").groupBy("to", F.pmod(F.xxhash64("id"), F.col(of)).alias("at")).agg(F.collect_list("item").alias(of))
    mine = gather(ours, "xs").drop("at").join(to.select("to", "ys"), "to").select("to", "xs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("at"))
    least = _least_alike(n_hashes, percent)

    def unpack(rows):
        ids, n, sig, s = (rows.field(c) for c in ("id", "n", "sig", "s"))
        bytes_ = sig.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False).view(np.uint8).reshape(len(ids), -1)
        return ids.to_numpy(), n.to_numpy(), bytes_[:, :n_hashes], np.ascontiguousarray(bytes_[:, n_hashes + -n_hashes % 8 :]).view(np.uint64), s

    def run(batches):
        for batch in slices(batches, 1):
            (xi, xn, xs, xp, xe), (yi, yn, ys, yp, ye) = (unpack(batch.column(c)[0].values) for c in (0, 1))
            # All shingles of the second block in one sorted array with their owners: a set meets them all by one look-up.
            shingles = ye.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(shingles)
            shingles, owner = shingles[order], np.repeat(np.arange(len(yi)), yn)[order]
            a, b = [], []
            for k, (i, n) in enumerate(zip(xi.tolist(), xn.tolist(), strict=True)):
                near = np.flatnonzero(np.minimum(yn, n) * 100 >= np.maximum(yn, n) * percent)
                near = near[np.bitwise_count(yp[near] ^ xp[k]).sum(1) * (100 + percent) <= (yn[near] + n) * (100 - percent)]
                near = near[np.count_nonzero(ys[near] == xs[k], axis=1) >= least]
                if not len(near):
                    continue
                x = xe[k].values.to_numpy(zero_copy_only=False)
                common = np.zeros(len(yi), np.int64)
                for h in range(0, n, 4096):
                    lo, hi = (np.searchsorted(shingles, x[h : h + 4096], side) for side in ("left", "right"))
                    size = hi - lo
                    at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
                    common += np.bincount(owner[at], minlength=len(yi))
                linked = near[100 * common[near] >= percent * (n + yn[near] - common[near])]
                if len(linked):
                    j = int(yi[linked[0]])
                    a.append(min(i, j))
                    b.append(max(i, j))
            yield {"a": a, "b": b}

    return map_arrow(mine.join(gather(other, "ys"), ["to", "at"]).select("xs", "ys"), run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K, m: int = M, seed: int = 1, hubs_asked: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents are linked where 100 * |intersection| >= percent * |union| of their shingle sets (words of runs without
    ASCII white space, A-Z lower-cased). component_id is the smallest doc_id reachable, kept tells whether it is
    the row's own. Texts without words, null ones too, have no shingles and link with nothing; a row with a null doc_id is
    its own null component and kept. Rows that share a doc_id are documents of their own, linked by their texts alone. Other columns are dropped.

    Equal sets are merged first by a pre-aggregated minimum; a class is numbered, so ids that repeat do no harm. Half keys
    that one class alone holds meet nobody, so they leave before the tables are formed. Each bucket of each table has a hub (the least
    number after one of four exclusive-or masks, again pre-aggregated), and every class is compared first with the ``hubs_asked`` hubs
    that it shares most tables with, never with all others; pairs in one bucket that are still in different components afterwards are then compared by their signatures and,
    where those fit, exactly, in blocks where a component is large. So large groups of copies cost links in proportion to their size, and none is lost that a table
    holds, but for 2e-6 of pairs at the similarity itself by their signatures. Pairs whose sketches or signatures rule the similarity out, as those of texts that share one passage, leave before
    their sets are fetched; the comparison of these is quadratic in such a bucket.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = stage(signatures(docs, shingle, k, m, seed))
    classes = seen.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"), F.first("sig").alias("sig"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()))
    about = classes.select("id", F.col("n_shingles").alias("n"), "sig")

    half = classes.select("id", F.posexplode("halves").alias("p", "h"))
    common = cut(half.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h"))
    side = lambda which: F.collect_list(F.when(which, F.struct("p", "h")))
    shared = cut(half.join(common, "h").groupBy("id").agg(side(F.col("p") < m).alias("a"), side(F.col("p") >= m).alias("b")))
    tables = shared.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b"))
    masks = F.array(*[F.lit(x).cast("long") for x in (0, 0x5A5A5A5A5A5A5A, 0x33CC33CC33CC33, 0x6996699669966)])
    mask = masks[(F.col("a.p") % 2 * 2 + F.col("b.p") % 2).cast("int")]
    # A key names its table (its halves do), so all rows of a key have one mask.
    keys = tables.select(F.xxhash64("a.h", "b.h").alias("key"), F.col("id").bitwiseXOR(mask).alias("x"), mask.alias("mask"))
    hubs = cut(keys.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("key", "lo"))
    members = stage(keys.join(hubs, "key").select("key", F.col("x").bitwiseXOR(F.col("mask")).alias("id"), F.col("lo").bitwiseXOR(F.col("mask")).alias("hub")))
    drop(common, shared, hubs)

    n_hashes = 2 * m * k
    fits = alike("x", "y", n_hashes, percent)
    one = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # The hubs that share most tables with a class are those most like it; a class has at most m * m.
    met = members.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("shared"))
    nearest = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "hub")), asc=False), 1, hubs_asked).alias("near"))
    nearest = nearest.select("id", F.explode("near.hub").alias("hub"))
    pairs = nearest.select(*one(F.col("id"), F.col("hub"))).distinct()
    sides = [about.select(F.col("id").alias(c), F.struct("n", "sig").alias(v)) for c, v in (("a", "x"), ("b", "y"))]
    pairs = cut(pairs.join(sides[0], "a").join(sides[1], "b").where(fits).select("a", "b"))

    asked = cut(members.select("id").distinct().join(classes.select("id", "rep", "digest", "n_shingles"), "id"))
    sets = shingle_sets(docs.join(asked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle)
    sets = sets.groupBy("digest", "n_shingles").agg(F.first("s").alias("s"))
    sets = stage(sets.join(asked.select("digest", "n_shingles", "id"), ["digest", "n_shingles"]).select("id", "s"))
    comps = connected_components(links := cut(_confirm(pairs, sets, percent)), "a", "b")

    # What a bucket still holds apart: classes of different components. Two lone ones are a pair; a class and a
    # component of several are a piece of work for blocks of signatures, so no pairs are made within large groups.
    grown = comps.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    known = cut(comps.withColumnRenamed("component", "c").join(grown, "c"))
    labelled = members.select("key", "id").join(known, "id", "left").withColumns({"c": F.coalesce("c", "id"), "k": F.coalesce("k", F.lit(1))})
    apart = cut(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"))
    rest = stage(labelled.join(apart, "key").distinct())
    lone = rest.where("k = 1").select("key", "id").join(classes.select("id", F.col("n_shingles").alias("n"), "sig", "halves"), "id")
    # Of all tables that hold a pair only the first one makes it.
    first = lambda at: f"array_position(zip_with(slice(x.halves, {at}, {m}), slice(y.halves, {at}, {m}), (p, q) -> p = q), true) + {at - 2}"
    once = f"x.key = xxhash64(get(x.halves, cast({first(1)} as int)), get(x.halves, cast({first(m + 1)} as int)))"
    more = lone.alias("x").join(lone.alias("y"), F.expr(f"x.key = y.key and x.id < y.id and {fits} and {once}"))
    more = more.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    target = rest.where("k > 1").select("key", F.col("c").alias("to"), F.col("k").alias("to_k")).distinct()
    work = cut(rest.join(target, "key").where("c <> to and (k < to_k or (k = to_k and c < to))").select("id", "to", "to_k").distinct())
    more = cut(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    late = cut(_confirm(more, sets, percent).unionByName(_against_components(work, comps, about, sets, n_hashes, percent)))
    if not late.isEmpty():
        stars = comps.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        comps = connected_components(stars.unionByName(late), "a", "b")
    named = stage(comps.join(classes.select("id", "rep"), "id"))
    lowest = stage(named.groupBy("component").agg(F.min("rep").alias("low")))
    drop(members, pairs, asked, sets, links, known, apart, rest, work, more, late)

    label = classes.select("digest", "n_shingles", "id", "rep").join(named.join(lowest, "component").select("id", "low"), "id", "left")
    label = label.select("digest", "n_shingles", F.coalesce("low", "rep").alias("component"))
    out = seen.select("doc_id", "n_shingles", "digest").join(label, ["digest", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
