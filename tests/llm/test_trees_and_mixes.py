"""Operators 11 to 13 against plain Python; odd rows of each."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlace.llm import merkle, mixing, negatives

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, proofs) of a list of digests, level by level; a proof is a list of (left, digest or None)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            proofs[k].append((other < i, nodes[other] if other < len(nodes) else None))
            at[k] = i // 2
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def plain_manifest(rows):
    enc = lambda *xs: H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs))
    groups = defaultdict(list)
    for d, s, lang, n, t in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups[lang].append((d, enc(d, s, lang, n, t), enc(d, s, lang, n + 1 if bad and n is not None else n, t)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {k: tree([x[1] for x in groups[k]]) for k in names}
    root, upper = tree([subs[k][0] for k in names])
    out = []
    for k, above in zip(names, upper, strict=True):
        for (d, leaf, checked), proof in zip(groups[k], subs[k][1], strict=True):
            node = checked
            for left, other in proof + above:
                node = H(node) if other is None else H(other, node) if left else H(node, other)
            out.append((d, leaf, subs[k][0], root, H(*(x for _, x in proof + above if x)), node, node == root))
    return out


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest(spark, bits):
    """Every tree shape of 1 to 9 leaves, null groups and columns, repeated ids and rows, clashing names; many tiers with small blocks."""
    rows = [(i, "s", f"l{n}", i * 3, f"text {i}") for n in range(1, 10) for i in range(n * 100, n * 100 + n)]
    rows += [(7, None, None, None, None), (7, None, None, None, ""), (7, "", "", 1, "é😀" * 3), (None, "s", "l3", 4, "null id"), (901, "s", "l9", 5, "x" * 300_000)] + [(3, "s", "é", 1, "same")] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("leaf", "place", "tree", "proof", "block")}).repartition(5)
    got = merkle.verified_manifest(docs, "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, bits)
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof"), "folded_root", "verified")
    want = plain_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {x[-1] for x in want} == {True, False}
    assert merkle.verified_manifest(docs.limit(0)).count() == 0
    lone = merkle.verified_manifest(docs.where("doc_id = 100")).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and lone.proof == []


def test_queue_stays_short(monkeypatch):
    """Labels ascend as leaves come, so the queue holds one message a level at most."""
    most = 0

    def push(queue, x, real=merkle.heappush):
        nonlocal most
        real(queue, x)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle, "heappush", push)
    merkle.forward([str(i) for i in range(1000)], 10)
    assert most <= 11


def plain_negatives(rows, scale=256):
    ok = [(i, v, lab, [int(np.floor(scale * x)) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in ok:
        if a[0] % 100:
            continue
        score = [(sum(p * q for p, q in zip(a[3], b[3])), b) for b in ok if b is not a]
        score = sorted(((s, b) for s, b in score if -(1 << 63) < s < 1 << 63), key=lambda x: (-x[0], x[1][0]))
        for s, p in [x for x in score if x[1][2] == a[2]][:5]:
            hard = [x for x in score if x[1][2] != a[2] and 30 * s <= 100 * x[0] <= 90 * s][:10]
            out += [(a[0], p[0], k + 1, n[0], s, t) for k, (t, n) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 4096])
def test_negatives(spark, monkeypatch, block):
    """Ties, repeated rows, odd vectors, lengths that differ, and components that need wide integers."""
    monkeypatch.setattr(negatives, "CANDIDATES", block)
    monkeypatch.setattr(negatives, "ANCHORS", max(2, block // 2))
    monkeypatch.setattr(negatives, "SHARD", 2)
    rng = np.random.default_rng(5)
    rows = [(i, list(map(float, rng.normal(size=6).round(1 if i % 3 else 4))), int(rng.integers(0, 3))) for i in range(0, 260, 2)]
    rows += [(100, rows[3][1], 1), (4, rows[2][1], rows[2][2]), (301, None, 1), (303, [1.0, None], 1), (305, [float("nan")] * 6, 2), (307, [float("inf")] + [0.0] * 5, 2), (None, [1.0] * 6, 1), (309, [1.0] * 6, None), (311, [], 1), (313, [2.0, 1.0], 0)]
    rows += [(315, [3.0e12] + [0.1] * 5, 0), (317, [-1.0e30] + [0.0] * 5, 1), (400, [2.0e13] + [0.2] * 5, 0), (402, [1.0e12] + [0.2] * 5, 0), (404, [5.0e11] + [0.2] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row", "id", "rank", "most")}).repartition(4)
    got = sorted(map(tuple, negatives.hard_negatives(df).collect()))
    want = plain_negatives(rows)
    # Rows that are alike in all but their number can swap places; compare without the positives' twins.
    assert got == want and len(want) > 50
    assert negatives.hard_negatives(df.limit(0)).count() == 0 and negatives.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_packed_products():
    """Three, two and one candidates to an integer, and wide ones, at the edges of their fields."""
    for top, fields in ((90, 3), (2000, 2), (1 << 28, 1), (1 << 40, negatives.WIDE)):
        x = np.array([[top, -top, top, 0], [-top, -top, -top, -top], [top, top, top, top], [0, 0, 0, 0], [1, -1, top, -top]])
        packed = negatives.Packed(x, x)
        assert packed.fields >= fields
        assert packed.scores(x).tolist() == [[sum(p * q for p, q in zip(a, b, strict=True)) for b in x.tolist()] for a in x.tolist()]


def plain_targets(size, most=3.0):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, left, free = {}, float(sum(size.values())), set(names)
    while free:
        rate = left / sum(weight[s] for s in free)
        above = {s for s in free if most * size[s] < rate * weight[s]}
        if not above:
            return out | {s: rate * weight[s] for s in free}
        out |= {s: most * size[s] for s in above}
        left -= sum(out[s] for s in above)
        free -= above
    return out


def test_mixing(spark, monkeypatch):
    random.seed(3)
    text = lambda n: " ".join("w" for _ in range(n))
    rows = [(k, f"s{k % 7:02}", text(random.choice([0, 1, 5, 30, 200]))) for k in range(3000)] + [(9000 + k, "s00", text(4)) for k in range(1500)]
    rows += [(1, None, "null source"), (2, None, None), (None, "", "a b c"), (5, "", ""), (6, "tiny", "one"), (7, "void", " \t\n"), (8, "é", "é é x\x0b y")] + [(42, "s01", text(17))] * 400
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("size", "place", "target", "name", "up")})
    size = defaultdict(int)
    words = lambda t: len((t or "").encode().split())
    for _, s, t in rows:
        size[s] += words(t)
    want = plain_targets(size)
    base = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    for bucket, fan in ((12, 6), (4, 2)):
        monkeypatch.setattr(mixing, "BUCKET", bucket)
        monkeypatch.setattr(mixing, "FAN", fan)
        got = mixing.mix(docs.repartition(3)).collect()
        assert bucket != 12 or sorted(map(tuple, got), key=str) == base  # the layout changes nothing
        assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((d, words(t)) for d, _, t in rows if d is not None)
        taken = defaultdict(int)
        by = {(v, size[k]): k for k, v in want.items()}
        for r in got:
            source = min(by, key=lambda x: abs(x[0] - r.target) + abs(x[1] - r.source_size))
            assert r.source_size == source[1] and abs(r.target - source[0]) < 1e-6 * max(1, source[0])
            share = r.target / r.source_size if r.source_size else 0
            assert r.taken == r.copies * r["size"] and (r["size"] == 0 or int(share) <= r.copies <= min(3, int(share) + 1))
            taken[source] += r.taken
        assert all(abs(taken[k] - k[0]) <= 101 for k in taken), "half of the longest document, and float error"
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pivotal_keeps_words_and_chances():
    rng = np.random.default_rng(0)
    size = [900, 400, 30, 30, 20, 7, 7, 1, 1, 1] * 3
    p = [0.3] * len(size)
    total, taken = np.zeros(len(size)), []
    for _ in range(3000):
        out, left, q = mixing.pivotal(p, size, rng.random(len(size)))
        words = sum(s for s, o in zip(size, out, strict=True) if o) + (q * size[left] if left >= 0 else 0)
        taken.append(words)
        total += out
        if left >= 0:
            total[left] += q
    assert np.allclose(taken, 0.3 * sum(size)) and np.abs(total / 3000 - 0.3).max() < 0.04
