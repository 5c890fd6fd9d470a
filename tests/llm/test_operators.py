"""Each operator against a brute-force version, an exact round trip or held-out accuracy; edge cases of all."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlace.llm import bpe, chat, embeddings, gam, lbl, minhash, packing, rules, tokenout, urls
from overlace.llm.queries import URL_RULES, tokenizer_path
from overlace.llm.queries import queries as llm_queries
from overlace.llm.wordtok import WordEncoder

ODD = ["", " ", "\n\n", "a", "one two", "Zoë\x1cnaïve ﬁ Σας <|endoftext|> x's 12½", "x" * 30_000, "the cat sat on the mat\n" * 500, "ＡＢ 漢字 😀 a\u0301"]
TOKENIZER = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(ODD)] + [(3, "a", None, None, 7), (3, "a", None, None, 7), (None, "null id", "en", "s", 7), (90, None, "en", None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


def test_urls(spark):
    given = ["http://a.NET/x", "https://example.net/en/1?q", "https://www.example.net/e", "http://example.com/de/", "http://notexample.com/de/", "http://b.org/fr/#x", "no scheme", None, "http://net", "x://y://net/", "http://" + "a." * 500 + "net/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given)] + [(1, given[1], "clash")], "page_id long, url string, rule string")
    known = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = sorted((r.page_id, r.host[-20:], r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, known).collect())

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
        path = rest[len(host) :]
        path, host = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])], host.lower()
        fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host[-20:], path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == sorted([(i, *judge(u)) for i, u in enumerate(given)] + [(1, *judge(given[1]))], key=lambda x: x[:3])
    assert urls.judge_urls(pages, known.limit(0)).where("verdict = 'allow'").count() == len(given) + 1
    assert urls.judge_urls(pages.limit(0), known).count() == 0
    own = urls.judge_urls(pages.withColumns({"b_host": F.lit(1), "digest": F.lit(2), "verdict": F.lit(3)}), known)
    assert own.columns == ["page_id", "url", "b_host", "digest", "host", "path", "rule", "verdict"] and own.count() == len(given) + 1


def test_urls_join_on_the_short_prefix(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://example.com/de/")], "page_id long, url string")
    known = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    want = sorted(urls.judge_urls(pages, known).select("page_id", "rule").collect())
    monkeypatch.setattr(urls, "_short", lambda digest: F.length(digest).cast("long"))  # every prefix collides
    assert sorted(urls.judge_urls(pages, known).select("page_id", "rule").collect()) == want == [(1, "net/"), (2, "example.com/de/")]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    x = [list(map(float, b + rng.normal(size=8) * s)) for b in base for s in (0, 0, 0.15, 0.25)] + [[0.0] * 8, [float("nan")] * 8, None, [], [1.0, None], [1.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, 0.9, block=16, leaf=4).collect()}
    n = len(x)
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in x]
    link = lambda a, b: ok[a] and ok[b] and len(x[a]) == len(x[b]) and np.dot(x[a], x[b]) / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.9
    near = [{b for b in range(n) if a != b and link(a, b)} for a in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[a], *(label[b] for b in near[a])]) for a in range(n)]
    assert got == {a: (len(near[a]), label[a], label[a] == a) for a in range(n)}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_ids_that_repeat(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.0, 2.0]), (8, [0.01, 1.0]), (8, [0.01, 1.0]), (None, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n_links": F.lit("clash"), "digest": F.lit(0)}).repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, 0.9).collect()), key=str)
    want = [(5, 1, 5, True), (5, 3, 5, True), (6, 1, 5, False), (7, 3, 5, False), (8, 3, 5, False), (8, 3, 5, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_rules_counts(spark, odd):
    got = rules.quality_rules(odd, keep_text=True)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "score"] and got.count() == odd.count()
    for r in got.collect():
        t = r.text or ""
        ws = [w.decode() for w in t.encode().split()]
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept if r.base_failed else True)
    assert rules.quality_rules(odd.limit(0)).count() == 0
    names = ["_w", "w", "h", "row", "t", "p", "s", "ls", "again", "of_lang", "metric", "symbol_rate_low", "Kept", "n_lines"]
    clash = rules.quality_rules(odd.withColumns({c: F.lit("mine") for c in names}))
    assert clash.columns == ["doc_id", "text", "lang", "source", "score", *[c for c in names if c != "Kept"], *rules.COLUMNS, "base_failed", "kept"]
    assert clash.where(" and ".join(f"`{c}` = 'mine'" for c in names if c != "Kept")).count() == odd.count()


def test_word_encoder():
    from tokenizers import Tokenizer

    plain, ordinary = Tokenizer.from_file(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    ordinary.encode_special_tokens = True
    encode, as_text = WordEncoder(TOKENIZER, most_bytes=20_000), WordEncoder(TOKENIZER, special_as_text=True)
    random.seed(2)
    letters = "abcXYZ ''.,!12éßÀ\n\t漢\u00a0\u0301Σ-"
    marks = ["a<|endoftext|>b", "<|startoftext|> x <|EndOfText|>", "x<|endoftext|><|endoftext|>é", "<|endoftext", "  <|startoftext|>\n"]
    for t in ODD + marks + ["".join(random.choice([*letters, *marks]) for _ in range(200)) for _ in range(200)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(as_text(t), "<u4").tolist() == ordinary.encode(t, add_special_tokens=False).ids


def test_word_encoder_encodes_parts_once():
    """The same parts in other case or beside other signs go to the model once; often used ones stay when the memos turn over."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    random.seed(3)
    stems = ["".join(random.choice("abcdeé") for _ in range(9)) for _ in range(50)]
    texts = [" ".join(random.choice(["{}", "{},", "({})", "{}'s."]).format(random.choice([str, str.upper, str.title])(w)) for w in stems) for _ in range(40)]
    rare = [" ".join(["often", *(f"{a}{k:03x}".translate(str.maketrans("0123456789", "ghijklmnop")) for a in "qrstuvwxyz")]) + " \u6f22" * (k % 7 == 0) for k in range(300)]
    for most_bytes, given in ((64 << 20, texts), (40_000, rare)):
        encode, seen = WordEncoder(TOKENIZER, most_bytes=most_bytes), []
        inner = encode._plain_ids
        encode._plain_ids = lambda parts: seen.extend(parts) or inner(parts)
        got = list(encode.many(given, chars=500))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in given]
        assert len(seen) == len(set(seen)) and set(stems if given is texts else ["often"]) <= set(seen)
        assert [encode(t) for t in given[:5]] == got[:5]


@pytest.mark.parametrize("capacity", [8, 4096])
def test_packing(spark, odd, capacity):
    docs = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100).repartition(3))
    got = packing.pack(docs, TOKENIZER, capacity=capacity, docs_per_group=5).toPandas()
    encode = WordEncoder(TOKENIZER)
    by = {r.doc_id: encode(r.text or "") + (2).to_bytes(4, "little") for r in docs.where("doc_id is not null and doc_id not in (3, 103)").collect()}
    for d, data in by.items():
        p = got[got.doc_id == d].sort_values("start")
        assert p.length.sum() == len(data) // 4 == p.doc_tokens.iloc[0] and (p.start == p.length.cumsum() - p.length).all()
        assert [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(p.start, p.length, strict=True)] == p.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= capacity and (s.offset == s.length.cumsum() - s.length).all()
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_trees_agree_with_plain_loops():
    random.seed(3)
    lengths = [random.randint(1, 50) for _ in range(300)]
    room, want = [], np.zeros(300, int)
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        want[i] = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if want[i] == len(room):
            room.append(50)
        room[want[i]] -= lengths[i]
    assert packing.first_fit_decreasing(np.array(lengths), 50)[0].tolist() == want.tolist()
    bins = tokenout.best_fit_decreasing(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(300)) and max(sum(lengths[i] for i in b) for b in bins) <= 50
    room = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [b for b, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            room.append(50)
            fits = [len(room) - 1]
        room[min(fits, key=lambda b: room[b])] -= lengths[i]
    assert sorted(50 - sum(lengths[i] for i in b) for b in bins) == sorted(room)


def test_bpe(spark, odd):
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, public_tokenizers.PATTERN)
    random.seed(4)
    for t in ODD + ["".join(random.choice("ab1.' \n\t\x1c\u00a0é漢") for _ in range(400)) for _ in range(200)]:
        assert bpe.encode(enc, t, 20) == enc.encode_ordinary(t)
    greedy = bpe.encoding(path, r"[^\s\p{L}]+[ \n]*|\p{L}+|\s+")  # swallows what follows, so no place is known to be safe
    assert bpe.encode(greedy, "a.\nb. c " * 30, 20) == greedy.encode_ordinary("a.\nb. c " * 30)
    assert bpe.PATTERN == public_tokenizers.PATTERN and bpe.encode_documents(odd.limit(0), path, bpe.PATTERN).count() == 0
    got = bpe.encode_documents(odd, path, public_tokenizers.PATTERN, with_ids=True)
    assert got.count() == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
        want = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest() and list(r.ids) == want.tolist()
    assert {r.doc_id: r.text for r in bpe.decode_documents(got, path, public_tokenizers.PATTERN).collect()} == texts


def test_gam(spark, odd):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction alone
    model = gam.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = gam.fit(x[:10], np.ones(10))
    assert (one.score(x) > 0.5).all() and gam.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    labels = spark.createDataFrame([(0, 0), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = gam.classify(odd, gam.learn(odd, labels), ["doc_id"])
    assert got.count() == odd.count() and got.where("score between 0 and 1").count() == odd.count()
    model = gam.learn(odd, labels)
    clash = odd.withColumns({"predicted": F.lit("x"), "_text": F.lit("not this")})
    got = gam.classify(clash, model, clash.columns, keep_text=True)
    assert got.columns == ["doc_id", "text", "lang", "source", "_text", "score", "predicted"] and got.where("score between 0 and 1").count() == odd.count()
    assert gam.classify(clash, model, clash.columns, keep_text=True, names=("a", "b")).columns == [*clash.columns, "a", "b"]
    assert gam.classify(odd.limit(0), gam.learn(odd.limit(0), labels), ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_gam_on_held_out_labels(spark):
    from overlace.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(good) > 20 and len(bad) > 5
    auc = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)
    assert auc > 0.95 and (got.predicted == got.quality).mean() > 0.9


def test_token_output(spark, odd, tmp_path):
    got = tokenout.packed_sequences(odd, TOKENIZER, capacity=64, docs_at_once=4)
    encode, back = WordEncoder(TOKENIZER), {}
    for r in got.collect():
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 64 and zlib.crc32(r.input_ids) == r.ids_crc32
        assert tokenout.position_ids(r.cu_seqlens, r.position_starts).tolist() == [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back.setdefault(d, {})[s] = ids[a:b].tolist()
    for r in odd.where("doc_id is not null").collect():
        assert [i for s in sorted(back[r.doc_id]) for i in back[r.doc_id][s]] == np.frombuffer(encode(r.text or ""), "<u4").tolist() + [2]
    small = tokenout.packed_sequences(odd, TOKENIZER, capacity=64, bytes_at_once=100)
    assert small.agg(F.sum("n_tokens")).first() == got.agg(F.sum("n_tokens")).first() and tokenout.packed_sequences(odd.limit(0), TOKENIZER).count() == 0
    tokenout.write_packed(got, str(tmp_path / "packed"), 64)
    assert {len(r.input_ids) for r in spark.read.parquet(str(tmp_path / "packed")).collect()} == {256}


def _near(texts, n, percent=80):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_minhash(spark, odd):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base, rows = [random.choice(vocabulary) for _ in range(150)], []
    for i in range(120):
        w = list(base)
        for _ in range(random.choice([0, 2, 5, 8, 11, 13])):
            w[random.randrange(150)] = random.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(random.choice(vocabulary) for _ in range(80)) + " " + " ".join(base[:60])) for i in range(120, 150)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2).collect()} == _near(rows, 2)
    got = minhash.near_duplicates(odd, 5)
    assert got.count() == odd.count() and got.where("doc_id is null and component_id is null and kept").count() == 1


def test_parity_sketch_is_a_bound():
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n in (0, 1, 40, 400, 4000):
        for kept in (0, n // 2, n):
            a = new(n)
            b = np.concatenate([a[:kept], new(int(rng.integers(0, 300)))])
            places = int(np.bitwise_count((minhash._parity(a) ^ minhash._parity(b)).view(np.uint64)).sum())
            assert places <= len(np.setxor1d(a, b))


def test_pairs_that_sketches_rule_out(spark):
    rng = np.random.default_rng(4)
    # 150 shingles: 8 own ones each leave 142 of 158 in common (0.899), 20 own ones 130 of 170 (0.765).
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.concatenate([base[: 150 - own], rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for own in (0, 8, 20)]
    rows = [(i, 150, [0] * 9 + minhash._parity(s).tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, n long, sig array<long>")
    got = df.alias("x").join(df.alias("y"), F.expr(f"x.id < y.id and {minhash.alike('x', 'y', 72, 80)}")).select("x.id", "y.id").collect()
    assert [tuple(r) for r in got] == [(0, 1)]


def test_minhash_of_ids_that_repeat(spark):
    random.seed(11)
    a, b = (" ".join(f"w{random.randrange(3000)}" for _ in range(300)) for _ in range(2))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, b), (9, "alone"), (9, "alone"), (9, None), (10, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit("clash"), "halves": F.lit(1)}).repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, 5).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True), (9, 9, True), (10, 9, False)]
    assert minhash.near_duplicates(df.limit(0), 5).count() == 0


def test_blocks_against_components(spark):
    rng = np.random.default_rng(12)
    base = np.sort(rng.integers(0, 2**62, 100))
    near = [np.sort(np.concatenate([base[: 100 - k], rng.integers(0, 2**62, k)])) for k in range(0, 40, 2)]
    sig = rng.integers(-(2**62), 2**62, 9)
    other = rng.integers(-(2**62), 2**62, 9)
    rows = [(i, 100, (sig if i < 18 else other).tolist(), s.tolist()) for i, s in enumerate(near)]
    about = spark.createDataFrame(rows, "id long, n long, sig array<long>, s array<long>")
    comps = spark.createDataFrame([(i, 1) for i in range(1, 20)], "id long, component long")
    work = spark.createDataFrame([(0, 1, 19), (19, 1, 19)], "id long, to long, to_k long")
    args = work, comps, about.drop("s"), about.select("id", "s"), 72, 80
    few, many = ({tuple(r) for r in minhash._against_components(*args, block=n).collect()} for n in (10_000, 100))
    linked = {(0, i) for i in range(1, 6)}  # 10 or fewer of 100 replaced: at least 90 of 110
    assert len(few & linked) == 1 and few <= linked | {(18, 19), (19, 19)} and len(few) < len(many)
    assert {p for p in many if 0 in p} <= linked


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi<|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, 70, "ann", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(1), "part": F.lit("x"), "c": F.lit("y")})
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(turns).collect()}
    assert chat.rotate(turns.limit(0)).count() == 0
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")} and got[None, "ann"].part == 0
    r = got[1, "ann"]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi< |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2
    assert [r.text[a:b] for a, b in zip(r.mask_starts, r.mask_ends)] == ["hi< |im_end|><|im_end|>"] and r.n_turns == 4
    assert got[1, "bob"].n_mask_chars == 20


def test_chat_parts_are_bounded(spark):
    turns = spark.range(1000).selectExpr("7L as conv_id", "cast(null as long) as turn", "if(id % 2 = 0, 'ann', 'bob') as role", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    turns = turns.unionByName(spark.range(300).selectExpr("8L as conv_id", "5 * id + 1000 as turn", "'ann' as role", "concat('n', id) as text")).repartition(5)
    got = chat.rotate(turns).toPandas()
    assert got.n_turns.max() == 64 and got.groupby(["conv_id", "perspective"]).n_turns.sum().to_dict() == {(7, "ann"): 1000, (7, "bob"): 1000, (8, "ann"): 300}
    last = got[got.conv_id == 8].sort_values("part")
    assert last.part.tolist() == [0, 1, 2, 3, 4] and "".join(last.text) == "".join(f"<|im_start|>assistant\nn{i}<|im_end|>\n" for i in range(300))


def test_lm(spark, odd):
    random.seed(6)
    follow = {f"a{i}": f"b{i}" for i in range(30)}
    rows = [(i, " ".join(f"{a} {follow[a]}" for a in random.choices(list(follow), k=40)) + f" rare{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lbl.score_documents(df, n_classes=50, head=40).toPandas().set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts: dict = {}
    for i, t in rows:
        if not held[i]:
            for w in [*t.split(), ""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        ws, r = [*t.split(), ""], got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws))
    assert got.score.sum() > got.base_score.sum()
    few = lbl.score_documents(df, n_classes=50, head=8).toPandas().set_index("doc_id")
    assert few.base_score.sort_index().tolist() == pytest.approx(got.base_score.sort_index().tolist()) and few.n_known.sum() == got.n_known.sum()
    some = lbl.score_documents(odd)
    assert some.count() == odd.count() and some.where("isnan(score) or score > 0").count() == 0
    assert lbl.score_documents(odd.limit(0)).count() == 0


def test_lm_scores_recomputed(spark, monkeypatch):
    """The scores of the query's plan against a direct sum over tokens with the model that it trained."""
    random.seed(13)
    rows = [(i, " ".join(random.choices([f"w{k}" for k in range(60)], weights=[60 - k for k in range(60)], k=30)) + f" r{i % 50} once{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, train = [], lbl.train_model
    monkeypatch.setattr(lbl, "train_model", lambda docs, known, unigram, n: made.append((train(docs, known, unigram, n), known)) or made[-1][0])
    got = {r.doc_id: r.score for r in lbl.score_documents(df, n_classes=20, head=30, least_count=8).collect()}
    model, known = made[0]
    counts: dict = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*(w.encode() for w in t.split()), b""]:
                counts[w] = counts.get(w, 0) + 1
    out = [w for w in counts if w not in known]
    mass, rest = sum(counts[w] for w in out) + len(out) + 1, len(known)
    assert rest > 40 and len(out) > 150
    for i, t in rows:
        ids, total = [rest + 1] * 2, 0.0  # the start, twice
        for w in [*(w.encode() for w in t.split()), b""]:
            k = known.get(w, rest)
            total += float(model.log_probability(*(np.array([x]) for x in (ids[-1], ids[-2], k)))[0]) / np.log(10)
            total += np.log10((counts.get(w, 0) + 1) / mass) if k == rest else 0
            ids.append(k)
        assert got[i] == pytest.approx(total, abs=1e-3)


def test_lm_is_normalised():
    rng = np.random.default_rng(8)
    m = lbl.Model(np.full(20, 0.05))
    m.load(rng.normal(size=m.flat().size))
    c1, c2 = rng.integers(0, 21, 50), rng.integers(0, 21, 50)
    logs = m.predict(c1, c2) @ m.Q.T + m.b - m.normaliser()(c1 * 21 + c2)[:, None]
    assert np.exp(logs).sum(1) == pytest.approx(np.ones(50), rel=1e-4)


def test_lm_words_follow_the_corpus(spark):
    random.seed(9)
    tokens = [f"w{k}" for k in range(2000)] * 12  # all equally frequent, so the base scores of single words agree
    random.shuffle(tokens)
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, " ".join(tokens[k :: len(ids)])) for k, i in enumerate(ids)] + [(None, f"w{k}") for k in range(2000)]
    got = lbl.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("doc_id is null").toPandas()
    assert got.base_score.round(6).nunique() == 1 and got.score.nunique() > 1900


def test_lm_words_and_classes_are_normalised():
    rng = np.random.default_rng(8)
    unigram = rng.random(90)
    m = lbl.Model(unigram / unigram.sum(), lbl._classes(unigram))
    m.load(rng.normal(size=m.flat().size))
    assert 1 < len(m.first) < 20 and m.size[-1] == 1
    c1, c2 = np.repeat(rng.integers(0, 91, (2, 30)), 90, axis=1)
    assert np.exp(m.log_probability(c1, c2, np.tile(np.arange(90), 30))).reshape(30, 90).sum(1) == pytest.approx(np.ones(30), rel=1e-4)


def test_lm_learns_alike_from_any_layout(spark, monkeypatch):
    """Shares of 12 000 tokens, so several tasks train in each round, from one partition and from 40."""
    random.seed(10)
    rows = [(i, " ".join(f"x{(k := random.randrange(40))} y{k}" for _ in range(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = lbl.train_model
    monkeypatch.setattr(lbl, "train_model", lambda *a: train(*a, share_tokens=12_000))
    score = [lbl.score_documents(df.repartition(n, "doc_id")).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first() for n in (1, 40)]
    assert abs(score[0][0] - score[1][0]) < 0.02 < score[0][0] - score[0][1]


def test_lm_state_goes_from_round_to_round():
    m = lbl.Model(np.full(20, 0.05), np.array([0, 5, 12, 19]))
    rng = np.random.default_rng(1)
    m.train(rng.integers(0, 20, (3, 50)), np.ones(50, np.int64), rng)
    other = lbl.Model(np.full(20, 0.05), np.array([0, 5, 12, 19]))
    for kind, _, ids, _, x in m.pieces(1.0, block=7):
        other.put(kind, ids, x)
    assert np.allclose(m.flat(state=True), other.flat(state=True)) and not np.allclose(m.flat(), lbl.Model(np.full(20, 0.05), np.array([0, 5, 12, 19])).flat())
    again = lbl.Model(np.full(20, 0.05), np.array([0, 5, 12, 19]))
    again.load(m.flat(state=True))
    assert (again.flat(state=True) == m.flat(state=True)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(k for k in llm_queries() if k != "pipeline"))
def test_queries_give_whole_results(spark, name):
    """Every query with its production parameters: a row or more for each row of its table."""
    d = "/root/testdata/sf0.001"
    table, key = ("pages", "page_id") if name.startswith("op1_") else ("embeddings", "vec_id") if name.startswith(("op2_", "op12_")) else ("conversations", "conv_id") if name.startswith("op9_") else ("documents", "doc_id")
    got = llm_queries()[name](spark, d)
    if name.startswith("op12_"):
        assert got.select("anchor_id").distinct().count() == spark.read.parquet(f"{d}/{table}.parquet").where("vec_id % 100 = 0").count()
    elif name.startswith("op7_"):
        assert got.count() > 0
    else:
        assert got.select(key).distinct().count() == spark.read.parquet(f"{d}/{table}.parquet").select(key).distinct().count()
