"""The pipeline's stages on a small fixture against plain Python."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from overlace.llm.queries import tokenizer_path
from overlace.llm.wordtok import WordEncoder


def test_stages(spark, tmp_path):
    random.seed(1)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(3000)]
    good = lambda n=120: " ".join(random.choice(words) for _ in range(n)) + "."
    rows = [(i, good(), 1) for i in range(150)] + [(150 + i, " ".join(f"{w}***" for w in good().split()), 0) for i in range(60)]
    rows += [(300 + i, rows[i][1], 1) for i in range(20)] + [(320 + i, rows[i][1] + " one", 1) for i in range(20)] + [(400, good(20), 1), (401, None, 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs = docs.withColumns({c: F.lit(f"mine {c}") for c in ("score", "predicted", "n_words", "kept", "row", "digest", "document", "id")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        assert kept.where("score <> 'mine score' or kept <> 'mine kept' or row <> 'mine row'").isEmpty()
        sizes.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert not sizes[0] & set(range(150, 210)) and set(range(150)) <= sizes[0]
    assert 400 not in sizes[1] and set(range(150)) <= sizes[1]
    assert sizes[2] == set(range(150))
    encode = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.length.sum() == sum(len(encode(t)) // 4 + 1 for i, t, _ in rows if i < 150)


def test_rows_that_share_an_id(spark):
    random.seed(2)
    text = lambda: " ".join(f"w{random.randrange(5000)}" for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, c), (4, d), (4, c + " end"), (5, None), (5, ""), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (4, d), (5, None), (5, ""), (None, d), (None, d)], key=str)


def test_an_empty_table_goes_through(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
