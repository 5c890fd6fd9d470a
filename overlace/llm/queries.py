"""One query per operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlace.llm import bpe, chat, embeddings, gam, lbl, merkle, minhash, mixing, negatives, packing, rules, tokenout, urls
from overlace.llm.common import fold, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str) -> str:
    """The vocabulary files of the installed public tokenizers; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), known).select("page_id", "host", "path", "rule", "verdict")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return rules.quality_rules(docs, keep_text=False).select("doc_id", *rules.COLUMNS, "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.learn(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return gam.classify(docs, model, ["doc_id"]).select("doc_id", held, "score", "predicted")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.packed_sequences(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.verified_manifest(table(spark, sf_dir, "documents"), "lang", tampered)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filters, op2_embedding_dedup, op3_quality_rules, op4_packing, op5_byte_bpe, op6_quality_classifier, op7_token_output, op8_minhash_dedup, op9_chat_rotation, op10_lm_scoring, op11_merkle_manifest, op12_hard_negatives, op13_mixing, pipeline)}


_SPLIT = urls.SPLIT
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')"

OP1 = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_SPLIT}', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{_SPLIT}', 2) AS path, row_number() OVER () AS k FROM pages),
r(rh, rp, action) AS (VALUES {', '.join(map(str, URL_RULES))}),
hit AS (
  SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN hit USING (k)
"""

_CELLS = " UNION ALL ".join(
    f"SELECT lang, source, '{k}' AS metric, {e} AS x FROM m WHERE n_words > 0"
    for k, e in {"symbol_rate": "n_symbols / n_words", "word_length": "word_chars / n_words", "dup_line_rate": "n_dup_lines / n_lines", "repeat_rate": "n_repeat_words / n_words"}.items()
)
_LEAST = " ".join(f"WHEN '{k}' THEN {v}" for k, (_, v) in rules.METRICS.items())
_BACK = f"CASE WHEN {{0}} = {rules.ZERO} THEN 0 ELSE exp({{0}} / {rules.STEP}) END"


def _quartiles(by: str) -> str:
    """Quartiles of the bucketed values by definition: the least bucket that a quarter, or three, of the rows do not exceed."""
    keys = f"{by}, metric" if by else "metric"
    cells = f"SELECT {keys}, b, sum(count(*)) OVER (PARTITION BY {keys} ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY {keys}) AS total FROM x GROUP BY {keys}, b"
    return f"SELECT {keys}, any_value(total) AS total, {_BACK.format('min(b) FILTER (upto * 4 >= total)')} AS q25, {_BACK.format('min(b) FILTER (upto * 4 >= total * 3)')} AS q75 FROM ({cells}) GROUP BY {keys}"


OP3 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls, row_number() OVER () AS k FROM documents),
win AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
m AS (SELECT k, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(ls) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (k)),
x AS (SELECT *, CASE WHEN x > 0 THEN ceil(ln(x) * {rules.STEP})::INT ELSE {rules.ZERO} END AS b FROM ({_CELLS})),
f AS ({_quartiles('lang, source')}), l AS ({_quartiles('lang')}), e AS ({_quartiles('')}),
q AS (SELECT f.lang, f.source, f.metric,
             CASE WHEN f.total >= 200 THEN f.q25 WHEN l.total >= 200 THEN l.q25 ELSE e.q25 END AS q25,
             CASE WHEN f.total >= 200 THEN f.q75 WHEN l.total >= 200 THEN l.q75 ELSE e.q75 END AS q75
      FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang AND f.metric = l.metric JOIN e ON f.metric = e.metric),
g AS (SELECT *, 3.0 * greatest(q75 - q25, CASE metric {_LEAST} END) AS d FROM q),
out AS (SELECT DISTINCT k FROM m JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
        WHERE n_words > 0 AND CASE metric WHEN 'symbol_rate' THEN n_symbols / n_words > q75 + d WHEN 'dup_line_rate' THEN n_dup_lines / n_lines > q75 + d
              WHEN 'repeat_rate' THEN n_repeat_words / n_words > q75 + d ELSE word_chars / n_words > q75 + d OR word_chars / n_words < q25 - d END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND out.k IS NULL AS kept
FROM m LEFT JOIN out USING (k)
"""

OP2 = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
ok AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM e WHERE n > 0 AND isfinite(n)),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.u, b.u) >= 0.9),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
deg AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON id = vec_id LEFT JOIN deg ON a = vec_id
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, t FROM (
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = r"""
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), '[\r\n]', ' ', 'g') AS role,
                  replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM t),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
x AS (SELECT conv_id, perspective, floor(place / 64)::BIGINT AS part, place, turn, role, text, role = perspective AS own,
             '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
             text || '<|im_end|>' AS body FROM n JOIN p ON conv_id IS NOT DISTINCT FROM c),
y AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(list((pos + length(head))::INT ORDER BY pos) FILTER (own), []) AS mask_starts, coalesce(list((pos + length(head) + length(body))::INT ORDER BY pos) FILTER (own), []) AS mask_ends,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_mask_chars
FROM y GROUP BY conv_id, perspective, part
"""

OP11 = """
WITH RECURSIVE d AS (SELECT *, doc_id::VARCHAR AS s FROM documents),
crc AS (SELECT *, xor(list_reduce(list_transform(range(8 * strlen(s)), lambda k: CASE WHEN k % 8 = 0 THEN ascii(s[k // 8 + 1]) ELSE 0 END::BIGINT),
               lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM d),
h AS (SELECT doc_id, lang, coalesce(crc % 7 = 0, false) AS tampered,
             coalesce(strlen(s) || ':' || s, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
             coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
             coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1 FROM crc),
leaf AS (SELECT *, sha256(head || n || tail) AS leaf, CASE WHEN tampered THEN sha256(head || n1 || tail) ELSE sha256(head || n || tail) END AS checked FROM h),
l AS (SELECT doc_id, lang, leaf, checked, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaf),
t(tree, lvl, i, n, digest) AS (SELECT tree, 0, i, n, leaf FROM l UNION ALL
  SELECT tree, lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, i // 2),
top AS (SELECT tree, lvl AS height, digest FROM t WHERE n = 1),
u(lvl, i, n, digest) AS (SELECT 0, tree, (SELECT count(*) FROM top), digest FROM top UNION ALL
  SELECT lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2),
node AS (SELECT tree, lvl, i, digest FROM t UNION ALL SELECT -1, lvl, i, digest FROM u),
f(tree, i, k, side, place, digest, proof, high, high2) AS (
  SELECT tree, i, 0, tree, i, checked, '', height, (SELECT max(lvl) FROM u) FROM l JOIN top USING (tree)
  UNION ALL
  SELECT f.tree, f.i, CASE WHEN k = high AND side >= 0 THEN 0 ELSE k + 1 END, CASE WHEN k = high AND side >= 0 THEN -1 ELSE side END,
         CASE WHEN k = high AND side >= 0 THEN f.tree ELSE place // 2 END,
         CASE WHEN k = high AND side >= 0 THEN f.digest WHEN x.digest IS NULL THEN sha256(f.digest) WHEN place % 2 = 1 THEN sha256(x.digest || f.digest) ELSE sha256(f.digest || x.digest) END,
         CASE WHEN k = high AND side >= 0 THEN proof ELSE proof || coalesce(x.digest, '') END, high, high2
  FROM f LEFT JOIN node x ON x.tree = f.side AND x.lvl = f.k AND x.i = xor(f.place, 1) WHERE side >= 0 OR k < high2)
SELECT l.doc_id, l.leaf, top.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = (SELECT digest FROM u WHERE n = 1) AS verified
FROM l JOIN top USING (tree) JOIN f ON f.tree = l.tree AND f.i = l.i AND f.side = -1 AND f.k = f.high2
"""

OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v, row_number() OVER () AS k
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.k <> b.k),
p AS (SELECT k, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY k, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (k) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


def oracle_sql() -> dict:
    return {"op1_url_filters": OP1, "op2_embedding_dedup": OP2, "op3_quality_rules": OP3, "op8_minhash_dedup": OP8, "op9_chat_rotation": OP9, "op11_merkle_manifest": OP11, "op12_hard_negatives": OP12}
