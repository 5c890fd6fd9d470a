"""3. Quality rules: fences from mergeable quantile sketches per language and source, then a joined filter.

The sketch of a metric is its logarithmic histogram: bucket ``ceil(50 ln x)`` (a relative error of 1 %), with one bucket
for zero. Histograms merge by adding counts, so a group that is too small falls back to the merged sketch of
its language, then to that of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from overlace.plans.lineage import stage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"
ZERO = -100_000
STEP = 50.0
#: metric -> (which fences it has, least distance of a fence from the quartile, as a share of the metric's unit)
METRICS = {"symbol_rate": ("upper", 0.05), "word_length": ("both", 0.75), "dup_line_rate": ("upper", 0.1), "repeat_rate": ("upper", 0.1)}
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, lang, source, the five base counts, n_lines) of whole texts; a null or empty text has zeros.

    row is a struct of the columns ``carry`` (all, unless given), so no name of theirs can clash with one made here. Windows of three words
    are compared by 64-bit hash first; only texts with two equal hashes sort their
    windows by hash, and neighbours with equal hashes are compared word by word.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    out = docs.select(row.alias("row"), "lang", "source", F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = out.withColumn("w", F.array_remove(F.split("t", SPACE), "")).withColumn("ls", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda f: F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), f))
    at = lambda i, k: F.get("w", i + k)
    out = out.withColumn("h", window(lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))))
    out = out.withColumn("again", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)))
    out = out.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    same = "(get(s, {n}).h = x.h and " + " and ".join(f"w[get(s, {{n}}).i + {c}] = w[x.i + {c}]" for c in range(3)) + ")"
    twice = F.expr(f"filter(s, (x, k) -> (k > 0 and {same.format(n='k - 1')}) or (k + 1 < size(s) and {same.format(n='k + 1')}))")
    out = out.withColumn("p", F.transform(twice, lambda x: x["i"])).drop("s")
    covered = F.size(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2)))))
    return out.select(
        "row", "lang", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"),
    )


def metrics() -> dict:
    """Ratios of a text that has words; null without."""
    has = F.col("n_words") > 0
    rate = lambda a, b: F.when(has, F.col(a).cast("double") / F.col(b).cast("double"))
    return {"symbol_rate": rate("n_symbols", "n_words"), "word_length": rate("word_chars", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words")}


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable histograms, pre-aggregated before the shuffle."""
    x = F.col("x")
    flat = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), m.alias("x")) for k, m in metrics().items()])).alias("e")).select("lang", "source", "e.metric", F.col("e.x").alias("x"))
    bucket = F.when(x > 0, F.ceil(F.log(x) * STEP)).otherwise(F.lit(ZERO)).cast("int")
    return flat.where("x is not null").groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(hist: DataFrame, by: list[str]) -> DataFrame:
    """q25 and q75 of each metric over the sketches merged per ``by``; a group's buckets are bounded by the sketch."""
    w = Window.partitionBy(*by, "metric").orderBy("bucket")
    run = hist.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
    total = run.groupBy(*by, "metric").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("upto", "bucket"))).alias("cells"))
    at = lambda q: F.expr(f"filter(cells, c -> c.upto * 4 >= total * {q})[0].bucket")
    back = lambda b: F.when(b == ZERO, 0.0).otherwise(F.exp(b / STEP))
    return total.select(*by, "metric", "total", back(at(1)).alias("q25"), back(at(3)).alias("q75"))


def fences(hist: DataFrame, reach: float = 3.0, least_rows: int = 200) -> DataFrame:
    """(lang, source) with low and high fence of each metric: the quartiles, ``reach`` interquartile ranges away.

    A range narrower than a metric's least distance counts as that. Groups under ``least_rows`` take the merged
    sketch of their language, languages under it that of all rows.
    """
    fine = quartiles(hist, ["lang", "source"])
    lang = quartiles(hist.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    everything = quartiles(hist.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [])
    j = fine.alias("f").join(lang.alias("l"), F.expr("f.lang <=> l.lang and f.metric = l.metric")).join(everything.alias("e"), F.expr("f.metric = e.metric"))
    pick = lambda c: F.when(F.col("f.total") >= least_rows, F.col(f"f.{c}")).when(F.col("l.total") >= least_rows, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    j = j.select("f.lang", "f.source", "f.metric", pick("q25").alias("q25"), pick("q75").alias("q75"))
    least = F.coalesce(*[F.when(F.col("metric") == k, F.lit(float(v))) for k, (_, v) in METRICS.items()])
    spread = reach * F.greatest(F.col("q75") - F.col("q25"), least)
    per = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{k}_{c}")
    j = j.withColumns({"low": F.col("q25") - spread, "high": F.col("q75") + spread})
    return j.groupBy("lang", "source").agg(*[per(k, c) for k in METRICS for c in ("low", "high")])


def quality_rules(docs: DataFrame, text: str = "text", keep_text: bool = True, reach: float = 3.0, least_rows: int = 200, broadcast_groups: int = 20_000) -> DataFrame:
    """``docs`` with the base counts, base_failed and kept.

    base_failed: under 50 words, or more than half of them in repeated 3-word windows. kept: not base_failed, and
    every metric within the fences of the row's language and source (nulls form groups of their own). Nothing is
    merged or dropped; repeated rows count as often as they occur. The measured rows are staged once, as the fences
    need all of them before the first can be judged. Fences are broadcast up to ``broadcast_groups`` groups, which
    are counted. Columns named like the results are replaced.
    """
    made = {*COLUMNS, "base_failed", "kept"}
    had = [c for c in docs.columns if c.lower() not in made and (keep_text or c != text)]
    measured = stage(measure(docs, text, had))
    limits = stage(fences(sketch(measured), reach, least_rows).withColumnsRenamed({"lang": "of_lang", "source": "of_source"}))
    limits = F.broadcast(limits) if limits.count() <= broadcast_groups else limits
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = F.lit(False)
    for k, m in metrics().items():
        if METRICS[k][0] == "both":
            out = out | (m < F.col(f"{k}_low"))
        out = out | (m > F.col(f"{k}_high"))
    judged = measured.join(limits, F.expr("lang <=> of_lang and source <=> of_source"), "left")
    return judged.select(*[F.col(f"row.`{c}`") for c in had], *COLUMNS, failed.alias("base_failed"), (~failed & ~F.coalesce(out, F.lit(False))).alias("kept"))
