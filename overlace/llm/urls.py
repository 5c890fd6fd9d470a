"""1. URL filters: hashed host-suffix and path-prefix expressions, joined on short prefixes, confirmed by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.plans.lineage import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (ASCII lower case) and path; both are empty for a null url or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"host": F.translate(F.regexp_extract(u, SPLIT, 1), UPPER, LOWER), "path": F.regexp_extract(u, SPLIT, 2)})


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _short(digest):
    """The first 32 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict; ``rules`` has host, path and action (block or allow).

    A rule fits its host and all subdomains where the url's path starts with the rule's path. The longest rule wins,
    then the one with the longer host; a block wins over an allow of the same rule. Without a rule the verdict is
    ``default``. Rows are never merged: repeated pages keep a row each. Only label counts and path lengths that
    some rule has are expanded, so a url of a thousand labels costs no more than the rules can use. Rules are broadcast
    up to ``broadcast_rules`` rows, which is counted; above that they are shuffled. The join has the 32-bit prefix of a digest
    as its only key; whole digests are compared afterwards, inside the aggregation that picks the best rule. Null and empty rule
    hosts fit nothing, so pages without a host take no part in any join. What hosts and paths were found to fit is written once, so
    AQE can split a host and path that many pages share. Columns of ``pages`` named like the results are replaced.
    """
    rules = rules.where("host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action")
    )
    facts = rules.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path"))).first()
    counts, lengths = (F.array(*map(F.lit, sorted(x))).cast("array<int>") if x else F.array().cast("array<int>") for x in facts[1:])
    keyed = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", _short("r_digest"))
    keyed = F.broadcast(keyed) if facts[0] <= broadcast_rules else keyed

    pages = split_url(pages.drop("host", "path", "rule", "verdict"), url)
    seen = pages.where("host <> ''").select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    hosts = F.transform(
        F.filter(counts, lambda k: k <= F.size("labels")),
        lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."),
    )
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    wide = seen.withColumns({"hosts": hosts, "paths": paths}).select("host", "path", F.explode("hosts").alias("h"), "paths")
    asked = wide.select("host", "path", F.explode(F.transform("paths", lambda p: _digest(F.col("h"), p))).alias("digest"))
    hits = asked.withColumn("short", _short("digest")).join(keyed, F.col("short") == F.col("r_short"))
    rule = F.concat("r_host", "r_path")
    order = F.struct(F.length(rule).alias("n"), F.length("r_host").alias("m"), (F.col("r_action") == "block").alias("b"), rule.alias("rule"), F.col("r_action").alias("action"))
    best = hits.groupBy("host", "path").agg(F.max(F.when(F.col("digest") == F.col("r_digest"), order)).alias("best"))
    best = stage(best.where("best is not null").select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("best.rule").alias("b_rule"), F.col("best.action").alias("b_action")))
    given = [f"p.`{c}`" for c in pages.columns]
    named = pages.where("host <> ''").alias("p").join(best.alias("b"), F.expr("p.host = b.b_host and p.path = b.b_path"), "left")
    judged = named.select(*given, F.col("b.b_rule").alias("rule"), F.coalesce("b.b_action", F.lit(default)).alias("verdict"))
    return judged.unionByName(pages.where("host = ''").alias("p").select(*given, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
