"""A corpus pipeline: quality classifier, quality rules, MinHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlace.llm import gam, minhash, packing, rules
from overlace.llm.common import table
from overlace.llm.queries import tokenizer_path
from overlace.plans.lineage import adopt, shared_dir
from overlace.plans.lineage import stage as stage_table


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``docs`` has it."""
    had = {c.lower() for c in docs.columns}
    while name in had:
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labelled ones among ``docs``."""
    model = gam.learn(docs, table(spark, sf_dir, "labels"))
    score, predicted = _fresh(docs, "score"), _fresh(docs, "predicted")
    judged = gam.classify(docs, model, docs.columns, keep_text=True, names=(score, predicted))
    return judged.where(F.col(predicted) == 1).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; all columns of documents go through, whatever their names."""
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    row = docs.select("text", "lang", "source", F.struct(*own.values()).alias("document"))
    return rules.quality_rules(row, keep_text=False).where("kept").select("document.*")


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with ``row``, a number for each distinct (doc_id, text) in order of the ids; only digests are sorted."""
    digest = _fresh(docs, "digest")
    docs = docs.withColumn(digest, F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = docs.select("doc_id", digest).distinct().repartitionByRange(parts, "doc_id", digest).sortWithinPartitions("doc_id", digest)
    numbers = stage_table(seen.withColumn(row, F.monotonically_increasing_id()))
    return docs.join(numbers, ["doc_id", digest]).drop(digest)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Rows that share an id are apart unless their texts are equal or near copies; rows without an id all stay, copies of each other too.
    """
    row = _fresh(docs, "row")
    known, key = docs.where("doc_id is not null"), "doc_id"
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        known, key = _numbered(known, row), row
    kept = minhash.near_duplicates(known.select(F.col(key).alias("doc_id"), "text"), shingle=5, percent=80).where("kept").select(F.col("doc_id").alias(key)).distinct()
    known = known.join(kept, key, "left_semi")
    known = known.dropDuplicates([key]) if key == row else known
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", quality), ("minhash_dedup", dedup), ("packing", pack)]

#: Trained scores, MinHash tables and packing have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = adopt(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
