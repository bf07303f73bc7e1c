"""A training-corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.  ``run`` writes each
stage's result to the shared folder and reads it again.

1. quality: documents that the classifier scores under 0.3 go.
2. line_dedup: aligned blocks that an earlier document holds are deleted; a
   document of which nothing is left goes; n_chars follows the text.
3. jaccard: of each component of documents whose sets of five-word shingles
   have a similarity of 0.8 or more the smallest doc_id stays.
4. decontaminate: documents that hold a benchmark window go.
5. mix: sources are drawn to their targets; columns size, source_size, target,
   copies, taken, shards and orders are added, and rows not drawn go.

Null texts are empty; rows that repeat a doc_id are kept or dropped each by
its own text up to stage 3, which keeps one row of a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import alignment, decontaminate, jaccard, mixing, quality
from tracelake.llm._store import stored, unused

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3
MOST_BROADCAST = 200_000


def _without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """docs less those in gone, which is written first and broadcast only when its rows, counted then, are few."""
    gone = stored(gone.distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, on, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("score") >= LEAST_SCORE).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = alignment.dedup_lines(docs)
    left = F.col("text").rlike(mixing.WORDS)
    out = out.where((F.col("n_deleted") == 0) | left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(jaccard.similar_components(docs, k=5, percent=80))
    several = stored(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = _without(docs, found.where("doc_id <> component_id").select("doc_id"), ["doc_id"])
    if not several.count():
        return kept.select(*docs.columns)
    again = kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(several, "doc_id", "left_anti").unionByName(again).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    (name,) = unused(docs.columns, "hash")
    hit = found.where("n_hit > 0").select("doc_id", F.col("text_hash").alias(name))
    own = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return _without(own, hit, ["doc_id", name]).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: Trained scores and byte-exact alignment are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i < len(STAGES) - 1 else docs
    return docs
