"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, html, jaccard, lines, lm, mixing, oracles, quality, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_frequency(_table(spark, sf_dir, "documents")).drop("text")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, (F.col("n_hit") > 0).alias("contaminated"))


def op4_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_partners", "n_moved", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 1
    scored = lm.score(_table(spark, sf_dir, "documents"), F.coalesce(~held("doc_id"), F.lit(True)))
    return scored.select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", "orders")


#: The contract's conversation that holds the template's own control strings.
_TRICKY = "(-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select * from values {_TRICKY} as t(conv_id, turn, role, text)")
    return chat.digest(chat.format_turns(rows.unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """Of the others, quality, language model and mixing depend on trained values or Spark's hashes, and the rest is too slow in SQL; tests hold them against plain Python."""
    return {"op1_line_frequency": oracles.OP1, "op3_decontaminate": oracles.OP3, "op5_jaccard_join": oracles.OP5, "op10_chat_format": oracles.OP10}
