"""The ten operators, each applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, chunks, html, jaccard, media, mixing, oracles, packing, pii, quality, urls
from millrace.llm.scratch import small_batches

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with passages that other documents have too; clean documents have none."""
    found = chunks.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_repeats", "n_cut", "cut_bytes", "spans", "first_doc_ids", "n_places")


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op7_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(_table(spark, sf_dir, "documents"))


#: Target shares of tokens for the query: three margins. What is not named keeps its natural share of what they leave.
TARGETS = {
    "source": {f"src{i}": 0.06 if i < 5 else 0.04 for i in range(20)},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.13},
    "topic": {"prose": 0.73, "long": 0.266},
}


def op8_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's calibrated probability, whether the draw keeps it, and the natural and attained shares of its source, language and topic."""
    rows = mixing.mix(_table(spark, sf_dir, "documents"), TARGETS)
    for d, shares in mixing.attained(rows).items():
        rows = rows.join(shares, f"_mix_{d}")
    shares = [F.round(f"{d}_{x}", 9).alias(f"{d}_{x}") for d in mixing.DIMS for x in ("natural", "share")]
    return rows.select("doc_id", "source", "lang", F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").cast("long").alias("n_tokens"), F.round("_mix_probability", 12).alias("probability"), F.col("_mix_kept").alias("kept"), *shares)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.chat_digests(turns.unionByName(more))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can express."""
    return quality.base_counts(_table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express."""
    return pii.base_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [
        op1_quality_rules,
        op2_content_defined_chunks,
        op3_redirect_equivalence,
        op4_page_differencing,
        op5_contextual_pii,
        op6_best_fit_packing,
        op7_signature_sniffing,
        op8_target_weights,
        op9_chat_formatting,
        op10_ngram_jaccard,
        quality_base_counts,
        pii_base_spans,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_redirect_equivalence": oracles.REDIRECT_EQUIVALENCE,
        "op9_chat_formatting": oracles.chat_formatting(CONTROL_TEXT),
        "quality_base_counts": oracles.QUALITY_BASE_COUNTS,
        "pii_base_spans": oracles.PII_BASE_SPANS,
    }
