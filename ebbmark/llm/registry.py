"""The numbered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.core.tables import table
from ebbmark.llm import chat, collocation, decontam, line_dedup, near_dedup, packing, pii, quality, search, secrets, span_dedup, suffix_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, one row per piece."""
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "sequence_length")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as counts, a digest of the base spans, and all spans."""
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; a page's outcome is the label of the document whose number its url holds."""
    pages = _read(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.outcomes_of(pages, _read(spark, sf_dir, "labels")))


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated sentence spans, and the removed ranges as start:end."""
    out = span_dedup.without_repeats(_read(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", "text", "n_removed", ranges.alias("removed"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, as counts, a digest of the base spans, and all spans."""
    return pii.digest(_read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, written as a raw transcript, parsed back into canonical turns.

    Fitted on half of the conversations, by hash; ``right`` tells for the others whether all roles are equal.
    """
    raw = table(chat.transcripts(_read(spark, sf_dir, "conversations")), "transcripts")
    held = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1
    model = chat.parameters(chat.counts(raw.filter(~held)))
    right = F.when(held, F.col("roles_found") == F.col("roles"))
    return chat.formatted(raw, model).select("conv_id", "part", F.size("roles_found").cast("long").alias("n_turns"), F.array_join("roles_found", ",").alias("roles"), "rendered", right.alias("right"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of repeated three-line windows."""
    return line_dedup.without_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    out = quality.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    counts = [F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage."""
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("th")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document, on four-word shingles."""
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4).drop("text_key")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 50 bytes that one with a smaller doc_id holds too."""
    out = suffix_dedup.without_repeats(_read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two or three words of every lang."""
    return collocation.phrases(_read(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_url_filter": op3_url_filter,
    "op4_span_dedup": op4_span_dedup,
    "op5_pii": op5_pii,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_collocation": op12_collocation,
    "op13_search": op13_search,
}
SQL = {
    "op3_url_filter": url_filter.SQL,
    "op4_span_dedup": span_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_decontamination": decontam.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_suffix_dedup": suffix_dedup.SQL,
    "op12_collocation": collocation.SQL,
    "op13_search": search.SQL,
}
