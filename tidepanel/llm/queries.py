"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.chat_format import conversations_round_trip
from tidepanel.llm.decontaminate import contamination
from tidepanel.llm.html_text import extract_text
from tidepanel.llm.language import held_out, identify, learn
from tidepanel.llm.licenses import license_scan
from tidepanel.llm.near_dedup import near_duplicates
from tidepanel.llm.neighbours import nearest_neighbours
from tidepanel.llm.packing import pack, token_lengths
from tidepanel.llm.pii import replace_personal_data
from tidepanel.llm.sql import SQL
from tidepanel.llm.substring_dedup import repeated_windows_removed
from tidepanel.llm.token_alignment import align_tokens
from tidepanel.llm.token_files import token_files_round_trip
from tidepanel.llm.whitening import whiten

__all__ = ["QUERIES", "SQL"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(_table(spark, folder, "pages"))


def op3_length_bucket_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_lengths(_table(spark, folder, "documents")), length_col="n_tokens")


def op4_repair_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files_round_trip(_table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").where("doc_id is not null")
    model = learn(docs.where(~held_out()), "text", "lang")
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(_table(spark, folder, "documents"))


def op8_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    found = replace_personal_data(_table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"),
                        F.expr("array_sort(array_distinct(transform(entities, e -> e.kind)))").alias("kinds"), "text")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_windows_removed(_table(spark, folder, "documents"))


def op10_hnsw_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(_table(spark, folder, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(_table(spark, folder, "embeddings"))


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one, -7, whose texts look like marks."""
    marks = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return conversations_round_trip(_table(spark, folder, "conversations").select(*own.columns).unionByName(own))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_html_extraction, op3_length_bucket_packing, op4_repair_token_files, op5_language_id,
    op6_benchmark_decontamination, op7_license_scan, op8_pii_surrogates, op9_substring_dedup, op10_hnsw_neighbours,
    op11_embedding_whitening, op12_chat_formatting, op13_tokenizer_alignment)}
