"""A training corpus from raw documents: each stage calls one operator and reads what the stage before it left.

All stages but the last return the columns that they were given. Documents that are clean pass unchanged, but for
their language label (what the text is in) and for personal data. ``ORACLE_SQL`` is None: language models, sketches and
keyed surrogates are not SQL; the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm.decontaminate import contamination
from tidepanel.llm.language import UNDETERMINED, held_out, identify, learn
from tidepanel.llm.near_dedup import near_duplicates
from tidepanel.llm.packing import pack, token_lengths
from tidepanel.llm.pii import replace_personal_data
from tidepanel.llm.storage import Scratch


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The documents with columns named by place, so that none clashes with an operator's; all but the text; the names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [n for c, n in names.items() if c != "text"], names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language (not null, with a letter), labelled with it."""
    if not docs.head(1):
        return docs
    model = learn(docs.where(F.coalesce(~held_out(), F.lit(True))), "text", "lang")
    if not model.languages:  # no labels to learn from: only texts without a letter can be told
        return docs.where(F.col("text").rlike(r"\p{L}"))
    numbered, rest, names = _numbered(docs)
    found = identify(numbered, model, names["text"], keep=rest).where(F.col("lang_pred") != UNDETERMINED)
    taken = names | {"text": "text", "lang": "lang_pred"}
    return found.select(*[F.col(taken[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows without an id stay."""
    copies = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages in a twentieth of their words; rows without an id stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and their length counted again."""
    numbered, rest, names = _numbered(docs)
    found = replace_personal_data(numbered, names["text"], keep=rest)
    taken = {c: F.col(n) for c, n in names.items()} | {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[taken[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, lengths in tokens: bucket, batch and slot."""
    return pack(token_lengths(docs), length_col="n_tokens")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
