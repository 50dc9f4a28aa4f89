"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import bpe, decontamination, language_id, line_dedup, shingle_dedup
from foldloom.llm.queries import VOCABULARY
from foldloom.plans.stage import shared_folder, staging

# Documents that resemble no language profile more than this are no prose; a text without letters scores 0.
LEAST_SCORE = 0.05
# No SQL: language profiles, fingerprint components and token ids are not expressible.
ORACLE_SQL = None


def _aside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with those columns out of the way that an operator adds, and the columns as they were, to be selected afterwards."""
    moved = {c: f"__own_{c}" for c in docs.columns if c in added}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by profiles of all documents with a language; their columns stay as they are. Texts without a letter go."""
    own, columns = _aside(docs, ("lang_pred", "score"))
    found = language_id.identify(own, language_id.collect_profiles(language_id.learn_profiles(docs)))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; n_chars follows. Documents that lose all their words go."""
    own, columns = _aside(docs, ("n_lines", "n_removed"))
    clean = line_dedup.remove_repeated_lines(own).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id. SimHash finds pairs, an exact join those it misses; links have a Jaccard similarity of 0.8 or more of 5-word shingles."""
    return shingle_dedup.first_of_each(docs).select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages. Documents with a passage that is a small part of them stay as they are."""
    own, columns = _aside(docs, ("n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate_by(own, benchmark).where(~F.col("contaminated")).select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, ids_sha256, decoded_sha256) of every document left."""
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], decoded="decoded").select(
        "doc_id", "lang", "source", F.floor(F.length("token_ids") / 4).alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the shared folder, so a lost executor repeats one stage at most.

    Null and empty texts have no language and go with the first stage; null keys stay, last among near-duplicates; of repeated rows one stays. Further columns pass
    all stages but the last, whatever their names. Without documents, or without benchmark items, the result is empty, or nothing is contaminated.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
