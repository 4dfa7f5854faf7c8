"""The corpus pipeline: language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before
kept, and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.language import UNKNOWN, held_out, learn_profiles, predicted
from lattica.llm.mixing import mix
from lattica.llm.near_dups import near_duplicates
from lattica.llm.packing import pack_documents
from lattica.session import materialize, table

#: Documents whose best cosine is below this are in none of the learned languages. Texts of a few
#: words in a learned language lie above 0.08; a random bundle of 1024 dimensions lies around 0.03.
LEAST_SCORE = 0.05
#: Shingles and similarity (of 100) at which documents are near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those near none of the languages learned from docs.

    Each row is judged on its own, also where ids are null or repeated; a null
    text has no letter. An empty table stays empty, clashing columns as they are.
    """
    found = predicted(docs, learn_profiles(docs.filter(~held_out())))
    kept = found.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the one with the least doc_id.

    Documents are linked at a similarity of 0.8 on shingles of five words. Rows
    that repeat a doc_id are one document, so they stay or go together. Rows
    with a null doc_id or without words are linked with nothing and stay.
    """
    found = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    gone = found.filter("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have square-root weights, in a global shuffle.

    Rows with a null or repeated doc_id draw each on its own, null texts count
    as rows, a null source is a source, and an empty table gives none.
    """
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens.

    A null text is its end id alone. Rows with a null or repeated doc_id are
    packed each on its own; other columns are left behind; an empty table gives none.
    """
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dups", near_dups), ("mixing", mixing), ("packing", packing)]

#: Language ID and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each over what the one before has stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
