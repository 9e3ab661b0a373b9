"""Documents to mixed, segmented training text: each stage works on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from ledgerlake.llm import langid, near_dups, pfair, pieces, recipes
from ledgerlake.llm._common import staged, table
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a lang, but for the held-out third; documents that are rejected go."""
    return langid.keep_identified(docs, langid.fit(docs.where(~langid.held_out())))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return recipes.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the smallest doc_id stays."""
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixed stream."""
    return pfair.mixed(docs, pfair.SHARES)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, scores of the best few, whether decoding them gives the text back, and slot and begins: the mixed stream is in order of (slot, begins, doc_id), whatever files docs came from."""
    return pfair.placed(pieces.segment(docs).drop("other_ids"), docs, pfair.SHARES)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: SQL can't express the classifier, the near duplicates' reach and the segmentation; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
