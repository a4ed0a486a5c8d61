"""The corpus pipeline: quality filter, exact dedup, near-dedup, source mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, mixing, near_dedup, quality
from corpusloom.llm.common import Scratch, passing
from corpusloom.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labels of these documents that are not held out.

    Defined cases: a null or blank text is scored like any other and goes where it is rejected; repeated rows are judged
    each; without labels nothing is learned, and all rows stay; an empty table stays empty; columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Defined cases: null counts as the empty text; a null doc_id loses to any other; of rows that share text and the
    winning doc_id one stays; an empty table stays empty; columns stay as they are.
    """
    return exact_dedup.unique(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Defined cases: texts without words, null ones and rows without a doc_id stay; rows that share a doc_id stay or go
    together; an empty table stays empty; columns stay as they are.
    """
    return near_dedup.distinct(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Defined cases: a null source is a source of its own; documents without words go, as they fill no target; repeated
    rows are documents of their own; an empty table stays empty; columns stay as they are.
    """
    return mixing.repeated(mixing.mix(spark, docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Defined cases: a null text is the end mark alone; repeated rows are packed each; an empty table gives an empty result.
    """
    return pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned classifier and hashed random choices decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing():
            docs = scratch.write(stage(spark, docs, sf_dir), name, compression="snappy")
        if before:
            scratch.drop(before)
        before = name
    return docs
