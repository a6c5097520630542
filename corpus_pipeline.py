"""From raw documents to a training mix, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skribo.llm import decontaminate, mixing, ordinal_quality, simhash, suffix_dedup
from skribo.llm.common import read, released, removed, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated ones, keeps."""
    model = ordinal_quality.train(docs, read(spark, sf_dir, "labels"))
    return ordinal_quality.score(docs, model, COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows that repeat an id and a text stay or go together. Documents without an id are not grouped."""
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut out; a document that consists of them alone goes. Characters cut in part go too."""
    cut = suffix_dedup.without_repeats(docs, keep=("lang", "source"), with_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"), "n_bytes").where("n_bytes = 0 or n_chars > 0").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, copy from 1.

    Weights are the text's quality: stages before hand on the columns of documents alone, and this one stays native, so
    the classifier's probabilities can't come along; mixing.sampled takes them as its weight where they can.
    """
    return mixing.sampled(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
]
#: The classifier and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next; a stage's files go when the next one's are written, the last ones are what the result reads."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = stored(docs)
            if before:
                removed(spark, before)
            before = path
            released(spark)
    return docs
