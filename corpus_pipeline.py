"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Cases, for every stage: an empty table stays empty, with its columns; null and empty texts
fail the base rules of the first stage, and later stages, given such rows, keep one of
them as near-duplicates and mix it at size 0; null doc_ids, langs, sources and counts stay
as they are (a null doc_id is never the one that near-duplicates keep if another is there,
null sources are one source); very long texts are read whole; of rows equal in doc_id and
text one stays from the second stage on; ties between near-duplicates go to the smaller
doc_id, then to the smaller hash of the row; columns beside those of documents pass
through, whatever their names, but for ``copies``, which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontam, mixing, quality, secrets, simhash
from lodestrata.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with how many copies of each."""
    return mixing.take(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mixture),
]

#: Hashed fingerprints, the forest and the sampling have no SQL form; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
