"""The queries of this subpackage: opN_<name>(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontam, html_extract, langid, lblm, mixing, prefix_trie, quality, secrets, simhash, spelling, token_counts, url_filter, warc
from lodestrata.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "finding", "at", F.col("length").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "transitions", "coverage", "score", "secret")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.held_out_scores(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"), keep=()))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_langid": op3_langid,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality": op5_quality,
    "op6_html": op6_html,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_decontam": op10_decontam,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op10_decontam": decontam.SQL,
    "op11_url_filter": url_filter.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_spelling": spelling.SQL,
}
