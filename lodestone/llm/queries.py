"""Queries of the training-data operators, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, fingerprints, html_text, langid, line_dedup, ngram_join, pii, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.trained_lexicon(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.strip_lines(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(langid.sample(docs)))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.spans(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_toxicity, op3_langid, op4_syncmers, op5_chat_spans, op6_decontaminate, op7_line_dedup, op8_bpe, op9_ngram_join, op10_html_text)
}
ORACLE_SQL = {"op5_chat_spans": chat.sql(), "op7_line_dedup": line_dedup.sql(), "op9_ngram_join": ngram_join.sql()}
