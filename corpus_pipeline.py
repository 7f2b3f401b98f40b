"""A corpus of documents made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of documents; the last returns tokens.  An empty
table goes through all of them as one, very long texts are taken whole, and documents
may have further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from lodestone.llm.durable import discard, written
from lodestone.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't toxic, by a lexicon learned from the labelled ones among them.

    Null and empty texts score 0 and stay; null ids are no labelled rows; repeated rows
    and equal texts are judged alike; contradicting labels of a document count as toxic.
    """
    ship(spark)
    lexicon = toxicity.trained_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(~toxicity.toxic(docs["text"], lexicon)["is_toxic"])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines stay in one document only.

    Null and empty texts stay; a null site is none; of a line's places that with the
    least doc_id, nulls last, and then the first one stays; repeated rows are treated alike.
    """
    ship(spark)
    return line_dedup.without_boilerplate(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null, empty and wordless texts are in no group and stay; the least doc_id stays, nulls
    last, then the least hash of the text; of repeated rows one stays.
    """
    ship(spark)
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts stay, null items take nothing, an empty benchmark leaves all;
    repeated rows are judged alike.
    """
    ship(spark)
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, tokens, and whether these decode to the text.

    A null text has null tokens, an empty one none; null ids pass through; repeated rows
    each give a row.
    """
    ship(spark)
    return bpe.encode(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", one_of_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", tokens),
]

#: The automaton and the stemming of toxicity have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the checkpoint folder and read
    again, and goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
