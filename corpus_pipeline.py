"""Corpus clean-up in stages; each is written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the columns that came in; the last
returns the ids of what is left. Documents with a null id pass every stage unless it rejects them
by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, ngram_join, quality, queries, secrets, tree_bpe
from gridloom.llm.common import fresh, materialise, table

#: Share of a document's words in benchmark windows from which it goes.
MOST_HIT = 0.0
LEAST_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``LEAST_QUALITY``."""
    m = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return quality.with_score(docs, m, score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; rows are told apart by id and text."""
    of, tag = fresh(docs, "of", "tag")
    found = decontaminate.tagged(docs, table(spark, sf_dir, "benchmark")).filter(F.col("n_hit") > MOST_HIT * F.col("n_words"))
    bad = found.select(F.col("doc_id").alias(of), F.col("_tag").alias(tag)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(tag)), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret's span replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redacted(docs, secrets.train(secrets.labelled_samples(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return tree_bpe.digest(docs, queries.WORD_BPE)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("encode", encode),
]
#: Classifier, banding and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
