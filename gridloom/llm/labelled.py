"""Bounded labelled samples for the classifiers: in rows and in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of)).cast("int")


#: Bytes of the longest text that is learnt from, so that a sample of n rows holds n times as many at most.
SAMPLE_BYTES = 65_536


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """Columns of documents with ``_y`` (0 or 1): at most ``rows`` labelled ids that aren't held out, those with
    the least hashes, and one text of at most ``SAMPLE_BYTES`` of each, the one with the least hash, so that neither
    repeated rows nor many texts of an id count more than others. Rows with a null label are left out; of
    repeated labels the greatest counts."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    met = short.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most ``rows`` ids
    others = [c for c in docs.columns if c != "doc_id"]
    one = met.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), *others)).alias("_r"))
    return one.select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in others], "_y")
