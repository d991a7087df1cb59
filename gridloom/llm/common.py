"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything below U+0080 that is neither a digit nor a letter; runs of it separate words.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` alone would also change other scripts."""
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def raw_words(text: Column) -> Column:
    """Words, in lower case only where the text is plain ASCII; null text has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(text), NOT_WORD, -1), "")


def word_hashes(text: Column, words: Column) -> Column:
    """A 64-bit hash of each lower-cased word of ``raw_words(text)``."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.transform(words, lambda w: F.xxhash64(w))).otherwise(
        F.transform(words, lambda w: F.xxhash64(ascii_lower(w)))
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. A local session may do without a named one, a cluster may not."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not named and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return jsc.getCheckpointDir().get()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts into which a hot key is dealt.
SALTS = 32


def join_spread(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many rows with few, one for each key, where a key may hold a large share of the many: these are
    dealt by a hash of the columns ``by`` too, and each of the few goes to every part."""
    (salt,) = fresh(many, "salt")
    many = many.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    few = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few, [*keys, salt], how).drop(salt)


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join in which the rows of ``few`` that ``hot`` names are broadcast, so that no task gets all the
    rows of ``many`` with such a key; the caller bounds how many they are. The rest is shuffled."""
    (mark,) = fresh(many, "hot")
    met = many.join(F.broadcast(few.filter(hot).withColumn(mark, F.lit(True))), keys, "left")
    rest = met.filter(F.col(mark).isNull()).select(*many.columns).join(few.filter(~F.coalesce(hot, F.lit(False))), keys)
    met = met.filter(mark).drop(mark)
    return met.unionByName(rest.select(*met.columns))


def same_keys(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of columns of two sides named differently."""
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond
