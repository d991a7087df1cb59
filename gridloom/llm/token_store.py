"""Token-id output: blocks of ids as shuffled, compressed planes with a chunk index.

Documents are range-partitioned and sorted by doc_id, encoded where they land, and their ids cut
into blocks of a fixed number of ids (the last one of a shard is shorter). A block's ids are
transposed into byte planes (or bit planes), each plane compressed with zstandard, and written as
one chunk row. The layout below a path is::

    kind=chunk/  shard, chunk_no, first_id, n_ids, width, mode, planes (array of binary)
    kind=doc/    shard, doc_no, doc_id, first_id, n_ids        the index: where a document starts

``first_id`` counts within a shard; shards follow each other in doc_id order. Both are Parquet
files that Spark's committer writes, so a task that is run again leaves no half-written shard.

Cases: null text is empty (it has the end id only); null doc_ids come first; equal doc_ids are
ordered by text; an empty table gives an empty store. Other columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.tree_bpe import Encoder, batches

BLOCK_IDS = 65_536
LEVEL = 3
#: Characters of a text by which documents of one id are dealt.
KEY_CHARS = 128
STORE = (
    "kind string, shard int, chunk_no int, first_id long, n_ids long, width int, mode string,"
    " planes array<binary>, doc_no long, doc_id long"
)


def pack(ids: np.ndarray, mode: str = "byte", width: int = 4, level: int = LEVEL) -> list[bytes]:
    """Planes of a block of unsigned ids, compressed, the lowest byte or bit first."""
    raw = ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    comp = zstandard.ZstdCompressor(level=level)
    if mode == "byte":
        return [comp.compress(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(width)]
    bits = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")
    return [comp.compress(np.packbits(bits[:, k], bitorder="little").tobytes()) for k in range(8 * width)]


def unpack(planes: list[bytes], n: int, mode: str, width: int) -> np.ndarray:
    """The ids of a block, as unsigned 64-bit integers."""
    dec = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(dec.decompress(p), np.uint8) for p in planes]
    if mode == "bit":
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        rows = list(np.packbits(bits, axis=1, bitorder="little").T)
    raw = np.zeros((n, 8), np.uint8)
    for k in range(width):
        raw[:, k] = rows[k]
    return raw.reshape(-1).view("<u8")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, mode: str = "byte", block: int = BLOCK_IDS) -> None:
    """Encode and write documents (doc_id, text) below ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # documents without an id, or with one id, are dealt by how their texts begin, which keeps the order of texts
    dealt = rows.repartitionByRange("doc_id", F.substring("text", 1, KEY_CHARS)).sortWithinPartitions("doc_id", "text")
    schema = pa.schema([
        ("kind", pa.string()), ("shard", pa.int32()), ("chunk_no", pa.int32()), ("first_id", pa.int64()),
        ("n_ids", pa.int64()), ("width", pa.int32()), ("mode", pa.string()), ("planes", pa.list_(pa.binary())),
        ("doc_no", pa.int64()), ("doc_id", pa.int64()),
    ])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = Encoder.of(tokenizer), TaskContext.get().partitionId()
        width = 4 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 32 else 8
        held, n_held, doc_no, at, chunk_no = [], 0, 0, 0, 0

        def chunks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, chunk_no
            if n_held >= block or last and n_held:
                ids = np.concatenate(held)
                stop = len(ids) if last else len(ids) - len(ids) % block
                for lo in range(0, stop, block):
                    part = ids[lo : min(lo + block, stop)]
                    yield pa.RecordBatch.from_pylist([{
                        "kind": "chunk", "shard": shard, "chunk_no": chunk_no, "first_id": chunk_no * block, "n_ids": len(part),
                        "width": width, "mode": mode, "planes": pack(part, mode, width),
                    }], schema=schema)
                    chunk_no += 1
                held, n_held = [ids[stop:].copy()], len(ids) - stop

        for batch in it:
            for start, texts in batches(batch.column("text").to_pylist()):
                plain, start_of = enc.flat(texts)
                ids = np.insert(plain, start_of[1:], end_id)
                n = np.diff(start_of) + 1
                first = at + start_of[:-1] + np.arange(len(texts))
                k = len(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(["doc"] * k), pa.array([shard] * k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(first), pa.array(n),
                    pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.list_(pa.binary())),
                    pa.array(np.arange(doc_no, doc_no + k)), batch.column("doc_id").slice(start, k),
                ], schema=schema)
                held.append(ids)
                n_held, at, doc_no = n_held + int(n.sum()), at + int(n.sum()), doc_no + k
                yield from chunks(False)
        yield from chunks(True)

    dealt.mapInArrow(run, STORE).write.partitionBy("kind").option("compression", "snappy").parquet(path)


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path).filter(F.col("kind") == kind)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, bit-reversed."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (crc, bytes) of its parts."""
    crc = 0
    for c, n in parts:
        shift, power, bits = 1 << 31, 1 << 23, n  # x^0, x^8
        while bits:
            if bits & 1:
                shift = _times(power, shift)
            power, bits = _times(power, power), bits >> 1
        crc = _times(shift, crc) ^ c
    return crc


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files.

    Chunks are decoded where they lie. Documents are cut at chunk limits by arithmetic on the index,
    each cut meets its chunk in a join, and the checks of a document's parts are combined.
    """
    index, chunks = _stored(spark, path, "doc"), _stored(spark, path, "chunk")
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # a row for each shard
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))

    # a chunk gets the documents that begin in it or reach into it
    size = chunks.groupBy("shard").agg(F.max("n_ids").alias("_block"))
    cut = index.join(size, "shard")
    last = F.col("first_id") + F.col("n_ids") - 1
    one = lambda c: F.floor(c / F.col("_block")).cast("int")
    cut = cut.select(
        "shard", "doc_no", "doc_id", "first_id", "n_ids", F.explode(F.sequence(one(F.col("first_id")), one(last))).alias("chunk_no")
    )
    per = cut.groupBy("shard", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("first_id", "n_ids", "doc_no", "doc_id"))).alias("_docs"))
    both = chunks.select("shard", "chunk_no", F.col("first_id").alias("_first"), F.col("n_ids").alias("_n"), "width", "mode", "planes")
    both = both.join(per, ["shard", "chunk_no"])
    out = "shard int, doc_no long, doc_id long, first_id long, n_ids long, part int, crc long, n_bytes long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                raw = unpack(r["planes"], r["_n"], r["mode"], r["width"]).astype("<u4").tobytes()
                rows = []
                for d in r["_docs"]:
                    lo, hi = max(d["first_id"] - r["_first"], 0), min(d["first_id"] + d["n_ids"] - r["_first"], r["_n"])
                    rows.append((r["shard"], d["doc_no"], d["doc_id"], d["first_id"], d["n_ids"], r["chunk_no"], zlib.crc32(raw[4 * lo : 4 * hi]), 4 * (hi - lo)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
                )

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in out.split(", ")]
    parts = both.mapInArrow(run, out)
    whole = parts.filter(F.col("n_bytes") == 4 * F.col("n_ids"))
    rest = parts.filter(F.col("n_bytes") != 4 * F.col("n_ids")).groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("first_id").alias("first_id"), F.first("n_ids").alias("n_ids"),
        F.array_sort(F.collect_list(F.struct("part", "crc", "n_bytes"))).alias("_parts"),
    )

    @F.pandas_udf("long")
    def combined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ps: crc32_joined([(int(p["crc"]), int(p["n_bytes"])) for p in ps]))

    cols = ["shard", "doc_id", "first_id", "n_ids", "crc"]
    every = whole.select(*cols).unionAll(rest.select(*cols[:4], combined("_parts").alias("crc")))
    return every.join(base, "shard").select(
        "doc_id", (F.col("_base") + F.col("first_id")).alias("start"), F.col("n_ids").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """shard, first_id, ids of each chunk: the stored stream itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                ids = unpack(r["planes"], r["n_ids"], r["mode"], r["width"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]], pa.int32()), pa.array([r["first_id"]], pa.int64()), pa.array([ids], pa.list_(pa.int64()))],
                    ["shard", "first_id", "ids"],
                )

    return _stored(spark, path, "chunk").select("shard", "first_id", "n_ids", "width", "mode", "planes").mapInArrow(
        run, "shard int, first_id long, ids array<long>"
    )
