"""Media columns by content-defined chunking of payloads.

A rolling gear hash cuts each payload where its bits vanish, so equal stretches get equal chunks
wherever they stand. Equal payloads are stored once. Their chunks are deduplicated by joins on the
digests: of the payloads that hold a chunk the one with the lowest id owns it, every other refers to
it. The store below a path is::

    dictionary/  the zstandard dictionary of all frames, from a bounded sample of texts
    rows/      key, payload (its id, the SHA-256 of the text), n_bytes: one for each row
    recipes/   payload, manifest, refs: array of (no, owner), data: zstandard frame of the owned chunks
               one after the other, but for those that others refer to too, which are frames of their
               own in shared; copies: rows with this payload

The stored form of a payload is its manifest: the ordered chunk list, 16 bytes of digest and 4 of
size (little-endian) for each chunk. ``media_bytes`` and ``media_sha256`` are those of the manifest as
read back. A payload is rebuilt from its manifest, each chunk held against its digest; chunks owned
elsewhere are fetched by a join.

Cases: null text is an empty payload; repeated rows and equal keys keep a row each; null keys are
kept; a chunk that fails its digest raises; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import join_hot, materialise

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 1024, 12, 32_768
REACH = 32  # bytes that a 32-bit gear hash sees
LEVEL = 6
UNIT = 64
#: The compression dictionary's size, and the most texts and bytes of a text that it is trained on.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 112_640, 1_500, 16_384
#: A key with more than one in so many rows is hot: there are at most that many of them, so they are broadcast
#: (of chunks 32 MB at most).
HOT_SHARE = 1_024
PLACE = struct.Struct("<16sI")


def _gears() -> np.ndarray:
    """256 fixed 32-bit numbers from a rule: the first bytes of digests of the byte values."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


GEARS = _gears()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = 2 h + gear[byte], modulo 2**32, by doubling."""
    h = GEARS[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a payload; the least and greatest sizes count from the chunk's start."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = gear_hash(np.frombuffer(data, np.uint8))
    marks = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        i = np.searchsorted(marks, at + MIN_CHUNK)
        end = min(int(marks[i]) if i < len(marks) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    lo, out = 0, []
    for hi in cut_points(data):
        part = data[lo:hi]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        lo = hi
    return out


def manifest(parts: list[tuple[bytes, bytes]]) -> bytes:
    """The ordered list of (digest, size) of chunks."""
    return b"".join(PLACE.pack(d, len(p)) for d, p in parts)


def train_dictionary(rows: DataFrame) -> bytes:
    """A zstandard dictionary from at most ``SAMPLE`` different texts of at most ``SAMPLE_BYTES`` bytes, those with
    the least ids of about four times as many chosen by hash; empty if they are too few."""
    share = int(min(1.0, 4 * SAMPLE / max(rows.count(), 1)) * 1_000_000)
    fit = F.octet_length("text").between(9, SAMPLE_BYTES) & (F.pmod(F.xxhash64("payload"), F.lit(1_000_000)) <= share)
    chosen = rows.filter(fit).dropDuplicates(["payload"]).orderBy("payload").limit(SAMPLE).select("text").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [payload(r["text"]) for r in chosen], level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


OWNER = pa.struct([("payload", pa.binary()), ("no", pa.int32())])
RECIPE = pa.schema([
    ("payload", pa.binary()), ("manifest", pa.binary()), ("refs", pa.list_(pa.struct([("no", pa.int32()), ("owner", OWNER)]))), ("data", pa.binary()),
    ("shared", pa.list_(pa.struct([("no", pa.int32()), ("data", pa.binary())]))), ("copies", pa.int64()),
])
RECIPE_DDL = (
    "payload binary, manifest binary, refs array<struct<no:int,owner:struct<payload:binary,no:int>>>, data binary,"
    " shared array<struct<no:int,data:binary>>, copies long"
)


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' digests of each text, in order."""
    for batch in it:
        found = [[d for d, _ in chunks(payload(x))] for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("payload"), pa.array(found, pa.list_(pa.binary()))], ["payload", "digests"])


def _pack(dictionary: bytes):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = _compressor(dictionary)
        for batch in it:
            frames = [comp.compress(payload(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("payload"), pa.array(frames, pa.binary())], ["payload", "frame"])

    return run


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Store payloads of a text column below ``path``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.unhex(F.sha2(whole, 256)).alias("payload"), whole.alias("text"))
    dictionary = train_dictionary(rows)
    docs.sparkSession.createDataFrame([(dictionary,)], "data binary").write.parquet(f"{path}/dictionary")
    rows.select("key", "payload", F.octet_length("text").cast("long").alias("n_bytes")).write.parquet(f"{path}/rows")

    # 16 bytes for each chunk of each payload; copies are reduced within tasks first
    listed = rows.select("payload", "text").mapInArrow(_digests, "payload binary, digests array<binary>").dropDuplicates(["payload"])
    each = materialise(listed.select("payload", F.posexplode("digests").alias("no", "digest")), "chunks")
    place = F.struct("payload", "no")
    owned = each.groupBy("digest").agg(F.min(place).alias("owner"), F.count("*").alias("_n")).filter("_n > 1")
    limit = max(each.count() // HOT_SHARE, 1)
    moved = join_hot(each, owned, ["digest"], F.col("_n") > limit)
    moved = moved.select("payload", F.struct("no", F.when(place != F.col("owner"), F.col("owner")).alias("owner")).alias("_c"))
    per = moved.groupBy("payload").agg(F.collect_list("_c").alias("_moved"))

    packed = rows.select("payload", "text").mapInArrow(_pack(dictionary), "payload binary, frame binary")
    once = packed.groupBy("payload").agg(F.first("frame").alias("frame"), F.count("*").alias("copies"))
    both = once.join(per, "payload", "left").select("payload", "frame", "copies", "_moved")

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, dec, out, size = _compressor(dictionary), _decompressor(dictionary), [], 0
        for batch in it:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                where = {m["no"]: m["owner"] for m in row["_moved"] or []}
                parts = chunks(dec.decompress(row["frame"]))
                own = b"".join(p for i, (_, p) in enumerate(parts) if i not in where)
                out.append({
                    "payload": row["payload"], "manifest": manifest(parts), "refs": [{"no": i, "owner": o} for i, o in sorted(where.items()) if o],
                    "data": comp.compress(own) if where else row["frame"], "copies": row["copies"],
                    "shared": [{"no": i, "data": comp.compress(parts[i][1])} for i in sorted(where) if where[i] is None],
                })
                size += len(row["frame"])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=RECIPE)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=RECIPE)

    both.mapInArrow(store, RECIPE_DDL).write.option("compression", "uncompressed").parquet(f"{path}/recipes")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``_fetched``: their chunks that other payloads own, by place."""
    recipes = spark.read.schema(RECIPE_DDL).parquet(f"{path}/recipes")
    wanted = recipes.select("payload", F.inline("refs").alias("_at", "owner"))
    uses = wanted.groupBy("owner").agg(F.count("*").alias("_n"))
    limit = max((uses.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE, 1)
    shared = recipes.select(F.col("payload").alias("_p"), F.inline("shared").alias("no", "data"))
    shared = shared.select(F.struct(F.col("_p").alias("payload"), "no").alias("owner"), "data").join(uses, "owner")
    got = join_hot(wanted, shared, ["owner"], F.col("_n") > limit)
    per = got.groupBy("payload").agg(F.collect_list(F.struct("_at", "data")).alias("_fetched"))
    far = F.size("refs") > 0
    alone = recipes.filter(~far).select("*", F.lit(None).cast(per.schema["_fetched"].dataType).alias("_fetched"))
    return alone.unionByName(recipes.filter(far).join(per, "payload").select(*alone.columns))


def rebuild(row: dict, dec: zstandard.ZstdDecompressor) -> bytes:
    """The payload of a row of ``read``, every chunk verified."""
    own, at, parts = dec.decompress(row["data"]), 0, []
    apart = {f["_at"]: f["data"] for f in row["_fetched"] or []} | {s["no"]: s["data"] for s in row["shared"]}
    for i, (digest_, size) in enumerate(PLACE.iter_unpack(row["manifest"])):
        if i in apart:
            part = dec.decompress(apart[i])
        else:
            part = own[at : at + size]
            at += size
        if hashlib.blake2b(part, digest_size=16).digest() != digest_:
            raise ValueError(f"chunk {i} of payload {row['payload'].hex()} is damaged")
        parts.append(part)
    return b"".join(parts)


def features(data: bytes) -> str:
    """Mean and deviation of the samples and the share of zeros."""
    x = np.frombuffer(data, np.uint8)
    return f"mean={x.mean():.4f};std={x.std():.4f};zero={(x == 0).mean():.4f}"


BACK = (
    "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, copies long"
)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """The registered query's columns for each stored row, from payloads read back from the store, each once."""
    dictionary = read_dictionary(spark, path)
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in BACK.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _decompressor(dictionary)
        for batch in it:
            out = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, form = rebuild(row, dec), row["manifest"]
                sha = hashlib.sha256(data).hexdigest()
                out.append((row["payload"], len(data), sha, zlib.crc32(data[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(data), row["copies"]))
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = spark.read.parquet(f"{path}/rows")
    back = materialise(read(spark, path).mapInArrow(run, BACK), "payloads")
    limit = max(rows.count() // HOT_SHARE, 1)
    return join_hot(rows, back, ["payload"], F.col("copies") > limit).select(F.col("key").alias("doc_id"), "n_bytes", *names[1:-1])
