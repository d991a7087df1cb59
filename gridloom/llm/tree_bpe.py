"""BPE encoding and decoding by tree concatenation.

Texts of more than ``LEAF_CHARS`` characters are halved until the pieces are small, pieces are encoded
in parallel as rows of their own, and neighbours are joined pairwise up the tree: a window of tokens
around each join is encoded again and doubled until its outer tokens agree, in id and span, with those
of both sides. The window then holds exactly the tokens that the whole text has there; at the latest
it spans both sides. A shorter text is one leaf of the tree and is encoded where it stands.

A leaf is encoded a batch at a time: classes of characters cut the texts into runs of letters, digits
and marks, each distinct run is encoded once by the tokenizers library, and arrays of ids are gathered
from these, without an object for each word. That is exact where the tokenizer drops white space and
cuts at those classes before it merges (``splits_words``). Stretches between spaces with anything
that isn't plain (apostrophes, letters beyond Latin-1, other white space, added tokens) are encoded as
they are, which is exact where white space alone parts tokens (``splits_at_space``); for other
tokenizer files whole pieces are encoded.

Cases: null text is empty and has no tokens; repeated rows each get a result row; other columns are
ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

#: Characters below which a piece isn't halved any more: pieces that one task encodes in milliseconds.
LEAF_CHARS = 16_384
#: The first window's tokens on each side of a join.
FIRST_WINDOW = 24
#: Outer tokens of a window that must agree.
AGREE = 6
#: A long text with more than one in so many of the long rows is hot: its copies are dealt out.
HOT_SHARE = 1_024
#: Words and stretches whose ids a Python worker keeps, and characters encoded at once.
CACHE_WORDS, PART_CHARS = 250_000, 1_500_000
#: Fixed: the splitter whose matches are runs of letters, single digits and runs of marks.
WORD_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _kinds() -> np.ndarray:
    """Classes of the characters below U+0100; what isn't plain there is OTHER."""
    out = np.full(256, OTHER, np.uint8)
    out[[ord(c) for c in string.ascii_letters]] = LETTER
    out[0xC0:0x100] = LETTER
    out[[0xD7, 0xF7]] = OTHER  # the signs for times and divided by
    out[[ord(c) for c in string.digits]] = DIGIT
    out[[ord(c) for c in string.punctuation if c != "'"]] = MARK  # an apostrophe may begin a contraction
    out[[9, 10, 13, 32]] = SPACE
    return out


KINDS = _kinds()
LOWER = np.frombuffer(bytes(range(256)).decode("latin-1").lower().encode("latin-1"), np.uint8)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splits_at_space(path: str) -> bool:
    """Whether white space always separates tokens and is dropped, in normaliser, splitter and model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    pres = pre.get("pretokenizers", [pre] if pre else [])
    local = all(
        n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")
        or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        for n in norms
    )
    split = [p for p in pres if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
    drops = any("[^\\s\\p{L}\\p{N}]" in p["pattern"].get("Regex", "") and "\\s?" not in p["pattern"]["Regex"] for p in split)
    rest = all(p["type"] == "Split" or p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pres)
    added = all(not any(c.isspace() for c in a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in spec["added_tokens"])
    return local and drops and rest and added and spec.get("post_processor") is None


def splits_words(path: str) -> bool:
    """Whether runs of letters, digits and marks are always encoded apart and in lower case."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norms, pres = (spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    lower = [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"]
    words = len(pres) == 2 and pres[0]["type"] == "Split" and pres[0]["pattern"].get("Regex") == WORD_SPLITTER and pres[1]["type"] == "ByteLevel"
    return splits_at_space(path) and lower and words


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, the rest
    from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class Known:
    """Ids of words (bytes, in lower case and Latin-1) and stretches (text), numbered as they come up."""

    def __init__(self, tok, direct: bool):
        self.tok, self.direct, self.model, self.letters = tok, direct, tok.model, byte_letters()
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes | str, int] = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _encode(self, key: bytes | str) -> list[int]:
        if isinstance(key, bytes) and self.direct:
            spelled = key.decode() if key.isascii() else key.decode("latin-1").encode().decode("latin-1").translate(self.letters)
            return [t.id for t in self.model.tokenize(spelled)]
        return self.tok.encode(key.decode("latin-1") if isinstance(key, bytes) else key, add_special_tokens=False).ids

    def numbers(self, keys: list) -> np.ndarray:
        """The number of each of some distinct keys."""
        got = list(map(self.number.get, keys))
        new = [i for i, g in enumerate(got) if g is None]
        if new:
            each = [self._encode(keys[i]) for i in new]
            lo, n = len(self.number), np.array([len(e) for e in each])
            while len(self.first) < lo + len(new):
                self.first, self.count = np.append(self.first, np.zeros_like(self.first)), np.append(self.count, np.zeros_like(self.count))
            while len(self.ids) < self.used + n.sum():
                self.ids = np.append(self.ids, np.zeros_like(self.ids))
            self.first[lo : lo + len(new)] = self.used + np.cumsum(n) - n
            self.count[lo : lo + len(new)] = n
            self.ids[self.used : self.used + n.sum()] = [x for e in each for x in e]
            self.used += int(n.sum())
            for at, i in enumerate(new):
                got[i] = self.number[keys[i]] = lo + at
        return np.array(got, np.int64)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of words, one after the other, and where each word's begin (and the end)."""
        n = self.count[numbers]
        at = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(self.first[numbers] - at[:-1], n) + np.arange(at[-1])], at


class Encoder:
    """Ids of texts, exactly as the tokenizer gives them; one for each Python worker and file."""

    _made: dict = {}

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.by_space, self.by_word = splits_at_space(path), splits_words(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        direct = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        self.known = Known(self.tok, direct)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def full(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the end)."""
        got, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for owner, part in self._parts(texts):
            if self.by_space:
                ids, at = self._words(part)
                np.add.at(counts, owner, np.diff(at))
            else:
                each = self.tok.encode_batch_fast(part, add_special_tokens=False)
                np.add.at(counts, owner, [len(e.ids) for e in each])
                ids = np.array([x for e in each for x in e.ids], np.uint32)
            got.append(ids)
        return np.concatenate(got), np.concatenate(([0], np.cumsum(counts)))

    def _parts(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Lists of about ``PART_CHARS`` characters and whose they are; longer texts are cut at spaces where
        that changes nothing."""
        owner, part, size = [], [], 0
        for i, text in enumerate(texts):
            while text:
                cut = len(text)
                if self.by_space and cut > PART_CHARS:
                    cut = text.rfind(" ", 1, PART_CHARS)
                    cut = cut if cut > 0 else text.find(" ", PART_CHARS)
                    cut = cut if cut > 0 else len(text)
                owner.append(i), part.append(text[:cut])
                size, text = size + cut, text[cut:]
                if size >= PART_CHARS:
                    yield owner, part
                    owner, part, size = [], [], 0
        if part:
            yield owner, part

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts from those of their words."""
        if len(self.known.number) > CACHE_WORDS:
            self.known.clear()
        joined = "\n".join([*texts, ""])
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        try:
            codes = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            wide = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            codes = np.where(wide < 256, wide, 0x80).astype(np.uint8)  # 0x80 is OTHER
        kind = KINDS[codes]
        odd = kind == OTHER if self.by_word else kind != SPACE
        if self.by_word and "<|" in joined:
            odd[np.flatnonzero((codes[:-1] == ord("<")) & (codes[1:] == ord("|")))] = True
        # stretches between spaces that hold anything odd are looked up as they are
        gaps = np.flatnonzero(kind == SPACE)
        which = np.unique(np.searchsorted(gaps, np.flatnonzero(odd)))
        lo, hi = np.where(which > 0, gaps[which - 1] + 1, 0), gaps[which]
        if len(which):
            edge = np.zeros(len(kind) + 1, np.int8)
            edge[lo], edge[hi] = 1, -1
            kind[np.cumsum(edge[:-1], dtype=np.int8) > 0] = SPACE
        held = kind != SPACE
        before = np.concatenate(([np.uint8(SPACE)], kind[:-1]))
        start = np.flatnonzero(held & ((kind != before) | (kind == DIGIT)))
        off = (np.cumsum(held, dtype=np.int32)[start] - 1).astype(np.int32)
        data = LOWER[codes[held]]
        off = np.append(off, np.int32(len(data)))
        runs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode()
        number = self.known.numbers(runs.dictionary.to_numpy(zero_copy_only=False).tolist())[runs.indices.to_numpy()]
        if len(which):
            odd_texts = [joined[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            code = {t: i for i, t in enumerate(dict.fromkeys(odd_texts))}
            odd_no = self.known.numbers(list(code))[[code[t] for t in odd_texts]]
            start = np.concatenate((start, lo))
            order = np.argsort(start, kind="stable")
            start, number = start[order], np.concatenate((number, odd_no))[order]
        ids, at = self.known.gather(number)
        return ids, at[np.searchsorted(start, begin)]


def batches(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of a list of texts of about ``limit`` characters, with their first index."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class Piece:
    """Part of a text with its ids; the spans of its outer tokens are found when a join asks for them."""

    __slots__ = ("text", "ids", "_head", "_tail")

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids
        self._head, self._tail = [], []

    def head(self, enc: Encoder, n: int) -> list[tuple[int, int]]:
        """Spans of the first n tokens (or all), from the text's start.

        A prefix cut at a space is encoded where that is known to give the same; else the whole text.
        """
        n, reach = min(n, len(self.ids)), 8 * n
        while len(self._head) < n:
            cut = self.text.find(" ", reach) if enc.by_space else -1
            self._head = enc.full(self.text[:cut] if cut > 0 else self.text).offsets
            reach *= 2
        return self._head[:n]

    def tail(self, enc: Encoder, n: int) -> list[tuple[int, int]]:
        """Spans of the last n tokens (or all), from the text's start."""
        n, reach = min(n, len(self.ids)), 8 * n
        while len(self._tail) < n:
            cut = max(self.text.rfind(" ", 0, max(len(self.text) - reach, 0)), 0) if enc.by_space else 0
            self._tail = [(a + cut, b + cut) for a, b in enc.full(self.text[cut:]).offsets]
            reach *= 2
        return self._tail[len(self._tail) - n :]


def _clean(spans: list, at: int) -> bool:
    """Whether a token can start a window: a span of its own that begins where no other reaches."""
    return spans[at][0] < spans[at][1] and (at == 0 or spans[at - 1][1] <= spans[at][0])


def _left(enc: Encoder, a: Piece, n: int) -> int:
    """Tokens of the left side in the window: n of them, and more until one can start it."""
    while n < len(a.ids):
        spans = a.tail(enc, n + 1)
        if len(spans) > n and _clean(spans, len(spans) - n):
            return n
        n += 1
    return len(a.ids)


def _right(enc: Encoder, b: Piece, n: int) -> int:
    """Tokens of the right side in the window: the next one can start another."""
    while n < len(b.ids):
        spans = b.head(enc, n + 1)
        if _clean(spans, n):
            return n
        n += 1
    return len(b.ids)


def join(enc: Encoder, a: Piece, b: Piece) -> Piece:
    """The piece of both texts."""
    if not a.text or not b.text:
        return b if not a.text else a
    text, cut, n, k = a.text + b.text, len(a.text), FIRST_WINDOW, AGREE
    while True:
        x, y = _left(enc, a, n), _right(enc, b, n)
        left_all, right_all = x == len(a.ids), y == len(b.ids)
        a_spans, b_spans = a.tail(enc, x), b.head(enc, y)
        lo = 0 if left_all else a_spans[0][0]
        hi = len(text) if right_all else cut + b_spans[-1][1]
        got = enc.full(text[lo:hi])
        ids, spans = np.array(got.ids, np.uint32), got.offsets
        both = left_all and right_all
        left_ok = left_all or (
            x > 2 * k and (ids[:k] == a.ids[len(a.ids) - x :][:k]).all() and [(s + lo, e + lo) for s, e in spans[:k]] == a_spans[:k]
        )
        right_ok = right_all or (
            y > 2 * k and (ids[-k:] == b.ids[y - k : y]).all() and [(s + lo - cut, e + lo - cut) for s, e in spans[-k:]] == b_spans[-k:]
        )
        if both or len(ids) >= 2 * k and left_ok and right_ok:
            out = Piece(text, np.concatenate((a.ids[: len(a.ids) - x], ids, b.ids[y:])))
            # what the window left of the outer spans still holds
            if not left_all:
                out._head = a._head[: len(a.ids) - x]
            if not right_all:
                kept = min(len(b._tail), len(b.ids) - y)
                out._tail = [(s + cut, e + cut) for s, e in b._tail[len(b._tail) - kept :]]
            return out
        n = 2 * max(n, x if not left_all else 0, y if not right_all else 0)


def halves(text: str, least: int) -> list[str]:
    """Pieces of a text, halved until none is longer than ``least``; a power of two of them."""
    parts = [text]
    while max(map(len, parts)) > least:
        parts = [x for p in parts for x in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


def concatenate(enc: Encoder, level: list[Piece]) -> np.ndarray:
    """Ids of the whole text from those of its pieces, joined pairwise up the tree."""
    while len(level) > 1:
        level = [join(enc, level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].ids


def encode_tree(path: str, text: str, least: int = LEAF_CHARS) -> list[int]:
    """One text by the method, in this process."""
    enc = Encoder.of(path)
    parts = halves(text, least)
    ids, at = enc.flat(parts)
    return concatenate(enc, [Piece(p, ids[a:b]) for p, a, b in zip(parts, at[:-1], at[1:], strict=True)]).tolist()


class Decoder:
    """What the library's ``decode(ids, skip_special_tokens=False)`` gives, from a table of tokens.

    Without a decoder in the file the library joins tokens with spaces; else it is called.
    """

    _made: dict = {}

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.plain = self.tok.decoder is None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([self.tok.id_to_token(i) or "" for i in range(size)]) if self.plain else None
        self.numbers = pa.array([str(i) for i in range(size)])

    @classmethod
    def of(cls, path: str) -> "Decoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def texts(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        if self.plain:
            return joined(self.tokens, ids, at)
        return pa.array([self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    def text_hashes(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        if self.plain:
            return hashes(self.tokens, ids, at)
        return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in self.texts(ids, at).to_pylist()], pa.string())

    def listed(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The ids in decimal."""
        return joined(self.numbers, ids, at)


def joined(table: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each text, the entries of its ids with a space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), table.take(pa.array(ids))), " ")


def hashes(table: pa.Array, ids: np.ndarray, at: np.ndarray, limit: int = 20_000_000) -> pa.Array:
    """SHA-256, in hex, of what ``joined`` gives, of ``limit`` ids at once."""
    if len(ids) <= limit:
        got = joined(table, ids, at)
        ends, data = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1].tolist(), memoryview(got.buffers()[2] or b"")
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        sha = hashlib.sha256()
        for lo in range(a, b, limit):
            part = ids[lo : min(lo + limit, b)]
            sha.update((" " if lo > a else "").encode() + joined(table, part, np.array([0, len(part)]))[0].as_buffer().to_pybytes())
        out.append(sha.hexdigest())
    return pa.array(out, pa.string())


def raw_ids(path: str, ids: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """The ids themselves, little-endian 32-bit."""
    data = np.ascontiguousarray(ids, "<u4")
    big = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(4 * at), pa.py_buffer(data)])
    return {"ids": big.cast(pa.binary())}


def digests(path: str, ids: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """Number of tokens, and SHA-256 of the ids as text and of the decoded text."""
    dec = Decoder.of(path)
    return {"n_tokens": pa.array(np.diff(at)), "ids_sha256": hashes(dec.numbers, ids, at), "decoded_sha256": dec.text_hashes(ids, at)}


def decoded(path: str, ids: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """Number of tokens and the decoded text."""
    return {"n_tokens": pa.array(np.diff(at)), "decoded": Decoder.of(path).texts(ids, at)}


#: What each way to finish a document adds to its row.
COLUMNS = {
    raw_ids: "ids binary", digests: "n_tokens long, ids_sha256 string, decoded_sha256 string", decoded: "n_tokens long, decoded string",
}


def encode(docs: DataFrame, path: str, least: int = LEAF_CHARS, finish=raw_ids) -> DataFrame:
    """doc_id and what ``finish`` makes of a text's ids, for each row.

    Rows of short texts are encoded where they are. Pieces of long ones are dealt out, encoded, and
    brought together again by text, so equal long texts are encoded once. Ids are finished in the task
    that has them, so that a stage runs one Python worker and long ids aren't shuffled again.
    """
    added = COLUMNS[finish]
    names = [c.split()[0] for c in added.split(", ")]

    def plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in it:
            for start, part in batches(batch.column("text").to_pylist(), PART_CHARS):
                got = finish(path, *enc.flat(part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), *got.values()], ["doc_id", *names])
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for tag, text in zip(batch.column("_tag").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = halves(text, least)
                yield pa.RecordBatch.from_pydict({"_tag": [tag] * len(parts), "_no": list(range(len(parts))), "text": parts}, schema=piece_schema)

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for batch in it:
            for start, part in batches(batch.column("text").to_pylist(), PART_CHARS):
                rest = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rest.columns, raw_ids(path, *enc.flat(part))["ids"]], [*rest.schema.names, "ids"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_no").drop_duplicates("_no")
        ids = concatenate(Encoder.of(path), [Piece(t, np.frombuffer(b, "<u4")) for t, b in zip(pdf["text"], pdf["ids"], strict=True)])
        return pd.DataFrame({"_tag": [pdf["_tag"].iloc[0]]} | {k: v.to_pylist() for k, v in finish(path, ids, np.array([0, len(ids)])).items()})

    piece_schema = pa.schema([("_tag", pa.string()), ("_no", pa.int32()), ("text", pa.string())])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    short = rows.filter(F.length("text") <= least).mapInArrow(plain, f"doc_id {key}, {added}")
    long_ = rows.filter(F.length("text") > least).withColumn("_tag", F.sha2("text", 256))
    # copies are reduced to one text each, within tasks first, so a group is one text's pieces
    cut = long_.select("_tag", "text").distinct().mapInArrow(pieces, "_tag string, _no int, text string")
    done = cut.repartition("_tag", "_no").mapInArrow(encoded, "_tag string, _no int, text string, ids binary")
    whole = done.groupBy("_tag").applyInPandas(merged, f"_tag string, {added}")
    return short.unionAll(_back(materialise(long_.select("doc_id", "_tag"), "long"), whole).select("doc_id", *names))


def _back(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows (read from a table, so that their numbers are the same in every run of a task) with what their text
    gave. A hot text's rows are dealt in parts of a 1,024th of all, each of which gets the text's row; these
    are 2,048 more at most, and their size doesn't matter, since nothing but hashes and counts is broadcast."""
    limit = max(rows.count() // HOT_SHARE, 1)
    count = rows.groupBy("_tag").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    hot = F.broadcast(count.select("_tag", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, "_tag", "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    each = whole.join(hot, "_tag", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.drop("_parts").join(each, ["_tag", "_part"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the decoded text of rows with ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            each = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            got = decoded(path, np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0] + [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *got.values()], ["doc_id", "n_tokens", "decoded"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, {COLUMNS[decoded]}")


def digest(docs: DataFrame, path: str, least: int = LEAF_CHARS) -> DataFrame:
    """The registered query's columns."""
    return encode(docs, path, least, digests)
