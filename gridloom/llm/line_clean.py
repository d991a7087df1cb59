"""Line-first cleaning: rules on every line, then a verdict on what is left of the document.

A batch of texts is one array of bytes. Words and lines are found in it at once, and counts per document
come from differences of running sums. Words and lines get exact numbers from Arrow's dictionaries; windows
of words are numbered by doubling (two words, four, eight), which is exact too and takes no hash.

A line with a word is removed if it fails one of

- punctuation: it doesn't end like a sentence and has fewer sentence ends within than one in 40 words, or runs
  of ``!`` and ``?`` or of symbols follow a third of its words;
- navigation: a fourth of its words are separators, or it is a menu entry;
- boilerplate: it holds a phrase of licences, notices or page machinery.

Lines without a word stay. A document is rejected if the base rules fail (fewer than ``LEAST_WORDS`` words,
or more than ``MOST_REPEATED`` percent of them in repeated windows), or if removed lines hold more than
``MOST_LOST`` percent of the code points of its words.

Cases: null text has no words and fails the base rules, as empty text does; repeated rows each get a result;
an empty table gives none; other columns pass through, whatever their names. A text is never cut: the arrays
of one text take about 60 times its bytes while it is at work (a text of 10 MB about 600 MB), texts beyond
``SLICE`` bytes one at a time.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import fresh

#: Fixed values of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: Percent of the words' code points that removed lines may hold.
MOST_LOST = 50
#: Rules of lines, as expressions without backtracking (RE2's); space is U+0020 and U+0009 to U+000D.
ENDS_WELL = r"""[.!?…。！？]["'”’»)\]*]*[\x20\x09-\x0D]*$"""
SENTENCE = r"[.!?…。！？][\x20\x09-\x0D]"
NOISE = r"[!?]{2,}|[#*$%&|<>]{2,}"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|»›•·>/–]+"
MENU = (
    r"(?i)^[\x20\x09-\x0D]*(?:home|menu|search|log ?in|log ?out|sign (?:in|up|out)|register|contact(?: us)?|about(?: us)?|next|previous"
    r"|read more|more|back to top|skip to (?:main )?content|share|print|comments?|site ?map|faq)[^\pL\pN]*$"
)
BOILERPLATE = (
    r"(?i)all rights reserved|copyright (?:\(c\)|©|\d{4})|©|terms of (?:use|service)|privacy policy|cookie policy|uses cookies"
    r"|enable javascript|lorem ipsum|licensed under|released under the|is licensed|powered by|click here|subscribe to our"
)
RULES = ("punctuation", "navigation", "boilerplate")
#: Bytes of texts that are worked on together.
SLICE = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BREAK = 0x0A

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long,"
    " n_punctuation long, n_navigation long, n_boilerplate long, kept_chars long, kept boolean, cleaned string"
)


def _strings(raw: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Strings that lie one after the other in ``raw``."""
    at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])


def _numbers(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def repeated(words: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word (a number) whether a window of ``window`` words, a power of two, that holds it is found
    twice or more in its document."""
    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    if n >= window:
        key = pd.factorize(doc * (words.max() + 1) + words)[0].astype(np.int64)
        width = 1
        while width < window:
            key = pd.factorize(key[:-width] * (key.max() + 1) + key[width:])[0].astype(np.int64)
            width *= 2
        key = np.where(doc[: n - window + 1] == doc[window - 1 :], key, -1)
        start = np.flatnonzero((key >= 0) & (np.bincount(key[key >= 0], minlength=key.max() + 2)[key] > 1))
        np.add.at(hit, start, 1)
        np.add.at(hit, np.minimum(start + window, n), -1)
    return np.cumsum(hit)[:n] > 0


def failing(lines: pa.Array, n_words: np.ndarray) -> list[np.ndarray]:
    """For each rule which lines fail it; ``n_words`` are the lines' words."""
    find = lambda rule: pc.match_substring_regex(lines, rule).to_numpy(zero_copy_only=False)
    count = lambda rule: pc.count_substring_regex(lines, rule).to_numpy(zero_copy_only=False)
    some = n_words > 0
    return [
        some & (~find(ENDS_WELL) & (40 * count(SENTENCE) < n_words) | (3 * count(NOISE) > n_words)),
        some & ((4 * count(SEPARATOR) > n_words) | find(MENU)),
        some & find(BOILERPLATE),
    ]


def measure(texts: pa.Array) -> dict[str, pa.Array]:
    """The columns of ``FIELDS`` for texts without nulls."""
    texts = texts.cast(pa.string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off -= off[0]
    raw = np.insert(data, off[1:], _BREAK)  # every text ends with a break, so lines never cross texts
    begin = off + np.arange(n + 1)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[begin])

    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(begin, start, "right") - 1
    words = _numbers(_strings(raw[~space], stop - start, pa.binary()))
    char = ~space & ((raw & 0xC0) != 0x80)
    sums = np.concatenate(([0], np.cumsum(char, dtype=np.int64)))

    end = np.flatnonzero(raw == _BREAK)
    top = np.concatenate(([0], end[:-1] + 1))
    lines = _strings(raw[raw != _BREAK], end - top, pa.string())
    line_doc = np.searchsorted(begin, top, "right") - 1
    line_words = np.bincount(np.searchsorted(end, start), minlength=len(end))
    line_chars = sums[end] - sums[top]
    of = _numbers(lines)
    again = (line_words > 0) & pd.Series(np.where(line_words > 0, line_doc * (of.max(initial=0) + 1) + of, -1)).duplicated().to_numpy()

    fails = failing(lines, line_words)
    gone = np.logical_or.reduce(fails)
    by_doc = lambda mask, weight=None: np.bincount(line_doc[mask], None if weight is None else weight[mask], n).astype(np.int64)
    n_words, word_chars = np.bincount(doc, minlength=n), per(char)
    n_repeat = np.bincount(doc[repeated(words, doc)], minlength=n)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    kept_chars = word_chars - by_doc(gone, line_chars)

    # bytes of lines that stay, each with its break but for the last one of a document
    stays = np.flatnonzero(~gone)
    last = np.concatenate((line_doc[stays][1:] != line_doc[stays][:-1], [True]))[: len(stays)]
    mask = np.repeat(~gone, end - top + 1)
    mask[end[stays[last]]] = False
    count = {f"n_{name}": by_doc(f) for name, f in zip(RULES, fails, strict=True)}
    columns = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": per(_SYMBOL[raw]), "n_dup_lines": by_doc(again),
        "n_repeat_words": n_repeat, "base_failed": failed, "n_lines": by_doc(line_words > 0), **count, "kept_chars": kept_chars,
        "kept": ~failed & (100 * (word_chars - kept_chars) <= MOST_LOST * word_chars),
    }
    out = {k: pa.array(v if v.dtype == bool else v.astype(np.int64)) for k, v in columns.items()}
    return out | {"cleaned": _strings(raw[mask], per(mask), pa.string())}


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, rows) of runs of texts with at most ``most`` bytes, or one text."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")), at + 1)
        yield at, to - at
        at = to


def with_lines(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out`` of the columns in ``FIELDS``."""
    fields = T.StructType.fromDDL(FIELDS)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, fields)])
    at, names = docs.columns.index(text), [*docs.columns, out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = pc.fill_null(batch.column(at), "")
            for lo, k in slices(texts):
                got = measure(texts.slice(lo, k))
                struct = pa.StructArray.from_arrays([got[f.name] for f in fields], names=fields.names)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, k).columns, struct], names=names)

    return docs.mapInArrow(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with failing lines removed from ``text``; all columns of ``docs``."""
    (found,) = fresh(docs, "found")
    kept = with_lines(docs, found).filter(F.col(f"{found}.kept"))
    return kept.withColumn("text", F.col(f"{found}.cleaned")).drop(found)


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns, then lines removed by rule and the code points left."""
    found = with_lines(docs.select("doc_id", "text"), "found")
    return found.select("doc_id", *[f"found.{f.name}" for f in T.StructType.fromDDL(FIELDS) if f.name != "cleaned"])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g JOIN twice USING (r, g), range({WINDOW}) AS t(k) GROUP BY r),
l AS (SELECT r, unnest(split(text, chr(10))) AS line, generate_subscripts(split(text, chr(10)), 1) AS i FROM d),
c AS (SELECT r, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again, length(array_to_string(ws, '')) AS chars,
    (NOT regexp_matches(line, '{ENDS_WELL.replace("'", "''")}') AND 40 * len(regexp_extract_all(line, '{SENTENCE}')) < len(ws))
        OR 3 * len(regexp_extract_all(line, '{NOISE}')) > len(ws) AS punctuation,
    4 * len(regexp_extract_all(line, '{SEPARATOR}')) > len(ws) OR regexp_matches(line, '{MENU}') AS navigation,
    regexp_matches(line, '{BOILERPLATE}') AS boilerplate
    FROM c WHERE len(ws) > 0),
s AS (SELECT r, count(*) AS n_lines, count_if(again) AS n_dup_lines, count_if(punctuation) AS n_punctuation,
    count_if(navigation) AS n_navigation, count_if(boilerplate) AS n_boilerplate, sum(chars) AS word_chars,
    sum(CASE WHEN punctuation OR navigation OR boilerplate THEN 0 ELSE chars END) AS kept_chars FROM f GROUP BY r),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[{SYMBOLS}]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_punctuation, 0)::BIGINT AS n_punctuation,
    coalesce(n_navigation, 0)::BIGINT AS n_navigation, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate, coalesce(kept_chars, 0)::BIGINT AS kept_chars
    FROM w LEFT JOIN s USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * (word_chars - kept_chars) <= {MOST_LOST} * word_chars AS kept FROM b
"""
