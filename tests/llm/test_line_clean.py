"""Line-first cleaning against a plain reading of the rules."""

import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import line_clean

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PIECES = ["a", "bé", "the", " ", "\n", "\t", "\r", "|", "##", "!!", "x.", "Menu", "😀", "\x0b", " ", "\u0085", "all rights reserved", "end."]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(8)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(again)


def rows(texts):
    got = line_clean.measure(pa.array(texts, pa.string()))
    return [dict(zip(got, r, strict=True)) for r in zip(*(v.to_pylist() for v in got.values()), strict=True)]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_base_counts(texts):
    for text, r in zip(texts, rows(texts), strict=True):
        assert tuple(r[c] for c in BASE) == plain(text)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["cleaned"].count("\n") <= text.count("\n")
        if not any(r[f"n_{k}"] for k in line_clean.RULES):
            assert r["cleaned"] == text and r["kept_chars"] == r["word_chars"]


def test_windows_that_overlap_themselves():
    for n in (7, 8, 9, 30):
        assert rows(["a " * n, "b"])[0]["n_repeat_words"] == (0 if n < 9 else n)
    block = " ".join(f"w{i}" for i in range(8))
    assert rows([f"{block} x {block}", block])[0]["n_repeat_words"] == 16
    assert rows([block, block])[1]["n_repeat_words"] == 0  # windows of other documents don't count


def test_rules_of_lines():
    good = "This line ends as a sentence does, and it has enough words to count."
    bad = ["Home", "Log in", "one | two | three | four", "WHAT!! NOW!! YES!!", "Copyright 2020 Some Body.", "no end of a sentence here", "a$$$ b### c%%% d."]
    other = "Another one follows here, with words that stand nowhere else in this text; that makes it new."
    text = "\n".join([good, *bad, "", other])
    (r,) = rows([text])
    assert r["cleaned"] == f"{good}\n\n{other}" and r["n_lines"] == 9 and r["kept"]
    assert r["kept_chars"] == sum(len(x) for x in re.findall(r"\S+", f"{good}\n{other}"))
    long = " ".join([good] * 3 + ["and a tail without an end"])
    assert rows([long])[0]["n_punctuation"] == 0
    (r,) = rows(["\n".join([good] + [f"{i} stone {i + 100} water {i + 200} bread {i * 7}" for i in range(20)])])
    assert not r["kept"] and not r["base_failed"] and r["cleaned"] == good


def test_frames(spark):
    texts = [None, "", " ", "\n\n", "word " * 5000, "É" * 300, "Good sentence with many words in it. " * 2]
    distinct = " ".join(f"w{i}" for i in range(30)) + "."
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(50, distinct, "y", 2)] * 3 + [(None, distinct, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, found string, n_words int")
    got = line_clean.digest(df).collect()
    assert len(got) == len(data)
    for r in got:
        want = plain(dict((d[0], d[1]) for d in data)[r["doc_id"]] or "")
        assert tuple(r[c] for c in BASE) == want
    assert sorted(line_clean.cleaned(df).select("doc_id", "text", "found", "n_words").collect(), key=str) == sorted(
        df.filter("doc_id = 50 or doc_id is null").collect(), key=str
    )
    assert line_clean.digest(df.limit(0)).count() == 0 and line_clean.cleaned(df.limit(0)).count() == 0


def test_slices_hold_every_row():
    texts = pa.array(["a" * n for n in (3, 0, 50, 2, 2, 100, 0)])
    found = list(line_clean.slices(texts, 10))
    assert [x for lo, k in found for x in range(lo, lo + k)] == list(range(7)) and len(found) > 3
