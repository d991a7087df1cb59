"""Corpus operators against brute force and on the edges: nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns of clashing names."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import components, decontaminate, media, ngram_join, quality, secrets, token_store, tool_calls, toxicity, tree_bpe, url_rules

from gridloom.llm.common import NOT_WORD

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, key string, tag string, start string, score string, words string, _w string, lang string"


def docs(spark, texts):
    rows = [(i, t, "k", "t", "s", "x", "w", "z", "en") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def listed(spark, pairs):
    return spark.createDataFrame([(i, t, "k", "t", "s", "x", "w", "z", "en") for i, t in pairs], SCHEMA)


EDGES = [None, "", " ", "\n\n", "a", "a b c d e", "É" * 300, "word " * 3000, "😀́<|endoftext|>x", "a b c d e"]


# -- 1 and 6 -----------------------------------------------------------------------------------------


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for mode in ("byte", "bit"):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, 2**32, n, dtype=np.uint64)
            assert (token_store.unpack(token_store.pack(ids, mode), n, mode, 4) == ids).all()


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_crc_of_parts(parts):
    assert token_store.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_store(spark, tmp_path, mode):
    tok = tree_bpe.load_tokenizer(PATH)
    df = listed(spark, [*enumerate(EDGES), (None, "none"), (3, "again"), (3, "again")])
    token_store.write(df, str(tmp_path / "s"), PATH, 2, mode, block=64)
    got = token_store.read_digests(spark, str(tmp_path / "s")).collect()
    order = sorted(((i, t or "") for i, t in [*enumerate(EDGES), (None, "none"), (3, "again"), (3, "again")]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    at, want = 0, []
    for i, t in order:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    stream = sorted(token_store.read_ids(spark, str(tmp_path / "s")).collect(), key=lambda r: (r["shard"], r["first_id"]))
    assert sum(len(r["ids"]) for r in stream) == at


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    token_store.write(none, str(tmp_path / "e"), PATH, 2)
    assert token_store.read_digests(spark, str(tmp_path / "e")).count() == 0
    assert tree_bpe.digest(none, PATH).count() == 0
    media.write(none, str(tmp_path / "m"))
    assert media.digest(spark, str(tmp_path / "m")).count() == 0
    assert ngram_join.near_copies(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert secrets.scan(none, secrets.train(secrets.labelled_samples(none))).count() == 0


ALPHABET = ["a", "the", "ing", " ", "\n", "'s", "'ll", "'", "É", "ß", "中", "😀", "<|endoftext|>", "<|", "|>", "1", "23", "!!", "...", "́", "İ", "Σ", "ﬁ", "\t", "\x0b", "x" * 40, "(the", "word,", "_x_", "ı"]


@given(st.lists(st.sampled_from(ALPHABET), max_size=120), st.sampled_from([3, 17, 64]))
@settings(max_examples=150, deadline=None)
def test_tree_equals_library(parts, least):
    text, enc = "".join(parts), tree_bpe.Encoder.of(PATH)
    want = enc.full(text).ids
    other = ["", text[::-1], "x"]
    ids, at = enc.flat([text, *other])
    assert ids.tolist() == [i for t in (text, *other) for i in enc.full(t).ids] and at.tolist()[:2] == [0, len(want)] and len(at) == 5
    assert tree_bpe.encode_tree(PATH, text, least) == want
    ids = np.array(want, "<u4")
    dec, at = tree_bpe.Decoder.of(PATH), np.array([0, len(ids)])
    assert dec.texts(ids, at).to_pylist() == [enc.tok.decode(want, skip_special_tokens=False)]
    assert dec.listed(ids, at).to_pylist() == [" ".join(map(str, want))]
    for limit in (7, 1000):
        got = tree_bpe.hashes(dec.numbers, np.concatenate((ids, ids)), np.array([0, len(ids), 2 * len(ids)]), limit).to_pylist()
        assert got == [hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()] * 2


def test_tree_without_any_space(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["th", "er", "on", "é", "1", "-"]) for _ in range(4000))
    df = listed(spark, [(1, text), (2, text), (None, text), *((i + 10, t) for i, t in enumerate(EDGES))])
    tok = tree_bpe.load_tokenizer(PATH)
    got = sorted(map(tuple, tree_bpe.encode(df, PATH, 500).collect()), key=str)
    want = [(r["doc_id"], bytearray(np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes())) for r in df.collect()]
    assert sorted(((a, bytes(b)) for a, b in got), key=str) == sorted(((a, bytes(b)) for a, b in want), key=str)
    back = {r["doc_id"]: r["decoded"] for r in tree_bpe.decode(tree_bpe.encode(df, PATH, 500), PATH).collect()}
    assert back[1] == tok.decode(tok.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


# -- 2 -----------------------------------------------------------------------------------------------


def test_bands_reach_recall():
    b = ngram_join.bands_for(0.8, 4, 0.9995)
    assert 1 - (1 - 0.8**4) ** b >= 0.9995 > 1 - (1 - 0.8**4) ** (b - 1)


def brute(texts):
    word = re.compile(NOT_WORD)
    sets = {}
    for i, t in texts.items():
        w = [x for x in word.split((t or "").translate(ASCII_LOWER)) if x]
        k = min(5, len(w))
        sets[i] = (tuple(w), {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    links = {i: 0 for i in texts}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            x, y = sets[a][1], sets[b][1]
            if a < b and x and y and len(x & y) * 1.8 + 1e-9 >= 0.8 * (len(x) + len(y)):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (find(i), links[i]) for i in texts}


def test_near_copies_with_a_large_group(spark, monkeypatch):
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = {}
    for i in range(90):  # near copies, more than a block holds
        w = list(base)
        w[rng.randrange(120)] = "changed%d" % rng.randrange(9)
        texts[i] = " ".join(w)
    for i in range(100, 160):
        texts[i] = " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 40, 80])))
    texts |= {200: None, 201: "", 202: texts[120], 203: texts[120].upper() + "!", 204: "a b", 205: "a  b", 206: "?!", 207: "?!"}
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_copies(docs(spark, texts)).collect()}
    assert got == brute(texts)
    kept = ngram_join.one_of_each(docs(spark, texts))
    assert kept.columns == docs(spark, {}).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (c, _) in got.items() if c == i}


def test_near_copies_null_ids_and_repeats(spark):
    got = ngram_join.near_copies(listed(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, None, 0), (1, 1, 1, 1), (1, 1, 1, 1)], key=str)


def test_repeats_beside_near_copies(spark):
    rng = random.Random(8)
    words = lambda: ["w%d" % rng.randrange(300) for _ in range(80)]
    x, z, other = words(), words(), " ".join(words())
    change = lambda w, k: " ".join([*w[:k], "other%d" % k, *w[k + 1 :]])
    x, y, z1, z2 = " ".join(x), change(x, 40), change(z, 20), change(z, 21)
    # repeated rows and a near copy; an id with two unlike texts; an id whose texts are near copies; null and wordless rows
    rows = [(1, x), (1, x), (2, y), (3, x.upper()), (2, other), (4, other), (5, z1), (5, z2), (6, z1), (None, x), (None, x), (7, ""), (7, "")]
    got = sorted(map(tuple, ngram_join.near_copies(listed(spark, rows)).collect()), key=str)
    want = [(1, 1, 1, 3), (1, 1, 1, 3), (2, 2, 1, 3), (3, 1, 1, 3), (2, 2, 2, 1), (4, 2, 2, 1), (5, 5, 5, 2), (5, 5, 5, 2), (6, 5, 5, 2)]
    assert got == sorted([*want, *[(None, None, None, 0)] * 2, *[(7, 7, 7, 0)] * 2], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(listed(spark, rows)).collect()), key=str)
    assert [r for r in kept if r[0] != 5] == sorted([(1, x), (2, other), (None, x), (None, x), (7, ""), (7, "")], key=str)
    assert len([r for r in kept if r[0] == 5]) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["v"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# -- 3 -----------------------------------------------------------------------------------------------


def brute_hits(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(ASCII_LOWER))
    out = {}
    for d, t in texts.items():
        w, hit, ids = words(t), set(), set()
        for i, b in items.items():
            bw = words(b)
            n = min(10, len(bw))
            wins = {tuple(bw[p : p + n]) for p in range(len(bw) - n + 1)} if bw else set()
            for p in range(len(w) - n + 1):
                if wins and tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids.add(i)
        out[d] = (len(w), len(hit), sorted(map(str, ids)))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    rng = random.Random(5)
    vocab = ["alpha", "Béta", "É", "3", "of", "of", "the"]
    items = {i: " ".join(rng.choice(vocab) for _ in range(n)) for i, n in enumerate([3, 9, 10, 14, 30, 30])} | {10: None, 11: "", 12: "solo"}
    texts = {}
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 12, 60]))]
        if i % 3 == 0:
            it = items[rng.choice([2, 3, 4, 5])].upper().split(" ")
            a = rng.randrange(0, len(it) - 9)
            w[5:5] = it[a : a + rng.choice([9, 10, 12])]
        texts[i] = rng.choice([" ", ", ", "--"]).join(w)
    texts |= {50: None, 51: "", 52: "say SOLO now"}
    bench = spark.createDataFrame([*items.items(), (4, items[4])], "item_id long, text string").withColumn("_w", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert got == brute_hits(texts, items)
    for r in decontaminate.contamination_spans(docs(spark, {1: "x y " + items[4] + " z"}), bench.filter("item_id = 4")).collect():
        assert (r["start"], r["end"], r["items"]) == (2, 32, ["4"])


# -- 4 -----------------------------------------------------------------------------------------------


def brute_spans(text):
    rules = [
        ("assign", re.compile(secrets.ASSIGN), lambda m: len(m[1]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, r, ok) in enumerate(rules) for m in r.finditer(text or "") if ok(m)]
    return ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(found))


def brute_random(text, model):
    """Random tokens outside the base spans, character by character."""
    flat = list(text or "")
    for s in [x.split(":") for x in brute_spans(text).split(",") if x]:
        flat[int(s[1]) : int(s[2])] = " " * (int(s[2]) - int(s[1]))
    k, out = len(secrets.ALPHABET), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", "".join(flat)):
        at = [secrets.ALPHABET.index(c) for c in m[0]]
        ratio = model.first[at[0]] + sum(model.moves[a * k + b] for a, b in zip(at, at[1:]))
        if len(set(m[0])) >= 8 and ratio >= model.threshold:
            out.append((m.start(), 3, "random", m.end()))
    return out


def all_spans(text, model):
    base = [(int(a), secrets.KINDS.index(n), n, int(b)) for n, a, b in (x.split(":") for x in brute_spans(text).split(",") if x)]
    return sorted(base + brute_random(text, model))


def test_secrets(spark):
    hexes, rng = hashlib.sha256(b"x").hexdigest(), random.Random(6)
    odd = lambda n: "".join(rng.choice(secrets.ALPHABET) for _ in range(n))
    texts = dict(enumerate([
        None, "", "😀 password: hunter2222 and TOKEN=\"" + hexes[:40] + "\"", "token: secret: abcdefgh1234", "secret=token=abcdefghij", "AKIA" + "A1" * 8 + " AKIAAKIAB", "api_key 'x'", "apikey = 12345678",
        hexes + "g" + hexes[:31], "x" * 5000, "key Zk3Qx9vLw2Rt8Yb5Nc7Mf4Hj1Pd6Gs0 here", "internationalisation_of_identifiers", "pass" + "word:" + "a" * 8,
        "=-" * 40 + " " + "_" * 30, "Zk3Qx9vLw2Rt8Yb5Nc7Mf4Hj" + hexes[:32] + "Qx9vLw2Rt8Yb5Nc7Mf4", "É ".join(odd(n) for n in (15, 16, 17, 30, 64)),
        " ".join(hexes[: 32 + i % 9] + "é" for i in range(700)), " ".join("a" * (i % 4) + odd(20) for i in range(600)), "the quick brown foxes jump_over_lazy_dogs " * 3,
    ]))
    plain = docs(spark, {i: "the quick brown fox jumps over lazy dogs %d and identifiers follow" % i for i in range(200)})
    model = secrets.train(secrets.labelled_samples(plain))
    rows = [*texts.items(), (None, texts[10]), (10, texts[10]), (10, texts[10])]
    got = secrets.digest(secrets.scan(listed(spark, rows), model)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"] if r["doc_id"] is not None else 10]
        want = all_spans(t, model)
        line = lambda spans: ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)
        assert r["base_sha256"] == hashlib.sha256(brute_spans(t).encode()).hexdigest() and r["spans"] == line(want), t
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["n_random"]] == [sum(k == n for _, k, _, _ in want) for n in range(4)]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["spans"] == "random:4:35" and by_id[14]["n_random"] == 2
    assert [by_id[i]["n_random"] for i in (9, 11, 13, 18)] == [0] * 4
    wide = docs(spark, texts).withColumn("base", F.lit(1)).withColumn("spans", F.lit(2))
    clean = {r["doc_id"]: r for r in secrets.redacted(wide, model).collect()}
    assert clean[0]["text"] is None and clean[7]["text"] == "[SECRET]" and clean[10]["text"] == "key [SECRET] here" and clean[10]["base"] == 1


def test_markov_models_are_counts(spark):
    rows = [("abab", 0, 2), ("Q1Q", 1, 3), ("a", 0, 5), ("aé", 1, 1)]
    samples = spark.createDataFrame(rows, "token string, label int, n long").filter(~((F.pmod(F.xxhash64("token"), F.lit(secrets.HELD_OUT)) == 0)))
    kept = [tuple(r) for r in samples.collect()]
    m, k = secrets.train(samples), len(secrets.ALPHABET)
    count = lambda label, a, b: secrets.PRIOR + sum(n * sum(x == a and y == b for x, y in zip(" " + t, t)) for t, c, n in kept if c == label and len(t) > 1 and "é" not in (a, b))
    prob = lambda label, a, b: count(label, a, b) / sum(count(label, a, c) for c in secrets.ALPHABET)
    for a, b in ((" ", "a"), (" ", "Q"), ("a", "b"), ("Q", "1"), ("1", "Q"), ("b", "a")):
        want = np.log(prob(1, a, b) / prob(0, a, b))
        at = secrets.ALPHABET.index(b)
        assert (m.first[at] if a == " " else m.moves[secrets.ALPHABET.index(a) * k + at]) == pytest.approx(want)
    assert m.threshold == secrets.RATIO_LEAST


# -- 5 -----------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "search", '{"limit": 3, "query": "x"}', ["b"]), (1, 1, "b", "search", '{"query": 5}', []), (1, 1, "b", "search", '{"query": 6}', []),
        (1, 2, "c", "none", "{}", ["zz"]), (2, 0, "x", "search", '{"query": "q"}', ["y"]), (2, 1, "y", "search", "[1]", ["x"]), (3, 0, "p", "search", '{"b": 1, "query": "é\\"", "a": {"d": 1, "c": 2}}', None),
        (4, 0, None, "search", "{}", []), (None, 0, "n", "search", "{}", []),
    ], "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([(1, 5, "a", "r2"), (1, 4, "a", "r1"), (3, 1, "p", None), (9, 0, "a", "stray")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("search", "query", "string", True), ("search", "limit", "integer", False)], "name string, arg string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert len(got) == 8
    a, b = got[1, "a"], got[1, "b"]
    assert b["position"] < a["position"] and a["status"] == "linked" and a["n_results"] == 2
    assert json.loads(a["record"]) == {"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search", "result": "r1"}
    assert (b["status"], b["errors"]) == ("invalid", "type:query") and got[1, "c"]["errors"] == "tool"
    assert got[2, "x"]["status"] == "cycle" and got[2, "y"]["status"] == "cycle"
    p = got[3, "p"]
    assert p["errors"] == "unknown:a,unknown:b" and '"a":{"c":2,"d":1},"b":1' in p["record"]
    assert got[4, None]["status"] == "no_id" and got[None, "n"]["status"] == "no_id"
    assert [r["conv_id"] for r in tool_calls.orphans(calls, results).collect()] == [9]


def test_tool_calls_edges(spark):
    calls = "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>, level string, _mixed string"
    results = "conv_id long, turn long, call_id string, content string, name string"
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "name string, arg string, type string, required boolean")
    none = tool_calls.report(spark.createDataFrame([], calls), spark.createDataFrame([], results), schemas)
    assert none.isEmpty()
    # a chain backwards through more turns than a block, and a very long argument
    long_ = json.dumps({"query": "é\"\\" * 300_000})
    rows = [(1, t, "k%d" % t, "search", long_ if t == 5 else '{"query": ""}', ["k%d" % (t + 1)] if t < 9 else None, "x", "y") for t in range(10)]
    rows += [(2, t, "k%05d" % t, "search", "null", [], "x", "y") for t in range(9000)]
    got = tool_calls.report(spark.createDataFrame(rows, calls), spark.createDataFrame([(1, 20, "k5", "r", "n"), (3, 0, None, "r", "n")], results), schemas).collect()
    assert {r["call_id"]: r["position"] for r in got if r["conv_id"] == 1} == {"k%d" % t: 10 - t for t in range(10)}
    assert [r["position"] for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["call_id"])] == list(range(1, 9001))
    assert {r["errors"] for r in got if r["conv_id"] == 2} == {"json"}
    assert json.loads(next(r["record"] for r in got if r["call_id"] == "k5"))["arguments"] == json.loads(long_)
    assert [(r["call_id"], r["status"]) for r in got if r["conv_id"] == 3] == [(None, "orphan")]


def test_tool_call_query_meets_every_status(spark):
    calls, results = tool_calls.calls_from_conversations(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "name string, arg string, type string, required boolean")
    got = {r["status"] for r in tool_calls.report(calls, results, schemas).select("status").distinct().collect()}
    assert got == {"linked", "invalid", "unanswered", "cycle", "no_id", "orphan"}
    first = tool_calls.first_calls(calls)
    assert tool_calls.levels(first).agg(F.max("level")).first()[0] >= 3 and not tool_calls.out_of_order(first).isEmpty()


# -- 7 and 8 -----------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_edges(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(300)]
    texts, labels = {}, []
    for i in range(700):
        bad = i % 5 == 1
        w = [rng.choice(vocab) for _ in range(60)]
        if bad:
            w[rng.randrange(60)] = "vile" + rng.choice(vocab)
        texts[i] = " ".join(w)
        labels.append((i, int(bad)))
    lab = spark.createDataFrame([*labels, (3, None), (4, 0)], "doc_id long, toxic int")
    m = toxicity.train(docs(spark, texts), lab)
    got = {r["doc_id"]: r for r in toxicity.digest(listed(spark, [*texts.items(), (900, None), (901, ""), (902, "x " * 50_000)]), m).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in texts)
    assert np.mean([got[i]["predicted"] == y for i, y in labels if i in set(held)]) > 0.95
    assert got[900]["score"] == got[901]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    # a plain forward pass, position by position
    rows = {r["doc_id"]: r for r in toxicity.ids(docs(spark, texts), "doc_id").filter("doc_id < 20").collect()}
    for i, r in rows.items():
        vec = [m.emb[a] + m.emb[b] for a, b in zip(r["_word"], r["_prefix"])] + [m.emb[toxicity.PAD]] * 3
        z, col = m.out_bias, 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(m.filters):
                at = [sum(vec[t + o] @ m.conv[:, col + o * m.filters + f] for o in range(width) if t + o < len(vec)) for t in range(len(vec))]
                z += max(max(at) + m.bias[k * m.filters + f], 0) * m.out[k * m.filters + f]
            col += width * m.filters
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    plain = spark.createDataFrame([(i, "some text %d" % i, 1, 2) for i in range(50)], "doc_id long, text string, _y int, _id int")
    m = toxicity.train(plain, lab)  # one class, no lang, clashing names
    got = toxicity.digest(plain, m).collect()
    assert len(got) == 50 and len({r["score"] for r in got}) == 1 and got[0]["score"] > 0.9 and m.thresholds == {}
    none = toxicity.train(plain.limit(0), lab.limit(0))
    assert toxicity.digest(plain.limit(0), none).isEmpty() and toxicity.digest(plain, none).first()["score"] == pytest.approx(0.5)
    assert toxicity.calibrate(np.array([0.9, 0.9, 0.2, 0.1]), np.array([1, 1, 0, 0]), ["en"] * 4)["en"] == pytest.approx(0.55)
    ties = toxicity.calibrate(np.array([0.7, 0.7, 0.7, 0.1]), np.array([1, 0, 1, 0]), ["en", "en", "en", "en"])["en"]
    assert ties == pytest.approx(0.4)  # equal scores fall on one side


def test_line_features_and_marginals():
    feats, size, begin = quality.line_features(["a b\n\na b", None, "", "xx xx xx"])
    assert begin.tolist() == [0, 3, 4, 5] and size.tolist() == [3, 0, 3, 0, 0, 8]
    assert feats[0, -2] == 1 and feats[1, -1] == 1 and feats[5, -4] == pytest.approx(2 / 3)
    rng = np.random.default_rng(1)
    u, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    begin = np.array([0, 3])
    p, pairs = quality.marginals(u, begin, moves, True)
    want, both = np.zeros(5), np.zeros((2, 2))
    for lo, hi in ((0, 3), (3, 5)):
        n = hi - lo
        paths = np.array([[(k >> j) & 1 for j in range(n)] for k in range(2**n)])
        s = np.exp((paths * u[lo:hi]).sum(1) + np.array([sum(moves[x[j], x[j + 1]] for j in range(n - 1)) for x in paths]))
        s /= s.sum()
        want[lo:hi] = s @ paths
        for w, x in zip(s, paths, strict=True):
            for j in range(n - 1):
                both[x[j], x[j + 1]] += w
    np.testing.assert_allclose(p, want)
    np.testing.assert_allclose(pairs, both)


def quality_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, labels = {}, []
    for i in range(400):
        bad = i % 4 == 1
        lines = [" ".join(word() for _ in range(8)) for _ in range(rng.randrange(1, 6))]
        if bad:
            lines = ["The start is fine."] + [" | ".join(x.split(" ")) for x in lines]
        texts[i] = "\n".join(lines)
        labels.append((i, int(not bad)))
    return texts, labels


def test_quality_learns_and_scores_edges(spark):
    texts, labels = quality_rows()
    m = quality.train(docs(spark, texts).withColumn("_y", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = [*texts.items(), (900, None), (901, ""), (902, "x " * 50_000), (None, texts[0]), (0, texts[0]), (0, texts[0])]
    all_rows = quality.digest(listed(spark, rows), m).collect()
    assert len(all_rows) == len(rows) and len({r["score"] for r in all_rows if r["doc_id"] in (0, None)}) == 1
    got = {r["doc_id"]: r for r in all_rows}
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(got[i]["held_out"] == (i in held) for i in texts)
    assert np.mean([got[i]["predicted"] == y for i, y in labels if i in held]) > 0.95
    assert got[900]["score"] == got[901]["score"] == 0 and 0 <= got[902]["score"] <= 1
    assert quality.digest(docs(spark, []), m).isEmpty()
    none = quality.train(docs(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs(spark, {1: "x"}), none).first()["score"] == 0.5


def test_lines_are_labelled_apart(spark):
    texts, labels = quality_rows()
    m = quality.fit([texts[i] for i, _ in labels], np.array([y for _, y in labels], float))
    assert m.moves[0, 1] != 0 and m.moves[1, 0] != 0
    mixed = {1: texts[0] + "\n" + texts[1], 2: None, 3: "", 4: texts[1]}
    got = sorted(tuple(r) for r in quality.label_lines(docs(spark, mixed), m).collect())
    assert [r[:2] for r in got] == [(i, n) for i, t in mixed.items() for n in range((t or "").count("\n") + 1)]
    # the same by trying every labelling of the lines of a text
    x, size, begin = quality.line_features([mixed[4]])
    u = quality.with_neighbours(x, begin) @ m.weights
    n = len(u)
    paths = np.array([[(k >> j) & 1 for j in range(n)] for k in range(2**n)])
    w = np.exp((paths * u).sum(1) + np.array([sum(m.moves[p[j], p[j + 1]] for j in range(n - 1)) for p in paths]))
    p = (w / w.sum()) @ paths
    np.testing.assert_allclose([r[3] for r in got if r[0] == 4], p, atol=1e-9)
    share = (p * size).sum() / size.sum()
    want = 1 / (1 + np.exp(-(m.slope * np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))) + m.shift)))
    assert quality.score(docs(spark, mixed), m).filter("doc_id = 4").first()["score"] == pytest.approx(want)


# -- 9 -----------------------------------------------------------------------------------------------


def want_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(ASCII_LOWER)
    fit = [(len(h + p), h + p, v) for v, h, p in url_rules.PREFIX_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    own = [v for v, p, _ in url_rules.PATTERN_RULES if re.search(p.replace(r"\z", r"\Z"), host + path)] if host else []
    return (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else own[0] if own else "allow")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    urls = [
        None, "", "no scheme", "http://EXAMPLE.com/en/77?x=http://a.com/en/", "http://a.com/en/x", "http://acom/en/x", "https://example.net/de/81", "https://b.example.net/de/9", "http://x.org/es/", "http://x.org/es",
        "http://spam-farm.example.org/en/1", "http://h?u=://y/en/", "://com/en/", "http://www.a.com/file.zip", "http://a.com#/en/", "http://a.b/login/x", "http://a.b/signup/", "http://a.b/signups/", "http://a.b/x.exe?q",
        "http://a.b/x.exe/", "http://a.b/c.ISO", "http://a.b/c.iso", "http://a.b/" + "long-path/" * 20_000 + "c.zip", "http:///", "http://a.b/login/x", None, "http://www.adult-x.net/de/login/",
    ]
    pages = spark.createDataFrame([(i, u, "<html>", "host", "p", "t") for i, u in enumerate(urls)] + [(None, urls[3], "", "", "", ""), (4, urls[4], "", "", "", "")], "page_id long, url string, html string, host string, path string, token string")
    got = url_rules.digest(url_rules.judge(pages, url_rules.rules_table(spark))).collect()
    want = [(i, *want_url(u)) for i, u in enumerate(urls)] + [(None, *want_url(urls[3])), (4, *want_url(urls[4]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    tried = url_rules.judge(pages, url_rules.rules_table(spark)).agg(F.max("n_tried")).first()[0]
    assert tried < url_rules.rules_table(spark).count()


def test_url_rules_all_have_a_token(spark):
    pages = spark.createDataFrame([(1, "http://a.b/login/x"), (2, "http://c.d/e")], "page_id long, url string")
    urls = pages.select(url_rules.host(F.col("url")).alias("host"), url_rules.path(F.col("url")).alias("path"))
    index = url_rules.rule_index(urls, url_rules.rules_table(spark))
    assert index.filter("token IS NULL").isEmpty()
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, url_rules.rules_table(spark)).isEmpty()
    free = url_rules.rules_table(spark, patterns=[("block", "e", [])])  # a rule of one's own without a literal
    got = {r["page_id"]: (r["verdict"], r["n_tried"]) for r in url_rules.judge(pages, free).collect()}
    assert got == {1: ("allow", 1), 2: ("block", 1)}


# -- 10 ----------------------------------------------------------------------------------------------


def test_gear_hash_equals_the_recurrence():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(media.GEARS[b])) % 2**32
        want.append(h)
    assert media.gear_hash(data).tolist() == want


def brute_media(t):
    """Payload, chunk list and features by the plain definitions."""
    raw = (t or "").encode()
    p = raw + bytes((-len(raw)) % 64 if raw else 64)
    h, cuts, last = 0, [], 0
    for i, b in enumerate(p):
        h = (2 * h + int(media.GEARS[b])) % 2**32
        size = i + 1 - last
        if len(p) - last > media.MIN_CHUNK and (size >= media.MIN_CHUNK and h >> (32 - media.MEAN_BITS) == 0 or size == media.MAX_CHUNK):
            cuts.append(i + 1)
            last = i + 1
    cuts += [len(p)] if last < len(p) else []
    form = b"".join(hashlib.blake2b(p[a:b], digest_size=16).digest() + (b - a).to_bytes(4, "little") for a, b in zip([0, *cuts], cuts))
    mean = sum(p) / len(p)
    std = (sum((b - mean) ** 2 for b in p) / len(p)) ** 0.5
    feature = f"mean={mean:.4f};std={std:.4f};zero={p.count(0) / len(p):.4f}"
    return (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature)


@pytest.mark.parametrize("share", [1_024, 4])
def test_media(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(media, "HOT_SHARE", share)
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    pairs = [*enumerate(EDGES), (20, body), (21, body), (22, "front " + body), (22, "other text of the same id"), (20, body), (None, body), (None, None), (23, body[:30_000] + "x" + body[30_000:])]
    df = listed(spark, pairs).withColumn("payload", F.lit(1)).withColumn("hot", F.lit(1))
    media.write(df, str(tmp_path / "s"))
    got = media.digest(spark, str(tmp_path / "s")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute_media(t)) for i, t in pairs), key=str)
    rows = spark.read.parquet(str(tmp_path / "s/recipes"))
    assert rows.count() == len({t or "" for _, t in pairs})
    moved = rows.agg(F.sum(F.size("refs")), F.sum(F.length("manifest") / 20)).first()
    assert moved[0] > 0.4 * moved[1]  # most chunks of the near copies are stored once


def test_damaged_chunk_raises(spark, tmp_path):
    import zstandard

    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    row = {"payload": b"p", "manifest": media.manifest(media.chunks(data)), "data": zstandard.compress(data), "shared": [], "_fetched": None}
    assert media.rebuild(row, zstandard.ZstdDecompressor()) == data
    row["data"] = zstandard.compress(data[:2500] + b"?" + data[2501:])
    with pytest.raises(ValueError, match="damaged"):
        media.rebuild(row, zstandard.ZstdDecompressor())


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet")
    df = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, d)
        assert df.columns == source.columns and df.dtypes == source.dtypes
        df = corpus_pipeline.materialise(df, "stage")
    assert 0 < df.count() < source.count()




def brute_pipeline(spark, rows, items, m):
    """All stages over a list of (doc_id, text): id, tokens and digest of the text of each row that is left."""
    rows = [r for r in rows if quality.predict(m, [r[1]])[0] >= 0.7]
    classes = brute(dict(enumerate(t if i is not None else None for i, t in rows)))
    least = {}
    for n, (root, _) in classes.items():
        least[root] = min(least.get(root, (rows[n][0] or 0, n)), (rows[n][0] or 0, n))
    rows = [r for n, r in enumerate(rows) if r[0] is None or least[classes[n][0]][1] == n]
    hits = brute_hits({n: t for n, (_, t) in enumerate(rows)}, items)
    rows = [r for n, r in enumerate(rows) if hits[n][1] == 0]
    model = secrets.train(secrets.labelled_samples(listed(spark, rows)))
    out, tok = [], tree_bpe.load_tokenizer(PATH)
    for i, t in rows:
        if t is None:
            out.append((i, 0, hashlib.sha256(b"").hexdigest()))
            continue
        for lo, _, _, hi in reversed(all_spans(t, model)):
            t = t[:lo] + "[SECRET]" + t[hi:]
        ids = tok.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    words = lambda n=80: [rng.choice(vocab) for _ in range(n)]
    lines = lambda w: "\n".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8))
    items = {1: " ".join(words(12)), 2: " ".join(words(12))}
    leak = lambda k: lines(words(40) + items[k].split(" ") + words(28))
    base = words()
    near = [*base[:40], "other", *base[41:]]
    rows = [(i, lines(words())) for i in range(60)] + [(i, "\n".join(" | ".join(words(8)) for _ in range(5))) for i in range(60, 80)]
    rows += [(None, lines(words())), (None, lines(words())), (None, leak(1)), (None, None), (None, lines(near))]
    rows += [(200, lines(words())), (200, leak(2)), (201, leak(1)), (202, lines([*words(40), "password:", "hunter2222", *words(38)]))]
    rows += [(100, lines(base)), (100, lines(base)), (101, lines(near)), rows[0]]
    d = str(tmp_path)
    working = ["_quality", "quality", "_base", "_spans", "base", "spans", "_bad", "_text", "bad", "d", "t", "_d", "_t", "_tag", "salt", "hot"]
    source = listed(spark, rows).select("doc_id", "text", "lang").withColumns({c: F.lit("own " + c) for c in working})
    source.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    m = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    want = brute_pipeline(spark, rows, items, m)
    staged = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, d)
        assert staged.columns == source.columns and staged.filter(" OR ".join(f"{c} <> 'own {c}'" for c in working)).isEmpty()
    got = [(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, d).collect()]
    assert sorted(got, key=str) == want
    assert [i for i, *_ in want].count(None) == 3 and [i for i, *_ in want].count(200) == 1 and 60 <= len(want) < 80
