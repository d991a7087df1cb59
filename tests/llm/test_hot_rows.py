"""Rows without an id or turn, repeated rows and rows of one id: nothing is lost, and no task gets them all."""

import base64
import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import components, decontaminate, labelled, ngram_join, quality, secrets, token_store, tool_calls, toxicity, tree_bpe, url_rules
from gridloom.llm.common import materialise
from gridloom.llm.queries import WORD_BPE


def test_calls_without_a_turn_stay(spark):
    calls = spark.createDataFrame(
        [(1, None, "a", "search", '{"query": "x"}', []), (1, 3, "b", "search", '{"query": "y"}', ["a"]), (1, None, "c", "search", "{}", []), (2, None, "z", "none", None, None)],
        "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>",
    )
    results = spark.createDataFrame([(1, None, "a", "r", "found")], "conv_id long, turn long, call_id string, role string, content string")
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "name string, arg string, type string, required boolean")
    got = sorted((r["conv_id"], r["call_id"], r["position"]) for r in tool_calls.link(calls, results, schemas).collect())
    assert got == [(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "z", 1)]


def test_a_repeated_label_counts_once(spark):
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.range(2, 100).select(F.col("id").alias("doc_id"), F.lit("other").alias("text"), F.lit(None).cast("string").alias("lang")))
    labels = spark.range(1, 100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = labelled.sample(docs, labels.unionAll(labels), "toxic", F.lit(False), 40).collect()
    assert len(got) == 40 == len({r["doc_id"] for r in got})
    assert len(labelled.sample(docs, labels, "toxic", F.lit(False), 1000).filter("doc_id = 1").collect()) == 1
    assert labelled.sample(docs.limit(0), labels, "toxic", F.lit(False), 40).count() == 0


def test_documents_without_an_id_lie_in_many_shards(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" word")).alias("text"))
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_store.write(rows.repartition(8), path, WORD_BPE, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(path).filter("kind = 'doc'").groupBy("shard").count().collect()
    assert len(shards) == 4 and max(r["count"] for r in shards) < 1600
    got = token_store.read_digests(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 1334 + sorted(i for i in range(4000) if i % 3)


def test_copies_of_one_row_give_a_window_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 25))), (2, "w30 w31")], "item_id long, text string")
    docs = spark.createDataFrame([(None, text)] * 300 + [(7, text), (7, text), (8, "clean words")], "doc_id long, text string")
    hits = decontaminate.window_hits(docs, bench)
    assert hits.count() == 2 * 12
    got = decontaminate.decontaminate(docs, bench).groupBy("n_hit", "contaminated").count().collect()
    assert sorted((r["n_hit"], r["count"]) for r in got) == [(0, 1), (22, 302)]


def test_many_items_of_one_window_arent_broadcast(spark, monkeypatch):
    bench = spark.range(500).select(F.col("id").alias("item_id"), F.lit("a b c d e f g h i j").alias("text"))
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "a b")], "doc_id long, text string")
    want = decontaminate.decontaminate(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 100)
    assert sorted(decontaminate.decontaminate(docs, bench).collect()) == sorted(want) and len(sorted(want)[0]["items"]) == 500


def test_long_texts_made_of_items_dont_fill_the_memory(spark):
    items = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(200)}
    long_ = " zz ".join([*items.values()] * 3)
    bench = spark.createDataFrame([*items.items(), (200, "Very Short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, long_.upper()), (2, long_ + " very short Item"), (3, "zz very short")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (24_599, 24_000, 200), 2: (24_602, 24_003, 201), 3: (3, 0, 0)}


def test_the_pipeline_drops_long_texts_made_of_items(spark, tmp_path):
    import corpus_pipeline

    items = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(200)}
    spark.createDataFrame([*items.items()], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, " zz ".join([*items.values()] * 3)), (2, "zz w1x1 w1x2"), (None, "zz")], "doc_id long, text string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {2, None}


def test_copies_of_one_long_text_lie_in_many_tasks(spark):
    long_ = " ".join(f"word{i}" for i in range(300))
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 > 0, F.lit(long_)).otherwise(F.concat(F.lit(long_ + " "), F.col("id").cast("string"))).alias("text"),
    )
    # as it is where the texts' results are too large to be broadcast
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = tree_bpe.digest(rows, WORD_BPE, 200).withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tok = tree_bpe.load_tokenizer(WORD_BPE)
    n = {t: len(tok.encode(t, add_special_tokens=False).ids) for t in (long_, f"{long_} 0")}
    assert len(got) == 2000 and sum(r["n_tokens"] == n[long_] for r in got) == 1500
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == list(range(0, 2000, 3))
    tasks = [sum(r["task"] == t for r in got if r["n_tokens"] == n[long_]) for t in {r["task"] for r in got}]
    assert max(tasks) < 800
    assert tree_bpe.encode(rows, WORD_BPE, 200, tree_bpe.decoded).filter(F.col("decoded").isNull()).count() == 0


def test_pages_of_one_url_and_none(spark, monkeypatch):
    urls = ["http://a.b/login/x", "http://spam-farm.c/x", "http://a.com/en/1", "none", None]
    pages = spark.createDataFrame([(i, urls[min(i % 9, 4)]) for i in range(900)], "page_id long, url string")
    want = {0: (None, "block"), 1: (None, "block"), 2: ("com/en/", "block"), 3: (None, "allow"), 4: (None, "allow")}
    for share in (url_rules.HOT_SHARE, 1):  # all urls hot, none
        monkeypatch.setattr(url_rules, "HOT_SHARE", share)
        got = url_rules.judge(pages, url_rules.rules_table(spark)).select("page_id", "rule", "verdict").collect()
        assert sorted(map(tuple, got)) == [(i, *want[min(i % 9, 4)]) for i in range(900)]
    assert url_rules.judge(pages.limit(0), url_rules.rules_table(spark)).count() == 0


def test_many_rows_without_an_id_stay_unshuffled(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text)] * 300 + [(i, text.replace("w7 ", f"x{i % 3} ")) for i in range(90)] + [(500, "other words in a text of its own"), (500, "other words in a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 4)
    got = [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([None] * 300 + [0, 500], key=str)
    links = {r["doc_id"]: r["n_links"] for r in ngram_join.near_copies(docs).collect()}
    assert links[0] == 89 and links[None] == 0 and links[500] == 1


def test_text_of_many_spans(spark):
    n = 3000
    parts = [f"é{i % 7} AKIA{'A' * 16}{i:05d}" for i in range(n)]
    text = " ".join(parts)
    spans, at = [], 0
    for p in parts:
        start = at + p.index("AKIA")
        spans.append((start, at + len(p), "access", p[p.index("AKIA") :]))
        if len(spans) % 5 == 0:
            spans.append((start + 2, at + len(p) + 1, "random", "x"))  # overlaps the one before
        at += len(p) + 1
    df = spark.createDataFrame([(text, spans), ("plain", []), ("", [])], "text string, spans array<struct<start:int,end:int,kind:string,value:string>>")
    got = [r[0] for r in df.select(secrets.redact(F.col("text"), F.col("spans"))).collect()]

    def plain(text, spans):
        out, at = [], 0
        for start, end, *_ in spans:
            if start >= at:
                out.append(text[at:start] + "[SECRET]")
            at = max(at, end)
        return "".join(out) + text[at:]

    assert got == [plain(text, spans), "plain", ""]
    blank = [r[0] for r in df.select(secrets.redact(F.col("text"), F.col("spans"), None)).collect()]
    assert len(blank[0]) == len(text) and "AKIA" not in blank[0] and pa.scalar(blank[1]).as_py() == "plain"


def test_secret_models_count_every_text(spark):
    """Sums of words and joints against runs of three written out, over more texts than any sample held."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abXY") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([0, 1, 2, 3, 9]))) + " %d." % i for i in range(6000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts[:500], None]], "text string")
    samples = secrets.labelled_samples(rows)
    held = {r[0] for r in rows.select(F.coalesce("text", F.lit("")).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(secrets.HELD_OUT)) == 0).collect()}
    moves, first, whole = Counter(), Counter(), Counter()
    for t in {*texts, ""}:
        words, d = re.findall("[A-Za-z]{2,}", t), hashlib.sha256(t.encode())
        b64 = base64.b64encode(d.digest()).decode()
        runs = [sep.join(words[i : i + 3]) for i in range(len(words) - 2) for sep in ("_", "-", "/", "")]
        if t in held:
            whole.update(words + runs)
            continue
        for label, tokens in ((1, [d.hexdigest(), b64, re.sub("[+/=]", "", b64), d.hexdigest()[:20].upper()]), (0, words + runs)):
            for w in tokens:
                first[label, w[0]] += 1
                moves.update((label, w[i : i + 2]) for i in range(len(w) - 1))
    got_moves, got_first = Counter(), Counter()
    for r in samples.filter("not held").collect():
        got_first[r["label"], r["token"][0]] += r["n_first"]
        for i in range(len(r["token"]) - 1):
            got_moves[r["label"], r["token"][i : i + 2]] += r["n"]
    assert len(held) > 1000 and got_moves == moves and +got_first == first
    passages = [r["token"].split() for r in samples.filter("held and label = 0").collect()]
    assert Counter(w for p in passages for w in [*p, *(sep.join(p[i : i + 3]) for i in range(len(p) - 2) for sep in secrets.JOINS)]) == whole


def test_ratios_of_runs_are_those_of_their_tokens(spark):
    rng = random.Random(8)
    m = secrets.Model([rng.uniform(-3, 3) for _ in secrets.ALPHABET], [rng.uniform(-3, 3) for _ in range(len(secrets.ALPHABET) ** 2)])
    passages = ["", "a", "one two", "Internationalisation", "aaaa aaaa aaaa aaaaaaaa", "é! some thing é wide again", " ".join("".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randint(2, 9))) for _ in range(80))]
    rows = spark.createDataFrame([(i, p, 1) for i, p in enumerate(passages)], "i int, token string, n long")
    got = {i: [] for i in range(len(passages))}
    for r in secrets.ordinary_ratios(rows, m, "i").orderBy("r").collect():
        got[r["i"]].append(r["r"])
    whole = [(i, t) for i, p in enumerate(passages) for w in [p.split(" ")] for t in [*w, *(sep.join(w[j : j + 3]) for j in range(len(w) - 2) for sep in secrets.JOINS)]]
    tokens = spark.createDataFrame(whole, "i int, token string").filter(F.col("token").rlike(f"^{secrets.TOKEN}$") & secrets.varied(F.col("token")))
    want = {i: [] for i in range(len(passages))}
    for r in tokens.select("i", secrets.log_ratio(F.col("token"), m).alias("r")).collect():
        want[r["i"]].append(round(r["r"], 3))
    assert len(want[6]) > 200 and {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items()}
    assert all(abs(a - b) < 0.002 for i in want for a, b in zip(got[i], sorted(want[i]), strict=True))


def test_secret_threshold_lets_no_more_than_the_share_through(spark):
    ordinary = [("".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(16)), 0, 1, 1, i % 2 == 0) for i in range(400)]
    odd = [("qrstuvwxyzQRSTUVWXYZ" + str(i), 0, 30, 30, True) for i in range(2)]
    random_ = [("qrstuvwxyzQRSTUVWXYZ%d" % (i % 10), 1, 50, 50, False) for i in range(50)]
    samples = spark.createDataFrame([*ordinary, *odd, *random_], "token string, label int, n long, n_first long, held boolean")
    m = secrets.train(samples)
    reached = samples.filter(F.col("held") & (secrets.log_ratio(F.col("token"), m) >= m.threshold)).count()
    assert m.threshold > secrets.RATIO_LEAST and reached == 0


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """A text longer than any sample held, repeated ids, and shards that are averaged."""
    docs = spark.range(6600).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") == 3, F.repeat(F.lit("word "), 20_000)).otherwise(F.concat(F.lit("some plain words "), F.when(F.col("id") % 4 == 0, "vile ").otherwise("mild "), "id")).alias("text"),
        F.lit("en").alias("lang"),
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    out = labelled.remainder(F.col("doc_id"), 5) == 0
    rows = toxicity.labelled_ids(docs.unionAll(docs), labels.unionAll(labels), out)
    assert rows.count() == labels.filter(~out).count() > 5000
    assert rows.select(F.max(F.size("_word"))).first()[0] == 20_000
    met = []
    average = toxicity.averaged
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 2000)
    monkeypatch.setattr(toxicity, "averaged", lambda fit, m, shards, *a: met.append((fit.count(), shards)) or average(fit, m, shards, *a))
    m = toxicity.train(docs, labels)
    assert met[0][1] == 3 and met[0][0] > 4000 and set(m.thresholds) == {"en"}
    got = toxicity.digest(docs, m).join(labels, "doc_id")
    assert got.filter("held_out AND predicted != toxic").count() <= 1


def test_peaks_in_blocks_are_those_of_whole_texts():
    rng = np.random.default_rng(3)
    m = toxicity.start(10, 5, rng.integers(0, 5, (2, 2 * toxicity.BUCKETS + 1)).astype(float))
    texts = [rng.integers(0, toxicity.BUCKETS, n).astype(np.int32) for n in (0, 1, 5, 40, 300)]
    w, starts = toxicity._padded(texts)
    p, _ = toxicity._padded([t + toxicity.BUCKETS for t in texts])
    whole, at = toxicity.peaks(m, w, p, starts)
    for limit in (1, 7, 64):
        v, i = toxicity.peaks(m, w, p, starts, limit)
        assert np.allclose(v, whole, atol=1e-6) and (i == at).mean() > 0.99


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    texts = [f"Line {i} of good prose, with words.\nAnd more of it." if i % 2 else f"$$$ {i} ###\n|||" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.train(docs, labels)
    used = labelled.sample(docs, labels, "quality", labelled.remainder(F.col("doc_id"), 4) == 2, 100).orderBy("doc_id").collect()
    want = quality.fit([r["text"] for r in used], np.array([r["_y"] for r in used], float))
    assert np.allclose(got.weights, want.weights) and np.allclose(got.moves, want.moves) and np.allclose([got.slope, got.shift], [want.slope, want.shift])
    model = quality.Model

    def where(texts, y):
        return model(np.array([os.getpid(), len(texts)], float), np.zeros((2, 2)), 0.0, 0.0)

    monkeypatch.setattr(quality, "fit", where)
    pid, n = quality.train(docs, labels).weights
    assert pid != os.getpid() and n == len(used)


def test_components_stop_at_stars(spark, monkeypatch):
    written = []

    def noted(df, name):
        written.append(name)
        return materialise(df, name)

    monkeypatch.setattr(components, "materialise", noted)
    stars = spark.createDataFrame([(10 * i + j, 10 * i) for i in range(20) for j in range(1, 9)] + [(7, 7)], "u long, v long")
    got = {r["v"]: r["root"] for r in components.components(stars).collect()}
    assert got == {10 * i + j: 10 * i for i in range(20) for j in range(9)} and written == ["edges"]
    written.clear()
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "u long, v long")
    got = {r["v"]: r["root"] for r in components.components(path).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)
    assert components.components(path.limit(0)).count() == 0
