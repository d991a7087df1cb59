"""Benchmark decontamination by winnowing, on DataFrame functions alone.

Each text becomes an array of word hashes. Of every ``window`` consecutive words the smallest
hash of ``gram`` consecutive words is kept (rightmost on ties), so that two texts that share
``window`` words in a row keep at least one hash in common. Kept hashes of documents and of
benchmark items are joined; each hit is extended to the word windows that cover it, which are
compared word by word with the items' windows, and neighbouring windows merge into spans.

Cases: null or empty text has no words and no hits; repeated rows each get a result row; an item
shorter than ``window`` counts as one window of its own length; an item with a null id marks words
but isn't listed; an empty benchmark leaves every document clean. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import EMPTY_SHA256, ascii_lower, raw_words, same_keys, word_hashes

#: Benchmark windows that are still sent to every executor; larger benchmarks are shuffled.
BROADCAST_WINDOWS = 200_000
#: Bytes of windows and item ids that are still sent to every executor.
BROADCAST_BYTES = 32_000_000


def _hashed(df: DataFrame, keys: dict[str, Column], text: str) -> DataFrame:
    words = df.select(
        *[c.alias(k) for k, c in keys.items()], F.col(text).alias("_x"), raw_words(F.col(text)).alias("_w")
    )
    return words.select(*keys, "_w", word_hashes(F.col("_x"), F.col("_w")).alias("_h"))


def _gram(at: Column, gram: int) -> Column:
    return F.xxhash64(*[F.get("_h", at + i) for i in range(gram)])


def _kept(at: Column, n: int) -> Column:
    """The smallest of n hashes from a position on; its low four bits say where it stands."""
    ranked = [F.get("_g", at + i).bitwiseOR(F.lit(n - 1 - i)) for i in range(n)]
    return F.least(*ranked) if n > 1 else ranked[0]


def fingerprints(hashed: DataFrame, keys: list[str], window: int, gram: int) -> DataFrame:
    """One row for each kept hash: keys, words and hashes, ``_at`` (first word), ``_fp``.

    Everything from the split to the filter runs in one pass over a text, without a shuffle. The
    array of gram hashes is built first, which keeps the code generated after it small enough for
    the JVM to compile.
    """
    n = window - gram + 1
    assert n <= 16, "four bits hold the position"
    grams = F.transform(
        F.slice("_h", 1, F.greatest(F.size("_h") - (gram - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, gram)]).bitwiseAND(F.lit(~15)),
    )
    held = hashed.select(*keys, "_w", grams.alias("_g"))
    starts = F.when(F.size("_g") >= n, F.sequence(F.lit(0), F.size("_g") - n)).otherwise(
        F.array().cast("array<int>")
    )
    at = held.select("*", F.explode(starts).alias("_pos"))
    pos = F.col("_pos")
    best = at.select("*", _kept(pos, n).alias("_m"), _kept(pos - 1, n).alias("_p"))
    where = lambda m, start: start + (n - 1) - F.col(m).bitwiseAND(F.lit(15)).cast("int")
    new = (pos == 0) | (where("_m", pos) != where("_p", pos - 1))
    return best.filter(new).select(
        *keys, "_w", where("_m", pos).alias("_at"), F.col("_m").bitwiseAND(F.lit(~15)).alias("_fp")
    )


def _whole(hashed: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Every run of ``length`` words, for items shorter than the window."""
    starts = F.when(F.size("_h") >= length, F.sequence(F.lit(0), F.size("_h") - length)).otherwise(
        F.array().cast("array<int>")
    )
    at = hashed.select("*", F.explode(starts).alias("_at"))
    return at.select(*keys, "_w", "_at", F.xxhash64(F.lit(length), _gram(F.col("_at"), length)).alias("_fp"))


def _text_of(at: Column, length: Column) -> Column:
    """The window's words as they are compared. Joined before they are lower-cased: without a higher-order
    function Spark fuses this with the explode below it, so that the words of a whole text are never
    copied once for each window."""
    return ascii_lower(F.array_join(F.slice("_w", at + 1, length), " "))


def window_hits(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Windows of documents that are windows of items: doc_id, _tag (hash of the text), start and
    length in words, items (array of item ids as strings). Repeated rows of one id and text give a window once."""
    items = _hashed(bench, {"_item": F.col("item_id").cast("string")}, "text")
    size = F.size("_w")
    starts = F.when(size >= window, F.sequence(F.lit(0), size - window)).otherwise(
        F.when(size > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    )
    wins = items.select("_item", "_w", F.explode(starts).alias("_at")).select(
        "_item", F.least(size, F.lit(window)).alias("_len"),
        _text_of(F.col("_at"), F.least(size, F.lit(window))).alias("_win"),
    )
    by_win = wins.groupBy("_win", "_len").agg(F.collect_set("_item").alias("items"))
    size_of = F.octet_length("_win") + F.octet_length(F.array_join("items", ","))
    shape = by_win.groupBy("_len").agg(F.count("*").alias("n"), F.sum(size_of).alias("bytes")).collect()
    short = sorted(r["_len"] for r in shape if r["_len"] < window)  # nine values at most
    small = sum(r["n"] for r in shape) <= BROADCAST_WINDOWS and sum(r["bytes"] for r in shape) <= BROADCAST_BYTES
    put = F.broadcast if small else (lambda df: df)

    keys = ["doc_id", "_tag"]
    text = _hashed(docs, {"doc_id": F.col("doc_id"), "_tag": F.xxhash64("text")}, "text")

    def kept(hashed: DataFrame, cols: list[str]) -> list[DataFrame]:
        parts = [fingerprints(hashed, cols, window, gram).select("*", F.lit(window).alias("_len"))]
        return parts + [_whole(hashed, cols, n).select("*", F.lit(n).alias("_len")) for n in short]

    def tried(found: DataFrame) -> DataFrame:
        """Texts of the windows that cover hits."""
        last = F.size("_w") - F.col("_len")
        reach = F.when(F.col("_len") == window, F.lit(window - gram)).otherwise(F.lit(0))
        cover = F.sequence(F.greatest(F.col("_at") - reach, F.lit(0)), F.least(F.col("_at"), last))
        each = found.select(*keys, "_w", "_len", F.explode(cover).alias("start"))
        return each.select(*keys, "start", "_len", _text_of(F.col("start"), F.col("_len")).alias("_win"))

    of_items = reduce(
        DataFrame.unionAll,
        [kept(items.filter(F.size("_h") >= window), ["_item"])[0]]
        + [_whole(items.filter(F.size("_h") == n), ["_item"], n).select("*", F.lit(n).alias("_len")) for n in short],
    ).select("_fp").distinct()
    own = kept(text, keys)
    if small:  # each part by itself, as the words would be copied for every hash that goes through a union
        windows = reduce(DataFrame.unionAll, [tried(part.join(F.broadcast(of_items), "_fp", "left_semi")) for part in own])
    else:  # the words stay behind and are fetched again for the texts that were hit
        hit = reduce(DataFrame.unionAll, [part.select(*keys, "_at", "_len", "_fp") for part in own]).join(of_items, "_fp", "left_semi")
        per = hit.groupBy(*keys).agg(F.collect_set(F.struct("_at", "_len")).alias("_hits"))
        per = per.select(F.col("doc_id").alias("_d"), F.col("_tag").alias("_t"), "_hits")
        windows = tried(text.join(per, same_keys(keys, ["_d", "_t"])).select(*keys, "_w", F.inline("_hits")))
    met = windows.join(put(by_win), ["_win", "_len"]).select(*keys, "start", F.col("_len").alias("length"), "items")
    # summed up where rows lie, so that copies of one row never meet
    return met.groupBy(*keys, "start", "length").agg(F.any_value("items").alias("items"))


def contamination_spans(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Maximal runs of hit words: doc_id, start, end (in words, end exclusive), items."""
    hits = window_hits(docs, bench, window, gram)
    w = Window.partitionBy("doc_id", "_tag").orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = fresh.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("doc_id", "_tag", "_run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).select("doc_id", "start", "end", "items")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Per document row: n_words, n_hit, items (sorted as strings), contaminated."""
    return tagged(docs, bench, window, gram).drop("_tag")


def tagged(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The same with ``_tag`` (hash of the text), which tells rows of one id, or without an id, apart."""
    hits = window_hits(docs, bench, window, gram)
    w = Window.partitionBy("doc_id", "_tag").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    per = hits.select("*", new.alias("_new")).groupBy("doc_id", "_tag").agg(
        F.sum("_new").alias("_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"),
    )
    per = per.select(F.col("doc_id").alias("_d"), F.col("_tag").alias("_t"), "_hit", "_items")
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("_tag"), F.size(raw_words(F.col("text"))).alias("n_words")
    )
    return base.join(per, same_keys(["doc_id", "_tag"], ["_d", "_t"]), "left").select(
        "doc_id", "_tag", F.col("n_words").cast("long"),
        F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The registered query's columns."""
    sha = F.when(F.size("items") == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(F.array_join("items", ","), 256))
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha.alias("items_sha256"), "contaminated",
    )


#: The same by plain window lists.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, p, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
marked AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
