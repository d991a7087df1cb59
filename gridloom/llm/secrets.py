"""Secret scans on DataFrame functions alone.

Three base rules find assignments, access keys and long hex runs. Two first-order character
Markov models, one of random strings and one of ordinary identifiers, are counted from labelled
samples of all different texts, first characters and transitions. A token outside the base spans is scored by the
log-likelihood ratio of the two; from a threshold on it is added as kind ``random``. The threshold is
calibrated on the samples of texts that weren't counted. Positions are code points, ends exclusive.

Cases: null and empty texts have no spans; repeated rows each get a result row; without samples
both models are uniform and add nothing; the part of a token that lies outside base spans is a token of
its own; tokens of few different characters (rules, fillers, repeated patterns) are no candidates,
since a ratio summed over one repeated transition says nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh

#: Fixed rules, in the order in which equal starts are listed: kind -> pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run is matched whole, so a least length in the pattern drops the same ones
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 8

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Characters of a scored token, and how many different ones it needs.
TOKEN_LEAST, DISTINCT_LEAST = 16, 8
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}"
#: What stands between the words of a joined run.
JOINS = ("_", "-", "/", "")
#: Least log-likelihood ratio, in nats, of a random token, the share of ordinary samples that may reach the threshold, and
#: the threshold's steps in a nat.
RATIO_LEAST, FALSE_RATE, GRAIN = 12.0, 1e-4, 100
#: What every transition counts before any is seen; one text in so many calibrates the threshold.
PRIOR, HELD_OUT = 0.5, 5
#: Matches whose positions are summed up together.
BLOCK = 256

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


@dataclass
class Model:
    """Log ratios of the random to the ordinary model, of first characters and of (from, to) over ``ALPHABET``."""

    first: list[float]
    moves: list[float]
    threshold: float = RATIO_LEAST


def _span(s: Column, shift: Column) -> Column:
    return F.struct(
        (s["start"] + shift).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + shift).alias("end"), s["value"].alias("value")
    )


def _spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """All matches with positions: lengths of the pieces between matches are summed up, within blocks of
    matches and then over the blocks, so that work stays near the number of matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, 1, F.size(found)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["m"])
        one = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
            end.alias("end"), p["v"].alias("value"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    def follow(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: _span(s, acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(parts, i, BLOCK), zero, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    listed = F.flatten(F.aggregate(blocks, none, follow, lambda acc: acc["out"]))
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base rules, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_spans(text, "assign", ASSIGN, 1), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    both = F.concat(assign, _spans(text, "access", ACCESS), _spans(text, "hex", HEX))
    return F.array_sort(both)


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, label, n, n_first, held) from all different texts: digests of a text in hex, base64 and letters
    and digits alone, and what access and hex rules match, count as random (1); all words, and all runs of three
    joined as in identifiers, count as ordinary (0). One text in ``HELD_OUT`` is held out; its words come as one
    token with spaces, which stands for them and their joined runs.

    Of the others, runs aren't written out: their transitions are those of their words and of the joints between
    words. Words and joints are summed over all texts, with the numbers of samples to which their transitions
    (``n``) and their first characters (``n_first``) belong."""
    seen = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_x"))
    held = F.pmod(F.xxhash64("_x"), F.lit(HELD_OUT)) == 0
    words = F.regexp_extract_all("_x", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("_w")

    fit = seen.filter(~held).distinct().select("_x", F.sha2("_x", 256).alias("_d"), words)
    raw = F.concat(
        F.array(F.col("_d"), F.base64(F.unhex("_d")), F.translate(F.base64(F.unhex("_d")), "+/=", ""), F.upper(F.substring("_d", 1, 20))),
        F.regexp_extract_all("_x", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("_x", F.lit(HEX), F.lit(0)),
    )
    one = lambda t, label, at, after: F.struct(t.alias("token"), F.lit(label).alias("label"), at.alias("_at"), after.alias("_next"))
    plain = F.transform("_w", lambda t, i: one(t, 0, i, F.substring(F.get("_w", i + 1), 1, 1)))
    rows = fit.select((F.size("_w") - 3).alias("_last"), F.inline_outer(F.concat(F.transform(raw, lambda t: one(t, 1, F.lit(0), F.lit(None).cast("string"))), plain)))
    # runs start at words 0 to _last: those with word _at, and those with the joint behind it
    runs = lambda back: F.greatest(F.least("_at", "_last") - F.greatest(F.col("_at") - back, F.lit(0)) + 1, F.lit(0)) * len(JOINS)
    ordinary = F.col("label") == 0
    word = F.struct(
        "token", "label", F.when(ordinary, runs(2) + 1).otherwise(1).alias("n"),
        F.when(ordinary & (F.col("_at") <= F.col("_last")), 1 + len(JOINS)).otherwise(1).alias("n_first"), F.lit(False).alias("_joint"),
    )
    joint = F.struct(
        F.concat(F.substring("token", -1, 1), "_next").alias("token"), "label", F.when(F.col("_next").isNotNull(), runs(1)).otherwise(0).alias("n"),
        F.lit(0).alias("n_first"), F.lit(True).alias("_joint"),
    )
    sums = rows.select(F.inline(F.array(word, joint))).filter("n > 0").groupBy("token", "label", "_joint").agg(F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))
    left, right = F.substring("token", 1, 1), F.substring("token", 2, 1)
    split = F.array(*[x for sep in JOINS for x in ((F.concat(left, F.lit(sep)), F.concat(F.lit(sep), right)) if sep else (F.col("token"),))])
    each = F.explode(F.when(F.col("_joint"), split).otherwise(F.array("token"))).alias("token")
    counted = sums.select(each, "label", (F.col("n") / F.when(F.col("_joint"), len(JOINS)).otherwise(1)).cast("long").alias("n"), "n_first", F.lit(False).alias("held"))

    passages = seen.filter(held).distinct().select(F.array_join(F.regexp_extract_all("_x", F.lit("[A-Za-z]{2,}"), F.lit(0)), " ").alias("token"))
    n = F.lit(1).cast("long")
    return counted.unionAll(passages.select("token", F.lit(0).alias("label"), n.alias("n"), n.alias("n_first"), F.lit(True).alias("held")))


def train(samples: DataFrame) -> Model:
    """Count both models on the samples that aren't held out and calibrate the threshold on the others, the least
    value of at least ``RATIO_LEAST`` that no more than ``FALSE_RATE`` of these reach, in steps of 1 / ``GRAIN``.
    Samples without a column ``held`` are whole tokens, of which one in ``HELD_OUT`` is held out."""
    k = len(ALPHABET)
    if "held" not in samples.columns:
        held = F.pmod(F.xxhash64("token"), F.lit(HELD_OUT)) == 0
        samples = samples.select("token", "label", "n", F.col("n").alias("n_first"), held.alias("held"))
    toks = samples.filter((F.length("token") >= 2) & ~F.col("held"))
    pairs = toks.select("label", "n", "n_first", "token", F.explode(F.sequence(F.lit(0), F.length("token") - 1)).alias("_i"))
    # what precedes the first character is written as a space
    pair = F.when(F.col("_i") == 0, F.concat(F.lit(" "), F.substring("token", 1, 1))).otherwise(F.col("token").substr(F.col("_i"), F.lit(2)))
    counts = pairs.groupBy("label", pair.alias("pair")).agg(F.sum(F.when(F.col("_i") == 0, F.col("n_first")).otherwise(F.col("n"))).alias("n"))
    known = counts.filter(F.col("pair").rlike(r"^[ A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$"))  # at most 2 * 68 * 67 rows
    n = [[[PRIOR] * k for _ in range(k + 1)] for _ in range(2)]
    for r in known.collect():
        n[r["label"]][ALPHABET.find(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["n"]  # the last row is the space's
    log = [[[math.log(x / sum(row)) for x in row] for row in c] for c in n]
    ratio = [[b - a for a, b in zip(*rows, strict=True)] for rows in zip(*log, strict=True)]
    model = Model(ratio[-1], [x for row in ratio[:-1] for x in row])
    plain = ordinary_ratios(samples.filter(F.col("held") & (F.col("label") == 0)), model)
    # all values below the least threshold are one bin
    bins = plain.groupBy(F.greatest(F.floor(F.col("r") * GRAIN), F.lit(int(RATIO_LEAST * GRAIN) - 1)).alias("bin")).agg(F.sum("n").alias("n"))
    bins = sorted(((r["bin"], r["n"]) for r in bins.collect()), reverse=True)
    left = FALSE_RATE * sum(n for _, n in bins)
    for at, n in bins:
        if n > left:
            model.threshold = (at + 1) / GRAIN
            break
        left -= n
    return model


def varied(token: Column) -> Column:
    """Whether a token has enough different characters to be more than a repetition."""
    return F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT_LEAST


def _numbers(xs: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in xs)), ",").cast("array<double>")


def log_ratio(token: Column, model: Model) -> Column:
    """How much likelier the random model makes a token's characters, in nats."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    moves, first = _numbers(model.moves), _numbers(model.first)

    def step(acc: Column, c: Column) -> Column:
        more = F.when(acc["at"] < 0, F.get(first, c)).otherwise(F.get(moves, acc["at"] * len(ALPHABET) + c))
        return F.struct(c.alias("at"), (acc["sum"] + F.coalesce(more, F.lit(0.0))).alias("sum"))

    zero = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, zero, step, lambda acc: acc["sum"])


def ordinary_ratios(passages: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(n, r): for each word of a passage and each joined run of three that is a candidate, what ``log_ratio`` gives, put
    together from the parts of the words, each of which is read once."""
    k, cut = len(ALPHABET), 40
    bits = lambda lo: F.split(F.lit(",".join(str(1 << (i - lo) if lo <= i < lo + cut else 0) for i in range(k))), ",").cast("array<long>")
    moves, first, low, high = _numbers(model.moves), _numbers(model.first), bits(0), bits(cut)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1

    def step(acc: Column, c: Column) -> Column:
        more = F.when(c >= 0, F.when(acc["tail"] < 0, F.get(first, c)).otherwise(F.get(moves, acc["tail"] * k + c)))
        return F.struct(
            c.alias("tail"), (acc["sum"] + more).alias("sum"), acc["lo"].bitwiseOR(F.get(low, c)).alias("lo"), acc["hi"].bitwiseOR(F.get(high, c)).alias("hi")
        )

    none = F.lit(0).cast("long")
    zero = F.struct(F.lit(-1).alias("tail"), F.lit(0.0).alias("sum"), none.alias("lo"), none.alias("hi"))
    part = lambda w: F.aggregate(F.transform(F.split(w, ""), code), zero, step, lambda acc: F.struct(
        F.length(w).alias("len"), code(F.substring(w, 1, 1)).alias("head"), acc["tail"].alias("tail"), acc["sum"].alias("sum"), acc["lo"].alias("lo"), acc["hi"].alias("hi"),
    ))

    def candidate(ratio: Column, length: Column, lo: Column, hi: Column) -> Column:
        return F.when((length >= TOKEN_LEAST) & (F.bit_count(lo) + F.bit_count(hi) >= DISTINCT_LEAST), ratio)

    def ratios(a: Column, b: Column, c: Column) -> Column:
        lo, hi = a["lo"].bitwiseOR(b["lo"]).bitwiseOR(c["lo"]), a["hi"].bitwiseOR(b["hi"]).bitwiseOR(c["hi"])
        inner = a["sum"] + b["sum"] - F.get(first, b["head"]) + c["sum"] - F.get(first, c["head"])
        out = [candidate(a["sum"], a["len"], a["lo"], a["hi"])]
        for sep in JOINS:
            at = ALPHABET.find(sep) if sep else None
            move = lambda x, y: F.get(moves, x * k + y)
            joint = lambda x, y: move(x["tail"], y["head"]) if at is None else move(x["tail"], F.lit(at)) + move(F.lit(at), y["head"])  # noqa: E731, B023
            mark = F.lit(1 << (at - cut)).cast("long") if sep else none
            out.append(candidate(inner + joint(a, b) + joint(b, c), a["len"] + b["len"] + c["len"] + 2 * len(sep), lo, hi.bitwiseOR(mark)))
        return F.array(*out)

    # outer generators: for others the optimizer adds filters that compute the same arrays again
    lined = F.transform("_p", lambda p, i: F.struct(p.alias("a"), F.get("_p", i + 1).alias("b"), F.get("_p", i + 2).alias("c")))
    runs = passages.select("n", *keep, F.transform(F.split("token", " "), part).alias("_p")).select("n", *keep, F.inline_outer(lined))
    return runs.select("n", *keep, F.explode_outer(ratios(*(F.col(x) for x in "abc"))).alias("r")).filter(F.col("r").isNotNull())


def _found(text: Column, base: Column, model: Model) -> Column:
    """Base spans and the tokens outside them that the models call random; base spans are blanked first."""
    blanked = redact(text, base, None)
    more = F.filter(_spans(blanked, "random", TOKEN), lambda s: varied(s["value"]) & (log_ratio(s["value"], model) >= model.threshold))
    return F.array_sort(F.concat(base, more))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (start, rank, kind, end, value), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("_x"), base_spans(text).alias("base"))
    return found.select("doc_id", "base", _found(F.col("_x"), F.col("base"), model).alias("spans"))


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """All columns, every span of ``text`` replaced by a mark; null texts stay null."""
    base, spans = fresh(docs, "base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", base_spans(text).alias(base))
    found = found.select("*", _found(text, F.col(base), model).alias(spans))
    clean = F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col(spans))).alias("text")
    return found.select(*[clean if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def redact(text: Column, spans: Column, mark: str | None = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans give one mark. Without a mark, blanks of the
    span's length keep all positions."""
    def put(a: Column, s: Column) -> Column:
        start = F.greatest(a["at"], s["start"])
        gap = a["chunk"].substr(a["at"] - a["base"] + 1, start - a["at"])
        if mark is None:
            new = F.concat(gap, F.repeat(F.lit(" "), F.greatest(s["end"] - start, F.lit(0))))
        else:
            new = F.when(s["start"] >= a["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(
            a["base"].alias("base"), a["chunk"].alias("chunk"), F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["out"], new).alias("out")
        )

    # spans go block by block, each over its own piece of the text, so that no list or search starts anew at every span
    def block(acc: Column, i: Column) -> Column:
        part = F.slice(spans, i + 1, SPAN_BLOCK)
        most = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        start = F.struct(
            acc["at"].alias("base"), text.substr(acc["at"] + 1, most - acc["at"]).alias("chunk"), acc["at"].alias("at"), F.array().cast("array<string>").alias("out")
        )
        done = F.aggregate(part, start, put, lambda a: F.struct(a["at"].alias("at"), F.array_join(a["out"], "").alias("t")))
        return F.aggregate(F.array(done), acc, lambda old, d: F.struct(d["at"].alias("at"), F.array_append(old["out"], d["t"]).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text)))
    starts = F.sequence(F.lit(0), F.size(spans) - 1, F.lit(SPAN_BLOCK))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(F.when(F.size(spans) > 0, starts).otherwise(F.array(F.lit(0))), zero, block, rest))


#: Spans that are replaced together.
SPAN_BLOCK = 64


def digest(scanned: DataFrame) -> DataFrame:
    """The registered query's columns."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    n = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[n("base", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        n("spans", "random").alias("n_random"),
    )
