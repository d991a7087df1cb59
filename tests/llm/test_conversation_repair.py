"""Conversation repair against exhaustive search and a plain reading of the rules."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from gridloom.llm import audit_dp, conversation_repair

NEXT = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def searched(rows):
    """Cost and audit of (initial, must go, truncated) rows by trying everything."""

    @cache
    def best(i, q, inserted):
        ways = [(0, "")] if i == len(rows) and q in "03" else []
        if inserted < 3:
            ways += [(k + 3, "I" + s) for to in NEXT[q].values() if to in "23" for k, s in [best(i, to, inserted + 1)]]
        if i < len(rows):
            initial, gone, cut = rows[i]
            k, s = best(i + 1, q, 0)
            ways.append((k + 4, "D" + s))
            if not gone:
                more = 3 if cut else 0
                if initial in NEXT[q]:
                    k, s = best(i + 1, NEXT[q][initial], 0)
                    ways.append((k + more, "K" + s))
                ways += [(k + 3 + more, "R" + s) for to in NEXT[q].values() if to in "23" for k, s in [best(i + 1, to, 0)]]
        return min(ways) if ways else (1 << 60, "~")

    for i in reversed(range(len(rows))):  # from the end, so that calls don't nest
        for q in NEXT:
            best(i, q, 0)
    return best(0, "0", 0)


def solved(rows):
    cells = audit_dp.begin(audit_dp.START)
    for r in rows:
        cells = audit_dp.step(cells, *r)
    return audit_dp.finished(cells)


def solved_apart(rows, size):
    whole = audit_dp.begin(audit_dp.START)
    for lo in range(0, len(rows), size):
        ways = []
        for q in range(4):
            cells = audit_dp.begin(q)
            for r in rows[lo : lo + size]:
                cells = audit_dp.step(cells, *r)
            ways.append([c and (c[0], c[1].text()) for c in cells])
        whole = audit_dp.joined(whole, ways)
    return audit_dp.finished(whole)


def test_audits_equal_exhaustive_search():
    rng = random.Random(1)
    for _ in range(3000):
        rows = tuple((rng.choice("suax"[: rng.randint(2, 4)]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9)))
        want = searched(rows)
        assert solved(rows) == want
        assert solved_apart(rows, rng.randint(1, 4)) == want
    long = tuple((rng.choice("ssuuaax"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(200))
    assert solved(long) == solved_apart(long, 17) == searched(long)


def test_collided_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(audit_dp, "_PRIME", 3)
    rng = random.Random(2)
    for _ in range(300):
        rows = tuple((rng.choice("sua"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12)))
        assert solved(rows) == searched(rows)


def plain(table, harm=True):
    """The rules read out, over a list of (conv_id, turn, role, text)."""
    shown = lambda x: " " if x is None else str(x)
    rows = []
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20 if harm else 9
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        rows += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv in {r[0] for r in table}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.rstrip(conversation_repair.SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = searched(tuple((r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults, strict=True)))
        n = len(audit) - audit.count("D")
        due = (["system"] if n % 2 else []) + ["user", "assistant"] * (n // 2)
        fixed, at = [], 0
        for letter in audit:
            if letter != "I":
                role, text = own[at][2:]
                at += 1
            if letter != "D":
                want = due[len(fixed)]
                assert letter != "K" or role[:1] == want[:1]
                fixed.append((role if letter == "K" else want, "" if letter == "I" else text))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    kept = [(c, t, r, x, "k", 1, 2, "z") for c, t, r, x in rows]
    return spark.createDataFrame(kept, "conv_id long, turn long, role string, text string, kind string, part int, seq int, digest string")


def random_rows(seed, n, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And so", "", " \t\n", None, "Why?  ", "a.b", "É…", " ", "x\u0085"]
    roles = ["user", "assistant", "system", "tool", None, "", "uther"]
    return [(rng.choice(convs), rng.choice([None, *range(-2, 9)]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("most", [conversation_repair.PIECE, 3])
def test_reports_equal_plain_reading(spark, most):
    rows = random_rows(3, 400, [None, *range(60)])
    rows += [(100, 5, "user", "Hot.")] * 40 + [(100, t, "assistant", f"All {t}.") for t in range(300)]  # one conversation holds near half
    rows += [(7, 1, "user", "Yes.")] * 3
    rows += [(200, t, "user", f"{t}") for t in range(60) if zlib.crc32(f"200:{t}".encode()) % 20 == 0]  # nothing is left of it
    df = table(spark, rows)
    got = conversation_repair.report(conversation_repair.damage(df), df, most)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    got = conversation_repair.report(df, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, harm=False)


def test_no_rows_and_far_turns(spark):
    df = table(spark, [])
    assert conversation_repair.digest(df).collect() == []
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    got = conversation_repair.report(table(spark, far)).collect()
    assert [(r["gaps"], r["audit"]) for r in got] == [((1 << 63) - 1, "KK")]


def test_repaired_rows_are_legal(spark):
    rows = random_rows(5, 300, list(range(40)))
    df = table(spark, rows)
    found = {}
    for r in conversation_repair.repaired(df).collect():
        found.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"], r["edit"]))
    for r in conversation_repair.report(df).collect():
        fixed = sorted(found.get(r["conv_id"], []))
        assert [x[0] for x in fixed] == list(range(len(fixed)))
        assert conversation_repair.legal([x[1] for x in fixed])
        assert "".join(x[3] for x in fixed) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{x[1]}:{x[2]}" for x in fixed).encode()).hexdigest() == r["repaired_sha256"]


def test_one_conversation_lies_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = table(spark, [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(4000)] + [(2, 0, "user", "x.")])
    parts = conversation_repair.pieces(conversation_repair.marked(df), 100)
    per = {(r["conv_id"], r["part"]): r["n"] for r in parts.groupBy("conv_id", "part").agg({"seq": "count"}).withColumnRenamed("count(seq)", "n").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for c, p in per if c == 1]) > 2 and max(per.values()) < 25
    got = {r["conv_id"]: r for r in conversation_repair.report(df, most=100).collect()}
    assert got[1]["audit"] == "K" * 4000 and got[1]["cost"] == 0 and got[2]["cost"] == 3
