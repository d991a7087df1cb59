"""Conversation structure repair: cheapest edits that give each conversation the form ``s?(ua)+``, or nothing.

``marked`` counts equal rows, and finds the first fault of each in joins of small rows that carry a hash of
the text. ``pieces`` ranges them by conversation and turn, so that one long conversation lies in many tasks,
and solves runs of at most ``PIECE`` rows with the programme of ``audit_dp`` for every state they may begin in.
``_streamed`` brings pieces and texts of a conversation together in order, joins the pieces to an audit and
then passes the texts on once, without keeping them: a digest of a whole conversation is a chain by its
nature, so only this last pass sees all of a conversation in one task, in constant memory but for the audit.

Order: by turn, nulls first; rows of one turn by role (its first ``ROLE_KEY`` characters, the rest last of all), then
by the SHA-256 of their text. Cases: a null role
or text is one space; a null ``conv_id`` is a conversation of its own; equal rows count each, all but the first
as duplicates; conversations without rows, empty tables and other columns (ignored) are fine; turns further apart than
a long holds give the largest long.
"""

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import audit_dp
from gridloom.llm.common import materialise

SPACE = " \t\n\x0b\f\r"
#: Rows of a conversation that are solved in one go.
PIECE = 4_096
LAST = (1 << 63) - 1
#: Characters of a role by which rows of one turn are dealt and ordered.
ROLE_KEY = 64


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults dealt by a checksum of the row's place."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20)).cast("int")
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("_fault <> 0").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _texts(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text")
    )


def _last_char(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n (equal rows), fault (of the first of them: blank, duplicate, truncated or null)."""
    last = _last_char(F.col("text"))
    state = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    light = _texts(rows).select("conv_id", "turn", "role", "digest", state.alias("state"))
    light = light.groupBy("conv_id", "turn", "role", "digest", "state").agg(F.count("*").alias("n"))
    light = materialise(light, "rows")
    # the first of rows with one role and text has no turn, or else the least one
    first = light.groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("_none"), F.min("turn").alias("_first"), F.count("*").alias("_rows"))
    first = first.filter("_rows > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_none", "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    met = light.join(first, same, "left")
    later = F.col("_d").isNotNull() & F.col("turn").isNotNull() & (F.col("_none") | (F.col("turn") > F.col("_first")))
    fault = F.when(F.col("state") == "blank", "blank").when(later, "duplicate").otherwise(F.col("state"))
    return met.select("conv_id", "turn", "role", "digest", "n", fault.alias("fault"))


class _Piece:
    """A run of rows of one conversation, solved for the states it may begin in."""

    def __init__(self, states: range):
        self.cells = {q: audit_dp.begin(q) for q in states}
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.turn = self.least = self.initial = self.first = None

    def add(self, turn: int | None, role: str, n: int, fault: str | None) -> None:
        initial = role[:1]
        if self.initial is None:
            self.first = initial
        else:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.illegal += n - 1
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn = turn
            self.least = turn if self.least is None else self.least
        gone = fault in ("blank", "duplicate")
        self.blank += n if fault == "blank" else 0
        self.duplicate += n if fault == "duplicate" else 0 if fault == "blank" else n - 1
        self.truncated += fault == "truncated"
        for q, cells in self.cells.items():
            if not gone:
                cells = audit_dp.step(cells, initial, False, fault == "truncated")
            if gone or n > 1:
                cells = audit_dp.deleted(cells, n if gone else n - 1)
            self.cells[q] = cells
        self.rows += 1


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """Solved runs of ``marked`` rows: conv_id, part and seq (their order), counts, ends, costs and audits."""
    conv = rows.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("conv_id", conv), *T.StructType.fromDDL(
            "part int, seq long, counts array<long>, least long, most long, first string, last string, costs array<long>, audits array<string>"
        ).fields,
    ])
    keys = ["conv_id", "turn", F.substring("role", 1, ROLE_KEY), "digest"]  # equal rows are one here, so no key is large
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "role")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, piece, opened = TaskContext.get().partitionId(), 0, None, None, False
        names = [f.name for f in schema]
        kinds = None

        def out(p: _Piece) -> tuple:
            ways = [p.cells[q][to] if q in p.cells else None for q in range(4) for to in range(4)]
            counts = [p.blank, p.duplicate, p.truncated, p.illegal, p.turns]
            return now, part, seq, counts, p.least, p.turn, p.first, p.initial, [w and w[0] for w in ways], [w and w[1].text() for w in ways]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for b in it:
            if kinds is None:
                kinds = [b.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            found = []
            for c, turn, role, n, fault in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "n", "fault")), strict=True):
                if piece is None or c != now or piece.rows >= most:
                    # a conversation that begins inside a task begins in the first state; others may have begun before
                    starts = range(1) if opened and c != now else range(4)
                    if piece is not None:
                        found.append(out(piece))
                        seq += 1
                    piece, now, opened = _Piece(starts), c, True
                piece.add(turn, role, n, fault)
            if found:
                yield batch(found)
        if piece is not None:
            yield batch([out(piece)])

    return materialise(dealt.mapInArrow(run, schema), "pieces")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "place long, role string, text string, edit string"


class _Whole:
    """Pieces of one conversation, joined in order."""

    def __init__(self):
        self.cells = audit_dp.begin(audit_dp.START)
        self.counts = [0] * 5
        self.least = self.turn = self.initial = None

    def add(self, counts: list[int], least: int | None, most: int | None, first: str, last: str, costs: list, audits: list) -> None:
        ways = [c is not None and (c, a) or None for c, a in zip(costs, audits, strict=True)]
        self.cells = audit_dp.joined(self.cells, [ways[4 * q : 4 * q + 4] for q in range(4)])
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.initial is not None:
            self.counts[3] += self.initial + first not in ("su", "ua", "au")
        self.initial = last
        if least is not None:
            self.counts[4] -= least == self.turn
            self.least = least if self.least is None else self.least
            self.turn = most

    def result(self) -> tuple:
        blank, duplicate, truncated, illegal, turns = self.counts
        gaps = 0 if self.least is None else min(self.turn - self.least + 1 - turns, LAST)
        return gaps, blank, duplicate, truncated, illegal, *audit_dp.finished(self.cells)


class _Editor:
    """Applies an audit to texts that come in order; yields (place, role, text, letter) of rows that stay."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with one of the system

    def _due(self) -> str:
        return "user" if (self.place - self.odd) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self.place, self._due(), "", "I"
            self.at += 1
            self.place += 1

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self.place, role if letter == "K" else self._due(), text, letter
            self.place += 1


def _streamed(rows: DataFrame, every: DataFrame, as_rows: bool, most: int) -> DataFrame:
    solved = pieces(marked(rows), most)
    ids = every.select("conv_id").distinct().withColumn("kind", F.lit(0))
    both = ids.unionByName(solved.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.unionByName(_texts(rows).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    order = ["conv_id", "kind", "part", "seq", "turn", F.substring("role", 1, ROLE_KEY), "digest", "role"]
    both = both.repartition("conv_id").sortWithinPartitions(*order).drop("part", "seq", "turn", "digest")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(ROWS if as_rows else REPORT).fields])
    columns = ["conv_id", "kind", "counts", "least", "most", "first", "last", "costs", "audits", "role", "text"]
    both = both.select(*columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, editor, digest, result, began, conv = None, None, None, None, None, False, None
        out: list[tuple] = []

        def put(found: Iterator[tuple]) -> None:
            for place, role, text, letter in found:
                if as_rows:
                    out.append((now, place, role, text, letter))
                else:
                    digest.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())

        def edit() -> None:
            nonlocal editor, result, digest
            if editor is None:
                result = whole.result()
                editor, digest = _Editor(result[-1]), hashlib.sha256()

        def close() -> None:
            if began:
                edit()
                put(editor.inserted())
                if not as_rows:
                    out.append((now, *result, digest.hexdigest()))

        def batch() -> Iterator[pa.RecordBatch]:
            kinds = [conv, *(pa.int64() if f.dataType == T.LongType() else pa.string() for f in schema.fields[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)
                out.clear()

        for b in it:
            conv = b.schema.field("conv_id").type
            for c, kind, *piece, role, text in zip(*(b.column(k).to_pylist() for k in columns), strict=True):
                if kind == 0:
                    close()
                    now, whole, editor, began = c, _Whole(), None, True
                elif kind == 1:
                    whole.add(*piece)
                else:
                    edit()
                    put(editor.row(role, text))
            yield from batch()
        close()
        if out:
            yield from batch()

    return both.mapInArrow(run, schema)


def report(rows: DataFrame, every: DataFrame | None = None, most: int = PIECE) -> DataFrame:
    """A row for each conversation of ``every`` (the rows' own by default) with its faults, cost, audit and digest."""
    return _streamed(rows, rows if every is None else every.select("conv_id").unionAll(rows.select("conv_id")), False, most)


def repaired(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """The repaired rows: conv_id, place, role, text, edit (K, R or I)."""
    return _streamed(rows, rows, True, most)


def audit_roles(audit: str, roles: list[str]) -> list[str]:
    """Roles that an audit leaves of a list of roles, for reading one by hand."""
    editor = _Editor(audit)
    kept = [r for role in roles for r in editor.row(role, "")]
    return [r[1] for r in [*kept, *editor.inserted()]]


def legal(roles: list[str]) -> bool:
    """Whether roles have the form ``s?(ua)+`` or there are none."""
    marks = "".join(r[:1] for r in roles)
    body = marks[1:] if marks[:1] == "s" else marks
    return not marks or len(body) >= 2 and len(body) % 2 == 0 and body[0] == "u" and all(x != y for x, y in pairwise(body)) and set(body) == {"u", "a"}


def digest(conversations: DataFrame) -> DataFrame:
    """The registered query: ``conversations`` damaged by the fixed rule, then reported."""
    return report(damage(conversations), conversations)


def _oracle() -> str:
    """The query in SQL: the checksum from its definition, and the programme with whole strings row after row."""
    crc = (
        "xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda h, b:"
        " list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(h, b)), 4294967295::BIGINT), 4294967295)"
    )
    put = lambda s, cost, letter, text: f"{{c: {s}.c + {cost}, a: {s}.a || '{letter}', t: {s}.t || {text}}}"
    inserted = lambda s, *roles: put(s, 3 * len(roles), "I" * len(roles), " || ".join(f"chr(10) || '{r}:'" for r in roles))
    none = "{c: 1000000000, a: '', t: ''}"
    kept = lambda s: put(s, "m", "K", "chr(10) || role || ':' || text")
    given = lambda s, role: put(s, "(3 + m)", "R", f"chr(10) || '{role}:' || text")
    moved = lambda s, initial, role: f"CASE WHEN gone THEN {none} WHEN x = '{initial}' THEN {kept(s)} ELSE {given(s, role)} END"
    dead = lambda s: put(s, 4, "D", "''")
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {crc} % 20 AS f FROM c),
g AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(2) AS r(k) WHERE f <> 0 AND (k = 0 OR f = 3)),
ids AS (SELECT row_number() OVER () AS v, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT v, turn, role, text, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS l FROM g JOIN ids ON g.conv_id IS NOT DISTINCT FROM ids.conv_id),
p AS (SELECT *, row_number() OVER (PARTITION BY v, role, text ORDER BY i) > 1 AS again, left(role, 1) AS x,
    left(lag(role) OVER (PARTITION BY v ORDER BY i), 1) || left(role, 1) AS pair FROM o),
q AS (SELECT *, l = '' OR again AS gone, CASE WHEN l IN ('.', '!', '?') THEN 0 ELSE 3 END AS m FROM p),
dp AS (SELECT v, 0::BIGINT AS i, {{c: 0, a: '', t: ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM ids
    UNION ALL SELECT v, i, s0, s1, s2, s3 FROM (
        SELECT v, i, {dead("o0")} AS s0, least({dead("o1")}, CASE WHEN x = 's' AND NOT gone THEN {kept("o0")} ELSE {none} END) AS s1,
            least({dead("o2")}, {moved("o0", "u", "user")}, {moved("o1", "u", "user")}, {moved("e3", "u", "user")}) AS s2,
            least({dead("o3")}, {moved("e2", "a", "assistant")}) AS s3
        FROM (SELECT q.v, q.i, x, gone, m, role, text, s0 AS o0, s1 AS o1, s2 AS o2, s3 AS o3,
            least(s2, {inserted("s0", "user")}, {inserted("s1", "user")}, {inserted("s3", "user")}) AS e2,
            least(s3, {inserted("s2", "assistant")}, {inserted("s0", "user", "assistant")}, {inserted("s1", "user", "assistant")}) AS e3
            FROM dp JOIN q ON q.v = dp.v AND q.i = dp.i + 1))),
n AS (SELECT v, max(i) AS i FROM dp GROUP BY v),
fin AS (SELECT v, least(s0, s3, {inserted("s2", "assistant")}, {inserted("s1", "user", "assistant")}) AS b FROM dp JOIN n USING (v, i)),
k AS (SELECT v, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(l = '') AS blank,
    count_if(l <> '' AND again) AS duplicate, count_if(l <> '' AND NOT again AND m = 3) AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY v)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit,
    sha256(substr(b.t, 2)) AS repaired_sha256
FROM ids JOIN fin USING (v) LEFT JOIN k USING (v)
"""


ORACLE = _oracle()
