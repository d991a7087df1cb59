"""Tool-call linking on DataFrame functions alone.

Calls and results meet in a shuffled hash join by conversation and call id. Where every dependency
stands before its call, turns are a topological order; in other conversations dependencies give each
call its level by repeated joins. Arguments are checked against per-tool schemas, and each linked
call becomes one canonical JSON record (keys sorted at every depth).

Cases: a call without conversation or call id keeps its own row with status ``no_id``; of repeated
call ids the first (by turn, then arguments) counts; of repeated results the first by turn is kept
and all are counted; results without a call are left out (``orphans`` lists them); arguments that
aren't a JSON object, or unknown tools, are invalid; calls in or behind a dependency cycle have no
level and come last; dependencies that name no call are ignored. Other columns are ignored.

A conversation may hold any share of the calls: it is dealt by call id in joins, and calls are numbered
by counts for each level and block of turns plus a rank within these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import join_spread, materialise

#: Turns of a conversation that are numbered in one task.
BLOCK = 4096

#: Fixed JSON type names and what ``schema_of_variant`` says of such values.
JSON_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}


#: Rows of schemas that are still sent to every executor.
BROADCAST_SCHEMAS = 100_000


def first_calls(calls: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id); calls: conv_id, turn, call_id, name, arguments, depends."""
    held = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    row = F.struct("turn", "arguments", "name", "depends")
    best = held.groupBy("conv_id", "call_id").agg(F.min(row).alias("_r"))
    return best.select("conv_id", "call_id", "_r.turn", "_r.name", "_r.arguments", "_r.depends")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 without dependencies, else one more than the highest of them.

    Each round places the calls whose dependencies are all placed, so there are as many rounds as
    the longest chain; what stays when a round places nothing stands in or behind a cycle.
    """
    ids = calls.select("conv_id", "call_id")
    deps = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.array_compact("depends"))).alias("dep"))
    known = ids.select(F.col("conv_id"), F.col("call_id").alias("dep"))
    left = materialise(deps.join(known, ["conv_id", "dep"], "left_semi"), "deps")
    placed = materialise(ids.join(left, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "placed")
    done, n = placed, 0
    while not left.isEmpty() and not placed.isEmpty():
        n += 1
        rest = left.join(placed.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
        rest = materialise(rest, "deps")
        freed = left.select("conv_id", "call_id").distinct().join(rest, ["conv_id", "call_id"], "left_anti")
        placed = materialise(freed.withColumn("level", F.lit(n)), "placed")
        left, done = rest, done.unionByName(placed)
    return done


def out_of_order(calls: DataFrame) -> DataFrame:
    """conv_id of conversations in which a call depends on itself or on a later one."""
    deps = calls.select("conv_id", F.struct("turn", "call_id").alias("_at"), F.explode(F.array_compact("depends")).alias("dep"))
    target = calls.select("conv_id", F.col("call_id").alias("dep"), F.struct("turn", "call_id").alias("_dep"))
    return deps.join(target, ["conv_id", "dep"]).filter("_dep >= _at").select("conv_id").distinct()


def numbered(calls: DataFrame) -> DataFrame:
    """``position`` from 1 within a conversation, by level (none comes last), turn (none comes first) and call id."""
    group = ["conv_id", "_level", "_block"]
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**63)))
    placed = calls.withColumns({"_level": F.coalesce("level", F.lit(2**31 - 1)), "_block": block})
    count = placed.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_level", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    offset = count.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("turn", "call_id"))
    ranked = placed.withColumn("_rank", rank).join(offset, group)
    return ranked.withColumn("position", (F.col("_before") + F.col("_rank")).cast("long")).drop("_level", "_block", "_rank", "_before")


def argument_errors(args: Column, schema: Column) -> Column:
    """What is wrong with a map of variants; schema: array of (arg, type, required), null if none."""
    held = F.map_keys(args)
    missing = F.transform(
        F.filter(schema, lambda s: s["required"] & ~F.array_contains(held, s["arg"])),
        lambda s: F.concat(F.lit("missing:"), s["arg"]),
    )
    kind = lambda s: F.schema_of_variant(F.try_element_at(args, s["arg"]))
    fits = lambda s: F.regexp_like(kind(s), F.element_at(F.create_map(*[F.lit(x) for kv in JSON_TYPES.items() for x in kv]), s["type"]))  # noqa: E731, E501
    typed = F.transform(
        F.filter(schema, lambda s: F.array_contains(held, s["arg"]) & ~F.coalesce(fits(s), F.lit(False))),
        lambda s: F.concat(F.lit("type:"), s["arg"]),
    )
    names = F.transform(schema, lambda s: s["arg"])
    extra = F.transform(F.array_except(held, names), lambda k: F.concat(F.lit("unknown:"), k))
    return F.when(schema.isNull(), F.array(F.lit("tool"))).when(args.isNull(), F.array(F.lit("json"))).otherwise(
        F.array_sort(F.concat(missing, typed, extra))
    )


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, position, status, errors, n_results, record.

    results: conv_id, turn, call_id, content; schemas: name, arg, type, required.
    """
    first = materialise(first_calls(calls), "calls")
    per_tool = schemas.groupBy("name").agg(F.collect_list(F.struct("arg", "type", "required")).alias("_schema"))
    # few names take most calls, so the schemas are sent to the calls where their number allows it
    few = schemas.count() <= BROADCAST_SCHEMAS
    tools = first.join(F.broadcast(per_tool) if few else per_tool, "name", "left")
    answers = results.groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("_res")
    )
    both = tools.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    # where every dependency stands earlier, the order of turns is one; only the rest needs levels
    mixed = materialise(out_of_order(first), "mixed")
    level = levels(join_spread(first, mixed, ["conv_id"], ["call_id"]))
    both = both.join(level, ["conv_id", "call_id"], "left")
    both = join_spread(both, mixed.withColumn("_mixed", F.lit(True)), ["conv_id"], ["call_id"], "left")
    both = both.withColumn("level", F.when(F.col("_mixed").isNull(), 0).otherwise(F.col("level")))
    object_ = F.col("arguments").rlike(r"^\s*\{")
    args = F.when(object_ & F.try_parse_json("arguments").isNotNull(), F.from_json("arguments", "map<string,variant>"))
    errors = argument_errors(args, F.col("_schema"))
    ready = numbered(both).select(
        "conv_id", "call_id", "turn", "name", "level", errors.alias("errors"), F.col("_res.content").alias("content"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(object_, F.to_json(F.try_parse_json("arguments"))).alias("_args"), "position",
    )
    status = (
        F.when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid")
        .when(F.col("n_results") == 0, "unanswered").otherwise("linked")
    )
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    part = lambda key, val: F.concat(F.lit(f'"{key}":'), F.when(F.coalesce(val, F.lit("")) == "", F.lit("null")).otherwise(val))
    record = F.concat(
        F.lit("{"), F.concat_ws(",", part("arguments", F.col("_args")), part("id", quoted(F.col("call_id"))),
        part("name", quoted(F.col("name"))), part("result", quoted(F.col("content")))), F.lit("}"),
    )
    linked = ready.select(
        "conv_id", "call_id", "position", status.alias("status"),
        F.array_join("errors", ",").alias("errors"), "n_results", record.alias("record"),
    )
    stray = calls.filter("conv_id IS NULL OR call_id IS NULL").select(
        "conv_id", "call_id", F.lit(None).cast("long"), F.lit("no_id"), F.lit(""),
        F.lit(0).cast("long"), F.lit(None).cast("string"),
    )
    return linked.unionAll(stray)


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call isn't there."""
    return results.join(first_calls(calls), ["conv_id", "call_id"], "left_anti")


def calls_from_conversations(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls, assistant turns as results of the call one turn before, since the table at hand
    has no tool calls.

    Arguments are counts and texts, some of a wrong type. By the remainder of conv_id calls depend on
    earlier turns, on later ones, on the first and last of four (also later), on each other in a circle, or on nothing;
    some ids are missing and some repeated.
    """
    conv_id, turn = F.col("conv_id"), F.col("turn")
    ref = lambda at: F.concat(F.lit("c"), at.cast("string"))
    repeated, missing = conv_id % 11 == 7, (conv_id % 11 == 5) & (turn % 4 == 0)
    call_id = F.when(~F.coalesce(missing, F.lit(False)), F.when(repeated, ref(F.floor(turn / 4))).otherwise(ref(turn)))
    n = F.length(F.coalesce("text", F.lit("")))
    name = F.element_at(F.array(F.lit("search"), F.lit("count"), F.lit("other")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    sized = F.when(F.pmod(n, F.lit(7)) == 0, F.to_json(F.struct(F.col("text").alias("query"), n.cast("string").alias("limit"))))
    args = sized.otherwise(F.to_json(F.struct(n.alias("limit"), F.col("text").alias("query"))))
    none, four = F.array().cast("array<string>"), turn - turn % 4
    depends = (
        F.when(conv_id % 4 == 0, F.array(ref(turn - 1), ref(turn - 2)))
        .when(conv_id % 4 == 1, F.when(turn % 8 < 6, F.array(ref(turn + 2), ref(turn + 1))).otherwise(none))
        .when(conv_id % 4 == 2, F.when(turn % 4 == 0, none).when(turn % 4 == 3, F.array(ref(four))).otherwise(F.array(ref(four), ref(four + 3))))
        .when(conv_id % 8 == 3, F.array(F.when(turn % 4 == 0, ref(turn + 1)).otherwise(ref(turn - 1))))
    )
    calls = conv.filter("role = 'user'").select(
        "conv_id", "turn", call_id.alias("call_id"), name.alias("name"), args.alias("arguments"), depends.alias("depends")
    )
    asked = F.when(repeated, ref(F.floor((turn + 3) / 4) - 1)).otherwise(ref(turn - 1))
    results = conv.filter("role = 'assistant'").select("conv_id", "turn", asked.alias("call_id"), F.col("text").alias("content"))
    return calls, results


def report(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """The registered query: rows of ``link``, and results without a call with status ``orphan``."""
    lost = orphans(calls, results).select(
        "conv_id", "call_id", F.lit(None).cast("long"), F.lit("orphan"), F.lit(""), F.lit(1).cast("long"), F.lit(None).cast("string")
    )
    return link(calls, results, schemas).unionAll(lost)


#: Fixed tool schemas of the registered query: name, argument, type, required.
SCHEMAS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("count", "query", "string", True), ("count", "limit", "integer", True),
]


#: The registered query in SQL; a chain of 40 calls would be a cycle.
ORACLE = """
WITH RECURSIVE u AS (SELECT conv_id, turn, length(text) AS n, text, ['search', 'count', 'other'][length(text) % 3 + 1] AS name,
    CASE WHEN conv_id % 11 = 5 AND turn % 4 = 0 THEN NULL WHEN conv_id % 11 = 7 THEN 'c' || (turn // 4) ELSE 'c' || turn END AS call_id,
    CASE WHEN conv_id % 4 = 0 THEN ['c' || (turn - 1), 'c' || (turn - 2)]
        WHEN conv_id % 4 = 1 THEN CASE WHEN turn % 8 < 6 THEN ['c' || (turn + 2), 'c' || (turn + 1)] END
        WHEN conv_id % 4 = 2 THEN CASE turn % 4 WHEN 0 THEN NULL WHEN 3 THEN ['c' || (turn - 3)]
            ELSE ['c' || (turn - turn % 4), 'c' || (turn - turn % 4 + 3)] END
        WHEN conv_id % 8 = 3 THEN [CASE WHEN turn % 4 = 0 THEN 'c' || (turn + 1) ELSE 'c' || (turn - 1) END] END AS depends
    FROM conversations WHERE role = 'user'),
f AS (SELECT * FROM u WHERE call_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) = 1),
d AS (SELECT e.conv_id, e.call_id, e.dep, (f.turn, f.call_id) >= (e.turn, e.call_id) AS later
    FROM (SELECT conv_id, turn, call_id, unnest(depends) AS dep FROM f) e JOIN f ON f.conv_id = e.conv_id AND f.call_id = e.dep),
mixed AS (SELECT DISTINCT conv_id FROM d WHERE later),
reach AS (SELECT conv_id, call_id, 0 AS l FROM f SEMI JOIN mixed USING (conv_id)
    UNION SELECT d.conv_id, d.call_id, l + 1 FROM reach JOIN d ON d.conv_id = reach.conv_id AND d.dep = reach.call_id WHERE l < 40),
lv AS (SELECT conv_id, call_id, CASE WHEN max(l) < 40 THEN max(l) END AS level FROM reach GROUP BY 1, 2),
r AS (SELECT conv_id, CASE WHEN conv_id % 11 = 7 THEN 'c' || ((turn + 3) // 4 - 1) ELSE 'c' || (turn - 1) END AS call_id, turn, text
    FROM conversations WHERE role = 'assistant'),
a AS (SELECT conv_id, call_id, count(*) AS n_results, arg_min(text, turn) AS content FROM r GROUP BY 1, 2),
x AS (SELECT f.*, coalesce(n_results, 0) AS n_results, content, CASE WHEN mixed.conv_id IS NULL THEN 0 ELSE level END AS level,
    CASE WHEN name = 'other' THEN 'tool' WHEN n % 7 = 0 THEN 'type:limit' ELSE '' END AS errors
    FROM f LEFT JOIN a USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id) LEFT JOIN mixed ON mixed.conv_id = f.conv_id)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) AS position,
    CASE WHEN level IS NULL THEN 'cycle' WHEN errors <> '' THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'linked' END AS status,
    errors, cast(n_results AS BIGINT) AS n_results,
    '{"arguments":{"limit":' || CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || ',"query":' || to_json(text)::VARCHAR || '},"id":"' || call_id
    || '","name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record
FROM x
UNION ALL SELECT conv_id, NULL, NULL, 'no_id', '', 0, NULL FROM u WHERE call_id IS NULL
UNION ALL SELECT conv_id, call_id, NULL, 'orphan', '', 1, NULL FROM r ANTI JOIN f USING (conv_id, call_id)
"""
