"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over ``host`` + ``path`` with the literal tokens that any match
must hold. Token frequencies are counted over all different urls, each rule is indexed by its rarest token,
url tokens fetch candidate rules by a join, and only those run their expression. Of the prefix
rules that fit, the longest wins; pattern rules decide only where no prefix rule fits. A pattern of several
alternatives is written as a rule for each, so that every one has a literal token.

Cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is allowed;
repeated rows each get a result row; a rule without literal tokens (none of the fixed ones) is tried on
every url; of pattern rules that fit, the last in the list decides. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import join_hot, materialise

#: Fixed prefix rules: (verdict, host, path).
PREFIX_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Fixed pattern rules: (verdict, expression over host + path, literal tokens of every match).
PATTERN_RULES = [
    ("block", r"^(?:[^/]*\.)?spam-farm\.", ["spam", "farm"]),
    ("block", r"^(?:[^/]*\.)?cheap-pills\.", ["cheap", "pills"]),
    ("block", r"^(?:[^/]*\.)?casino-win\.", ["casino", "win"]),
    ("block", r"^(?:[^/]*\.)?adult-[^/.]*\.", ["adult"]),
    ("block", r"/login/", ["login"]),
    ("block", r"/signup/", ["signup"]),
    ("block", r"\.exe\z", ["exe"]),
    ("block", r"\.zip\z", ["zip"]),
    ("block", r"\.iso\z", ["iso"]),
]
TOKEN_BREAK = "[^a-z0-9]+"
#: Rules, and bytes of their patterns, that are still sent to every executor; a longer list is shuffled by token.
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 16_000_000
#: A url with more than one in so many pages is sent to its pages; there are as many at most.
HOT_SHARE = 1_024


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, prefixes: list = PREFIX_RULES, patterns: list = PATTERN_RULES) -> DataFrame:
    """rule_no, verdict, pattern, weight, rule (text, for prefix rules) and literal tokens."""
    rows = []
    for verdict, h, p in prefixes:
        # a path prefix may end inside a word of the url, so its last token is no literal
        words = [t for t in re.split(TOKEN_BREAK, h) if t]
        words += [t for t in re.split(TOKEN_BREAK, p.lower()[: -len(re.search("[a-z0-9]*$", p.lower())[0]) or None]) if t]
        rows.append((verdict, rf"^(?:[^/]*\.)?{re.escape(h)}{re.escape(p)}", len(h + p), h + p, words))
    rows += [(v, p, 0, None, t) for v, p, t in patterns]
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "rule_no int, verdict string, pattern string, weight int, rule string, tokens array<string>",
    )


def _tokens(col: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(col), TOKEN_BREAK, -1), ""))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``token``: of their literals the one in the fewest different urls (null without any)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(_tokens(F.concat("host", "path"))).alias("token"))
    freq = seen.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("_n"))
    each = rules.select("rule_no", F.explode("tokens").alias("token")).join(freq, "token", "left")
    best = each.groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("_n", F.lit(0)), "token")).alias("token"))
    return rules.join(best, "rule_no", "left")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, n_tried (rules whose expression ran) for each row."""
    spark = pages.sparkSession
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # equal host and path are judged once and joined back, so a hot url costs one row; empty ones need no judging
    empty = (F.col("host") == "") & (F.col("path") == "")
    distinct = urls.filter(~empty).groupBy("host", "path").agg(F.count("*").alias("_pages"))
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= BROADCAST_RULES and size["bytes"] <= BROADCAST_BYTES
    index = rule_index(distinct, rules).select(
        "token", F.struct("weight", "rule_no", "rule", "verdict", "pattern").alias("_r")
    )
    by_token = index.filter("token IS NOT NULL").groupBy("token").agg(F.collect_list("_r").alias("_rs"))
    always = index.filter("token IS NULL").groupBy().agg(F.collect_list("_r").alias("_rs")).collect()[0]["_rs"]

    text = F.concat("host", "path")
    toks = distinct.select("host", "path", "_pages", F.explode_outer(_tokens(text)).alias("token"))
    cand = toks.join(F.broadcast(by_token) if small else by_token, "token", "left")
    fits = F.filter("_rs", lambda r: F.regexp_like(text, r["pattern"]))
    tried = cand.select("host", "path", "_pages", F.coalesce(F.size("_rs"), F.lit(0)).alias("_n"), fits.alias("_fit"))
    top = lambda c: F.when(F.size(c) > 0, F.array_max(c))
    per = tried.groupBy("host", "path").agg(
        F.max(top("_fit")).alias("_best"), F.sum(F.greatest("_n", F.lit(0))).alias("n_tried"), F.max("_pages").alias("_pages")
    )
    if always:
        extra = F.array(*[
            F.when(text.rlike(r["pattern"]), F.struct(
                F.lit(r["weight"]).alias("weight"), F.lit(r["rule_no"]).alias("rule_no"),
                F.lit(r["rule"]).cast("string").alias("rule"), F.lit(r["verdict"]).alias("verdict"),
                F.lit(r["pattern"]).alias("pattern"),
            ))
            for r in always
        ])
        per = per.select(
            "host", "path", F.greatest("_best", F.array_max(extra)).alias("_best"),
            (F.col("n_tried") + len(always)).alias("n_tried"), "_pages",
        )
    none = urls.filter(empty).select("*", *[F.lit(None).cast(per.schema[c].dataType).alias(c) for c in ("_best", "n_tried")])
    limit = max(pages.count() // HOT_SHARE, 1)
    per = materialise(per, "urls")
    out = join_hot(urls.filter(~empty), per, ["host", "path"], F.col("_pages") > limit).drop("_pages").unionByName(none)
    fit = F.col("_best")
    return out.select(
        "page_id", "host", "path", fit["rule"].alias("rule"),
        F.when(F.col("host") == "", F.lit(default)).otherwise(F.coalesce(fit["verdict"], F.lit(default))).alias("verdict"),
        F.coalesce("n_tried", F.lit(0)).cast("long").alias("n_tried"),
    )


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r(verdict, h, pre) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT DISTINCT host, path, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
    FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND (
    regexp_matches(host || path, '^(?:[^/]*\.)?(spam-farm|cheap-pills|casino-win)\.')
    OR regexp_matches(host || path, '^(?:[^/]*\.)?adult-[^/.]*\.')
    OR regexp_matches(host || path, '/(?:login|signup)/') OR regexp_matches(host || path, '\.(?:exe|zip|iso)\z'))
    THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (host, path)
"""


def digest(judged: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return judged.select("page_id", "host", "path", "rule", "verdict")
