"""URL filters: pattern rules found by their rarest literal token.

A rule is a glob over the lower-cased url (``*`` any run). Its literal tokens are the alphanumeric runs that
stand between two non-alphanumeric characters in the pattern, so every url the rule matches has them as whole
tokens. Token frequencies are counted over the urls; each rule is filed under its rarest token; a url's
distinct tokens fetch candidate rules by an equi-join, and only those run their regular expression. Rules
without a literal token are filed under the empty token, which every url carries.

Host rules (host suffix, path prefix, verdict) take part the same way and win over pattern rules; among host
rules the longest wins. Everything is DataFrame functions; the rules are a parameter, so their index is
broadcast up to ``MAX_BROADCAST`` rules and joined by shuffle beyond.

Defined cases: null url or no ``://``: empty host and path, no rule, verdict ``allow``. Equal urls get equal
verdicts; rules are matched once per distinct url. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm.common import register

MAX_BROADCAST = 50_000
DEFAULT = "allow"


class Rule(NamedTuple):
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # among the rules that match, the highest rank wins
    host_rule: bool


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``; the longest rule wins. The expression
    runs over host, ``?`` and path: neither part can hold a question mark."""
    inner = path.split("/")[1:-1]  # the last piece may go on, so it is no whole token
    tokens = [t for t in re.split("[^a-z0-9]+", host) if t] + [p for p in inner if re.fullmatch("[a-z0-9]+", p)]
    return Rule(host + path, verdict, rf"(?s)^(?:.*\.)?{re.escape(host)}\?{re.escape(path)}", tuple(tokens), 1_000_000 + len(host + path), True)


def glob_rule(pattern: str, verdict: str, rank: int) -> Rule:
    """A glob over the lower-cased whole url."""
    tokens = [m[1] for m in re.finditer(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])", pattern) if 0 < m.start() and m.end() < len(pattern)]
    return Rule(pattern, verdict, "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$", tuple(tokens), rank, False)


HOST_RULES = (host_rule("org", "/", "allow"), host_rule("example.org", "/es/", "block"), host_rule("example.org", "/en/1", "block"),
              host_rule("com", "/fr/", "allow"), host_rule("com", "/de/", "block"))
PATTERN_RULES = tuple(glob_rule(p, v, -i) for i, (p, v) in enumerate((
    ("*://spam-farm.*", "block"), ("*.spam-farm.*", "block"), ("*://cheap-pills.*", "block"), ("*.cheap-pills.*", "block"),
    ("*://casino.*", "block"), ("*.casino.*", "block"), ("*-casino.*", "block"), ("*://adult.*", "block"), ("*.adult.*", "block"),
    ("*/viagra/*", "block"), ("*/torrent/*", "block"), ("*?sessionid=*", "block"), ("*&sessionid=*", "block"))))


def with_host_path(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: on to ``?``, ``#`` or the end."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (pages.select(*keep, F.coalesce(rest, F.lit("")).alias("rest"))
            .select(*keep, F.translate(host, upper, lower).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")))


def url_tokens(urls: DataFrame) -> DataFrame:
    """Adds ``tokens``: the distinct alphanumeric runs of host and lower-cased url, and the empty token."""
    runs = F.split(F.concat_ws("/", "host", F.lower("url")), "[^a-z0-9]+")
    return urls.withColumn("tokens", F.array_distinct(F.concat(F.array(F.lit("")), runs)))


def rule_index(spark: SparkSession, tokens: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, name, verdict, regex, rank, host_rule): every rule once, under its rarest token."""
    schema = "name string, verdict string, regex string, rank long, host_rule boolean, token string"
    long = spark.createDataFrame([(r.name, r.verdict, r.regex, r.rank, r.host_rule, t) for r in rules for t in (r.tokens or ("",))], schema)
    small = len(rules) <= MAX_BROADCAST
    wanted = long.select("token").distinct()
    seen = tokens.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = F.min_by(F.col("token"), F.struct(F.coalesce(F.col("df"), F.lit(0)), F.col("token"))).alias("token")
    index = long.join(seen, "token", "left").groupBy("name", "verdict", "regex", "rank", "host_rule").agg(rarest)
    return F.broadcast(index) if small else index


def judge(pages: DataFrame, host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) of every page."""
    spark = pages.sparkSession
    rows = with_host_path(pages.select("page_id", F.col("url").cast("string").alias("url")), ["page_id", "url"])
    urls = url_tokens(rows.where("host != ''").select("url", "host", "path").distinct())
    index = rule_index(spark, urls, host_rules + pattern_rules)
    found = (urls.select("url", "host", "path", F.explode("tokens").alias("token")).join(index, "token")
             .where(F.when(F.col("host_rule"), F.expr("rlike(concat(host, '?', path), regex)")).otherwise(F.expr("rlike(lower(url), regex)"))))
    best = found.groupBy("url").agg(F.max(F.struct("rank", "name", "verdict", "host_rule")).alias("hit")).withColumnRenamed("url", "u")
    name = lambda of_host: F.when(F.col("hit.host_rule") == of_host, F.col("hit.name"))
    return (rows.join(best, F.col("url") == F.col("u"), "left")
            .select("page_id", "host", "path", name(True).alias("rule"), F.coalesce("hit.verdict", F.lit(DEFAULT)).alias("verdict"), name(False).alias("pattern_rule")))


def _oracle() -> str:
    """Brute force: every rule's test on every url, the longest host rule first, then the first pattern."""
    hosts = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in (r.name.partition("/")[0:1] + ("/" + r.name.partition("/")[2], r.verdict) for r in HOST_RULES))
    globs = " UNION ALL ".join(f"SELECT '{r.name}' AS g, '{r.verdict}' AS v, {r.rank} AS k" for r in PATTERN_RULES)
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
hr AS ({hosts}), pr AS ({globs}),
x AS (SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT url, host, path FROM a WHERE host != '') JOIN hr ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
y AS (SELECT url, arg_max(g, k) AS g, arg_max(v, k) AS v FROM (SELECT DISTINCT url FROM a WHERE host != '') JOIN pr ON lower(url) GLOB replace(g, '?', '[?]') GROUP BY url)
SELECT page_id, host, path, rule, coalesce(x.v, y.v, 'allow') AS verdict, CASE WHEN rule IS NULL THEN y.g END AS pattern_rule FROM a LEFT JOIN x USING (url) LEFT JOIN y USING (url)
"""


@register("op3_url_filters", _oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url under the host rules, then the pattern rules."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
