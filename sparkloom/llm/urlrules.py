"""URL filters: pattern rules indexed by their rarest literal token, as DataFrame functions only.

Every rule has a regular expression on host || path and the literal tokens that each matching URL holds. A rule is filed
under the token that is rarest among the URLs, one without tokens under the empty token. A URL's tokens fetch the rules
filed under them, and only those rules run their expression. Up to LITERAL rules the index is a literal map in the plan,
and URLs are judged without a shuffle, whatever their host; larger rule sets are a table that different URLs are
joined to by token, each rule under one token only.

Rules are given as objects or as the lines of a filter list (parse_list). Of the rules that fit a URL the one with the greatest
weight decides, equal weights by pattern; without one the default verdict holds. Null URLs and those without ``://`` have
an empty host and path and fit no rule but those that fit everything. Hosts are compared with A-Z lower-cased, paths as they are.
Rows are independent; repeated rows stay, ids may be null, empty tables give empty results, and very long URLs are judged
whole. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``name`` is null for rules of the method itself; ``weight`` decides between fitting rules, the greatest wins."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int
    name: str | None = None


def tokens_of(literal: str) -> tuple[str, ...]:
    return tuple(t for t in re.split("[^a-z0-9]+", literal.lower()) if t)


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and all its subdomains where the URL's path starts with ``path``; the longest rule wins."""
    whole = host + path
    # Only tokens that end inside the literal are whole tokens of every URL that fits.
    sure = tokens_of(re.sub("[A-Za-z0-9]+$", "", whole))
    return Rule(r"^(?:[^/]*\.)?" + re.escape(whole).replace("/", "/"), sure or tokens_of(host), verdict, 1000 + len(whole), whole)


def wild_rule(pattern: str, verdict: str = "block", weight: int = 2) -> Rule:
    """Fits URLs whose host || path is ``pattern``, where ``*`` stands for any characters; without ``*`` at an end it may go on there."""
    body = ".*".join(map(re.escape, pattern.split("*")))
    # A token that touches an end or a star may go on in the URL.
    sure = [t for part in re.split(r"\*", pattern) for t in tokens_of(re.sub(r"^[A-Za-z0-9]+|[A-Za-z0-9]+$", "", part))]
    return Rule(body, tuple(sure), verdict, weight)


def parse_list(lines: str) -> list[Rule]:
    """Rules of a filter list, one a line: ``||host/path`` for a host, its subdomains and paths, ``.label.`` for a label of a host, any other
    line as a pattern with ``*``; ``@@`` in front allows instead of blocking. Empty lines and those that start with ``!`` are passed."""
    out = []
    for line in map(str.strip, lines.splitlines()):
        if not line or line.startswith("!"):
            continue
        verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        if body.startswith("||"):
            host, slash, path = body[2:].partition("/")
            out.append(host_rule(host.lower(), slash + path, verdict))
        elif re.fullmatch(r"\.[^./*]+\.", body):
            out.append(label_rule(body[1:-1].lower(), verdict))
        else:
            out.append(wild_rule(body, verdict, 3 if verdict == "allow" else 2))
    return out


def label_rule(label: str, verdict: str = "block") -> Rule:
    """Fits hosts of which ``label`` is one whole label."""
    return Rule(r"^(?:[^/]*\.)?" + re.escape(label) + r"(?:\.|:|/|$)", tokens_of(label), verdict, 1)


#: The rules of the query, then a block list for hosts that they leave open.
HOST_RULES = parse_list("""
||net/
@@||example.net/en/
||example.com/de/
@@||org/fr/
""")
LABEL_RULES = parse_list("""
.spam-farm.
.cheap-pills.
.casino-win.
.free-bets.
.adult-x.
""")
#: Rules that are a literal of the plan at most.
LITERAL = 1_000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.translate(target, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"))


def rarest_index(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under the literal token that the fewest URLs hold (ties: the smaller token); one row per token of a rule comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = urls.select(F.explode(url_tokens(F.concat("host", "path"))).alias("token")).where(F.col("token").isin(wanted))
    count = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t), default=""), []).append(r)
    return index


def _by_literal(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` with the best fitting rule, from an index that is part of the plan."""
    index = rarest_index(urls, rules)

    def literal(r: Rule) -> Column:
        return F.struct(F.lit(r.weight).alias("weight"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).cast("string").alias("name"))

    filed = F.create_map(*(x for t, own in sorted(index.items()) for x in (F.lit(t), F.array(*map(literal, own)))))
    target = F.concat("host", "path")
    tokens = F.array_union(url_tokens(target), F.array(F.lit("")))
    fetched = F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(sorted(index))), lambda t: F.element_at(filed, t)))
    return urls.withColumn("best", F.array_max(F.filter(fetched, lambda r: F.rlike(target, r["pattern"]))))


def _by_table(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """As _by_literal(), with the rules as a table: different URLs meet the rules of their tokens in a join."""
    spark = urls.sparkSession
    rows = [(i, r.weight, r.pattern, r.verdict, r.name, list(r.tokens) or [""]) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule long, weight int, pattern string, verdict string, name string, tokens array<string>")
    targets = urls.select(F.concat("host", "path").alias("target")).distinct()
    held = targets.select("target", F.explode(F.array_union(url_tokens(F.col("target")), F.array(F.lit("")))).alias("token"))
    count = held.groupBy("token").agg(F.count("*").alias("n"))
    choice = table.select("rule", F.explode("tokens").alias("token")).join(count, "token", "left")
    filed = choice.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")).join(table.drop("tokens"), "rule")
    fits = held.join(filed, "token").where(F.rlike("target", F.col("pattern")))
    best = fits.groupBy("target").agg(F.max(F.struct("weight", "pattern", "verdict", "name")).alias("best"))
    return urls.withColumn("target", F.concat("host", "path")).join(best, "target", "left").drop("target")


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    rules = [*HOST_RULES, *LABEL_RULES] if rules is None else rules
    # In one struct: the optimizer then extracts host and path once.
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = (_by_literal if len(rules) <= LITERAL else _by_table)(urls, rules)
    return judged.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: DuckDB SQL for the rows of judge_urls with the rules above.
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '^(.*\.)?(spam-farm|cheap-pills|casino-win|free-bets|adult-x)([.:]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
