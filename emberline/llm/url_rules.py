"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path``. The literal tokens that a
matching URL must hold are read off the expression, each of its alternatives for itself; they are
counted over the whole URL column, and each alternative is filed
under the rarest of its own (one without any under the empty token, which every URL
has). The distinct tokens of a URL fetch its candidate rules by an equi-join, and
only those run their expressions. The longest host rule wins; without one, a pattern
rule that fits blocks; else the URL is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased;
path: then up to ``?``, ``#`` or end; a null URL or one without ``://`` has both
empty and is allowed. Each distinct URL is judged once and joined back, so repeated
rows give one row each and a hot URL is a row of a join that Spark may split.
Only DataFrame functions are used. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The host rules of the production query.
HOST_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "example.net/de/8"), ("allow", "net/de/"), ("block", "org/es/"))
#: Pattern rules of the production query; each blocks.
PATTERN_RULES = (r"(^|[.])casino-win[.]", r"(^|[.])cheap-pills[.]", r"(^|[.])spam-farm[.]", r"/(wp-admin|phpmyadmin)/", r"/checkout/session/[0-9a-f]{16,}")
#: Alternatives that an expression is split into at most; beyond, it is filed under the empty token.
ALTERNATIVES = 64
ALNUM = frozenset(string.ascii_lowercase + string.digits)
#: What an expression's parts are to its tokens: a sign that is in none, and anything.
EDGE, ANY = "\0edge", "\0any"


def alternatives(pattern: str) -> list[tuple[str, ...]]:
    """Of each alternative of an expression, the tokens (runs of a-z, 0-9) that any subject that fits holds whole."""

    def product(heads, tails):
        out = [h + t for h in heads for t in tails]
        return out if len(out) <= ALTERNATIVES else [[ANY]]

    parsed = parser.parse(pattern)
    lower = bool(parsed.state.flags & re.IGNORECASE)

    def walk(tree) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for op, arg in tree:
            if op is parser.LITERAL:
                c = chr(arg).lower() if lower else chr(arg)
                part = [[c if c in ALNUM else EDGE]]
            elif op is parser.AT:
                part = [[EDGE if arg in (parser.AT_BEGINNING, parser.AT_BEGINNING_STRING, parser.AT_END, parser.AT_END_STRING) else ANY]]
            elif op is parser.IN:
                part = [[EDGE if all(kind is parser.LITERAL and chr(c) not in ALNUM for kind, c in arg) else ANY]]
            elif op is parser.BRANCH:
                part = [p for branch in arg[1] for p in walk(branch)]
            elif op is parser.SUBPATTERN:
                part = walk(arg[3])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):  # the last time around, after any others
                low, high, again = arg
                part = [[ANY] * (high != 1) + p for p in walk(again)] + [[]] * (low == 0)
            else:
                part = [[ANY]]
            out = product(out, part)
            if out == [[ANY]]:
                return out
        return out

    # subjects begin and end like tokens do, but an expression may fit inside one
    found = []
    for parts in walk(parsed):
        text = "".join(" " if p == EDGE else "?" if p == ANY else p for p in ["?", *parts, "?"] if p)
        found.append(tuple(dict.fromkeys(re.findall(r"(?<=\s)[a-z0-9]+(?=\s)", text))))
    return list(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    """The longest rule wins; ``rank`` says how long one is."""

    rule: str | None
    pattern: str
    verdict: str
    rank: int

    @property
    def tokens(self) -> list[tuple[str, ...]]:
        return alternatives(self.pattern)


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: it fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    pattern = f"^([^/]*[.])?{re.escape(host)}{re.escape(slash + path)}" if slash else f"^([^/]*[.])?{re.escape(host)}(/|$)"
    return Rule(rule, pattern.replace("\\-", "-"), verdict, 1_000_000 + len(rule))


def production_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [Rule(None, p, "block", 1) for p in PATTERN_RULES]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(subject: Column) -> Column:
    return F.array_union(F.array_distinct(F.regexp_extract_all(subject, F.lit("([a-z0-9]+)"), F.lit(1))), F.array(F.lit("")))


def rule_table(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules filed under the rarest token of each alternative; ``urls``: subject and tokens of each distinct URL.

    Only tokens that rules hold are counted, over all URLs.
    """
    spark = urls.sparkSession
    rows = [(n, r.rule, r.pattern, r.verdict, r.rank) for n, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "n int, rule string, pattern string, verdict string, rank int")
    own = [(n, k, list(tokens) or [""]) for n, r in enumerate(rules) for k, tokens in enumerate(r.tokens)]
    wanted = spark.createDataFrame(own, "n int, k int, tokens array<string>").select("n", "k", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = wanted.join(seen, "token", "left").groupBy("n", "k").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("least"))
    return table.join(rarest.select("n", F.col("least.token").alias("token")).distinct(), "n")


def judge(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Of each row: id, host, path, rule and verdict."""
    rules = production_rules() if rules is None else rules
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    subject = F.concat(F.col("host"), F.translate(F.col("path"), UPPER, LOWER))
    urls = rows.where(F.col("url").isNotNull()).select("url").distinct().withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    urls = urls.select("url", F.concat("host", "path").alias("subject"), tokens(subject).alias("tokens"))
    index = rule_table(urls, rules)
    fitting = urls.select("url", "subject", F.explode("tokens").alias("token")).join(index, "token").where(F.expr("regexp_like(subject, pattern)"))
    best = fitting.groupBy("url").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    out = rows.join(best, "url", "left")
    return out.select(
        F.col("id").alias(id_col), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


def oracle(rules: list[Rule] | None = None) -> str:
    """DuckDB SQL that runs every rule on every URL."""
    rules = production_rules() if rules is None else rules
    quoted = lambda s: "NULL::VARCHAR" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quoted(r.rule)}, {quoted(r.pattern)}, {quoted(r.verdict)}, {r.rank})" for n, r in enumerate(rules))
    return f"""
WITH parsed AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(n, rule, pattern, verdict, rank) AS (VALUES {values}),
best AS (
  SELECT u.url, arg_max(struct_pack(rule := r.rule, verdict := r.verdict), r.rank) AS b
  FROM (SELECT DISTINCT url, host || path AS subject FROM parsed WHERE url IS NOT NULL) u JOIN rules r ON regexp_matches(u.subject, r.pattern)
  GROUP BY u.url)
SELECT p.page_id, p.host, p.path, b.b.rule AS rule, coalesce(b.b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.url = b.url
"""
