"""URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression.  A literal run of letters and digits that any
match must hold as a whole token of the URL is a token of the rule; among a rule's
tokens the one rarest in all URLs becomes its index entry.  The tokens of a URL fetch
the rules filed under them, and only those run.  A rule without such a token runs on
every URL.  The index travels with the tasks as long as it is short; a longer list of
rules is a table that joins the URLs on the token.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import staged

TOKEN = r"[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules travel to the executors with the tasks; a longer list is joined as a table.
TRAVEL = 50_000

# Rules by host and path start.
PLACES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Names that stand as a whole label or path segment of an address that is blocked,
NAMES = (
    "adult", "betting", "bingo", "camgirls", "casino", "cheap-pills", "cheap-viagra", "cialis", "crackz", "cryptogiveaway",
    "escort", "escorts", "fake-watches", "free-money", "freeslots", "gambling", "get-rich", "hentai", "keygen", "link-farm",
    "live-sex", "malware", "nude", "onlinecasino", "payday-loans", "phishing", "poker", "porn", "porno", "replica-watches",
    "roulette", "sexcam", "slots", "spam-farm", "sportsbook", "torrentz", "viagra", "warez", "xxx", "xxxvideos",
)
#: and paths that hold no text worth keeping.
PAGES = (
    r"/wp-login\.", r"/wp-admin/", r"/xmlrpc\.", r"/cgi-bin/", r"/phpmyadmin/",
    r"/(ads|adserver|doubleclick)/", r"/(login|signin|signup|logout|register)/?$", r"/(cart|checkout|basket)/?$", r"/search/?$", r"/(unsubscribe|tracking|pixel)/",
)
#: Patterns that block, read against host and path; all else is allowed.
PATTERNS = tuple(rf"(^|[./-]){name}[./-]" for name in NAMES) + PAGES


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    name: str | None = None
    #: Among named rules that fit, the longest name wins; patterns come after all of them.
    length: int = 0


def place_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains, where the path starts with ``path``."""
    return Rule(verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", host + path, len(host + path))


DEFAULT = tuple(place_rule(*p) for p in PLACES) + tuple(Rule("block", p) for p in PATTERNS)


def literal_tokens(pattern: str) -> set[str]:
    """Tokens every match of the pattern holds whole: runs bounded on both sides by what is no token."""
    import re._constants as c
    import re._parser as parser

    word = set(UPPER + LOWER + "0123456789")
    tokens, run, open_left = set(), "", False

    def apart(node) -> bool:
        """Whether this node ends in a place where a token can't go on."""
        op, arg = node
        if op is c.AT:
            return arg in (c.AT_BEGINNING, c.AT_BEGINNING_STRING, c.AT_END, c.AT_END_STRING)
        if op is c.LITERAL:
            return chr(arg) not in word
        if op is c.IN:
            return all(k is c.LITERAL and chr(v) not in word for k, v in arg)
        if op is c.SUBPATTERN:
            return bool(arg[-1]) and apart(arg[-1][-1]) if len(arg[-1]) == 1 else False
        if op is c.BRANCH:
            return all(len(b) == 1 and apart(b[-1]) for b in arg[1])
        return False

    nodes = list(parser.parse(pattern))
    bounded = False  # whether what stands before the run ends a token
    for i, node in enumerate([*nodes, (c.AT, None)]):
        op, arg = node
        if op is c.LITERAL and chr(arg) in word:
            if not run:
                open_left = not bounded
            run += chr(arg)
            continue
        if run:
            if i < len(nodes) and apart(node) and not open_left:
                tokens.add(run.lower())
            run = ""
        if op is c.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is c.SUBPATTERN:
            # an optional group: both what stands before it and its own end must end a token
            bounded = bounded and bool(arg[2][0][1][-1]) and apart(arg[2][0][1][-1][-1])
        else:
            bounded = apart(node)
    return tokens


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def token_counts(places: DataFrame, tokens: set[str], travel: int = TRAVEL) -> dict[str, int]:
    """How often each of the rules' tokens occurs in all URLs (a row for each rule token at most)."""
    if not tokens:
        return {}
    each = places.select(F.explode(F.regexp_extract_all(F.translate(F.concat("host", "path"), UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1))).alias("token"))
    if len(tokens) <= travel:
        wanted = each.filter(F.col("token").isin(sorted(tokens)))
    else:
        wanted = each.join(places.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string"), "token", "left_semi")
    return {r["token"]: r["count"] for r in wanted.groupBy("token").count().collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    index, rest = defaultdict(list), []
    for rule in rules:
        tokens = literal_tokens(rule.pattern)
        if tokens:
            index[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
        else:
            rest.append(rule)
    return dict(index), rest


@lru_cache(maxsize=None)
def compiled(pattern: str) -> re.Pattern:
    """Once for each worker: the standard library's own cache holds a few hundred patterns."""
    return re.compile(pattern)


def tokens_of(place: str) -> set[str]:
    return set(re.findall(TOKEN, place.translate(str.maketrans(UPPER, LOWER))))


def fitting(place: str, rules: list[Rule]) -> tuple[int, str | None, str | None, bool]:
    """Of the rules that fit: the length, name and verdict of the longest named one, and whether a pattern blocks."""
    fits = [r for r in rules if compiled(r.pattern).search(place)]
    named = max((r for r in fits if r.name), key=lambda r: (r.length, r.name), default=None)
    blocks = any(r.verdict == "block" for r in fits if not r.name)
    return (named.length, named.name, named.verdict, blocks) if named else (-1, None, None, blocks)


def judge_place(host: str, path: str, index: dict[str, list[Rule]], rest: list[Rule]) -> tuple[str | None, str]:
    place = host + path
    fetched = list(rest)
    for token in tokens_of(place):
        fetched += index.get(token, ())
    _, name, verdict, blocks = fitting(place, fetched)
    return name, verdict or ("block" if blocks else "allow")


def _judge(index, rest):
    def run(batches):
        for batch in batches:
            found = [judge_place(h, p, index, rest) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


FITS = "row long, length int, name string, verdict string, blocks boolean"


def _fits(rules_of):
    """(row, length, name, verdict, blocks) of batches with row and place; ``rules_of`` gives each row's rules."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [(r["row"], *fitting(r["place"], rules_of(r))) for r in rows]
            columns = list(zip(*found)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["row", "length", "name", "verdict", "blocks"])

    return run


def _judge_by_table(places: DataFrame, index: dict[str, list[Rule]], rest: list[Rule], travel: int) -> DataFrame:
    """The same for any number of rules: indexed ones join on their token, the others run in blocks."""
    numbered = staged(places.withColumn("row", F.monotonically_increasing_id()), "places")
    at = numbered.select("row", F.concat("host", "path").alias("place"))
    spark = places.sparkSession
    filed = [(token, r.verdict, r.pattern, r.name, r.length) for token, rules in index.items() for r in rules]
    table = spark.createDataFrame(filed, "token string, rule_verdict string, pattern string, rule_name string, rule_length int")
    words = F.array_distinct(F.regexp_extract_all(F.translate("place", UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1)))
    fetched = at.withColumn("token", F.explode(words)).join(table, "token").drop("token")
    one = lambda r: [Rule(r["rule_verdict"], r["pattern"], r["rule_name"], r["rule_length"])]
    fits = fetched.mapInArrow(_fits(one), FITS)
    for start in range(0, len(rest), travel):
        block = rest[start : start + travel]
        fits = fits.unionByName(at.mapInArrow(_fits(lambda r, block=block: block), FITS))
    fits = fits.filter("blocks OR name IS NOT NULL")
    best = fits.groupBy("row").agg(F.max(F.when(F.col("name").isNotNull(), F.struct("length", "name", "verdict"))).alias("best"), F.max("blocks").alias("blocks"))
    verdict = F.coalesce("best.verdict", F.when(F.col("blocks"), "block").otherwise("allow"))
    return numbered.join(best, "row", "left").select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT, *, travel: int = TRAVEL) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict.

    Needs page_id and url; other columns are ignored.  A url that is null or holds no
    ``://`` has an empty host and path, so no named rule fits it and it is allowed
    unless a pattern fits the empty string.  Equal rows give equal rows; an empty
    table gives none.  More than ``travel`` rules are joined as a table.
    """
    places = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = set().union(*[literal_tokens(r.pattern) for r in rules]) if rules else set()
    index, rest = build_index(rules, token_counts(places, tokens, travel))
    if len(rules) > travel:
        return _judge_by_table(places, index, rest, travel)
    kind = pages.schema["page_id"].dataType.simpleString()
    return places.mapInArrow(_judge(index, rest), f"page_id {kind}, host string, path string, rule string, verdict string")
