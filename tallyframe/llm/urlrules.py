"""URL filters: rules indexed by their rarest literal token.

A rule is a pattern with the literal tokens that every URL it fits must have. It is
filed under the rarest of them, by counts over all URLs. The tokens of a URL fetch
its candidate rules, and only those run regular expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, settle, table, tidy

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """verdict for URLs (host and path) that `regex` fits from its start; among fitting rules the highest rank wins."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: tuple


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path starts with `path`. Longer rules rank higher, all above pattern rules."""
    tokens = TOKEN.findall(host)
    # A path that ends inside a token does not fix that token.
    inner = path if path.endswith("/") else path[: path.rfind("/") + 1]
    return Rule(host + path, verdict, r"(?:[^/?#]*\.)?" + re.escape(host) + re.escape(path), tuple(tokens + TOKEN.findall(inner.lower())), (1, len(host) + len(path), host + path))


_BORDER = r"(?:[^A-Za-z0-9.-]|\Z)"


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """`*` is any text, `^` one character that is no letter, digit, `-` or `.`, or the end; the pattern may fit anywhere.

    Literal tokens are the runs of letters and digits with a literal character at both sides, which no `*` or border can extend.
    """
    body = "".join(".*" if c == "*" else _BORDER if c == "^" else re.escape(c) for c in pattern)
    tokens = [m[0] for m in TOKEN.finditer(pattern) if 0 < m.start() and m.end() < len(pattern) and pattern[m.start() - 1] != "*" and pattern[m.end()] != "*"]
    return Rule(pattern, verdict, ".*?" + body, tuple(tokens), (0, len(pattern), pattern))


#: The rules of the query.
SITE_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The method's own rules, for URLs that no site rule fits: (verdict, pattern).
PATTERN_RULES = (
    ("block", ".spam-farm."),
    ("block", ".cheap-pills."),
    ("block", ".casino-"),
    ("block", "-casino."),
    ("block", ".casino*.*^bonus^"),
    ("block", ".free-download."),
    ("block", ".adult-"),
    ("block", ".torrent-"),
    ("block", "^xxx^"),
    ("block", "^porn^"),
    ("block", "/casino/"),
    ("block", "/pills/"),
    ("block", "/ads/"),
    ("block", "^ad*^banner*^"),
    ("block", "/banner/"),
    ("block", "/affiliate/"),
    ("block", "^aff_id=*^"),
    ("block", "/redirect/"),
    ("block", "^redirect*http"),
    ("block", "/wp-login."),
    ("block", "/wp-content/*/cache/"),
    ("block", "/wp-json^"),
    ("block", "/cgi-bin/"),
    ("block", "^phpmyadmin^"),
    ("block", "^login^"),
    ("block", "^signup^"),
    ("block", "^logout^"),
    ("block", "/cart^checkout^"),
    ("block", "/tag/*/feed^"),
    ("block", "/comment-page-*^"),
    ("block", "/search*^sort^"),
    ("block", "/calendar/*/print^"),
    ("allow", "/docs/*^login^"),  # longer than the rule it is an exception to
    ("allow", "/help/redirect/"),
    ("allow", "/reference/*/ads/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path): from the first ://; both empty without one."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split("[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


class RuleIndex:
    """Rules by their rarest token; rules without a token are always candidates."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            item = rule.rank, rule, re.compile(rule.regex, re.S)
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(item)
            else:
                self.always.append(item)

    def best(self, host: str, path: str) -> tuple[Rule | None, int]:
        """The highest fitting rule, and how many regular expressions were run."""
        url = f".{host}{path}"  # the dot lets a pattern start with the border of the host
        tokens = set(TOKEN.findall(url.lower()))
        found = list(self.always)
        for t in tokens:
            found += self.by_token.get(t, ())
        found.sort(key=lambda x: x[0], reverse=True)
        for n, (rank, rule, regex) in enumerate(found, 1):
            if regex.match(url, 0 if rank[0] == 0 else 1):
                return rule, n
        return None, len(found)


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of `tokens` (those of the rules, so at most as many rows come to the driver) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for u in b.column(0).to_pylist():
                host, path = split_url(u)
                total.update(tokens.intersection(TOKEN.findall((host + path).lower())))
        yield pa.RecordBatch.from_pydict({"token": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    counted = urls.select(F.col(f"`{url}`")).mapInArrow(tidy(run), "token string, n long")
    return {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def judge_urls(df: DataFrame, rules: tuple[Rule, ...], url: str = "url", *, keep: list[str] | None = None, block: int = 200_000) -> DataFrame:
    """Add host, path, rule (the name of the highest fitting rule, or null), verdict (its, else allow), n_regex (run for it).

    A null URL, or one without ://, has an empty host and path and is allowed. Result columns replace equal names, other
    columns (those in `keep`, or all) are kept; repeated rows are judged alike; among equal ranks the name decides. Each
    URL is judged in its own row, so hot hosts need no shuffle. More rules than `block` go in blocks, one pass of each
    over the settled rows, so a task never holds a larger index. Counts of tokens are over all URLs.
    """
    results = T.StructType.fromDDL("host string, path string, rule string, verdict string, n_regex int")
    address, place = free_name(df, "__url"), free_name(df, "__rank")
    results.add(place, T.IntegerType())
    names = {f.name.lower() for f in results}
    kept = [f.name for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    counts = token_counts(df, url, {t for r in rules for t in r.tokens})
    order = {r: i for i, r in enumerate(sorted(rules, key=lambda r: r.rank))}
    state = df.select(F.col(f"`{url}`").alias(address), *[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(0).alias("n_regex"), F.lit(-1).alias(place))
    for lo in range(0, max(1, len(rules)), block):
        part = rules[lo : lo + block]

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(part, counts)
            for b in batches:
                at = b.schema.get_field_index
                old = [b.column(at(c)).to_pylist() for c in ("rule", "verdict", "n_regex", place)]
                new: list[list] = [[] for _ in results]
                for u, rule, verdict, n, rank in zip(b.column(0).to_pylist(), *old, strict=True):
                    host, path = split_url(u)
                    best, ran = index.best(host, path) if u is not None and "://" in u else (None, 0)
                    if best and order[best] > rank:
                        rule, verdict, rank = best.name, best.verdict, order[best]
                    for c, x in zip(new, (host, path, rule, verdict, n + ran, rank), strict=True):
                        c.append(x)
                types = [pa.string()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(at(c)) for c in kept], *map(pa.array, new, types)], [address, *kept, *results.names])

        if lo:
            state = settle(state)
        fields = [T.StructField(address, T.StringType()), *[df.schema[c] for c in kept], *results]
        state = state.mapInArrow(tidy(run), T.StructType(fields))
    return state.drop(address, place)


def query_rules() -> tuple[Rule, ...]:
    return tuple(site_rule(*r) for r in SITE_RULES) + tuple(pattern_rule(*p) for p in PATTERN_RULES)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"), query_rules(), keep=["page_id"])
    own = {p for _, p in PATTERN_RULES}
    return out.select("page_id", "host", "path", F.when(F.col("rule").isin(*own), None).otherwise(F.col("rule")).alias("rule"), "verdict")


def _sql() -> str:
    """The query as DuckDB SQL: the same rules, each tried on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rest = "regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0)"
    has = "url IS NOT NULL AND strpos(url, '://') > 0"
    site = sorted((site_rule(*r) for r in SITE_RULES), key=lambda r: r.rank, reverse=True)
    rule = " ".join(f"WHEN (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)}) THEN {q(h + p)}" for h, p in ((r.name.partition("/")[0], "/" + r.name.partition("/")[2]) for r in site))
    verdict = " ".join(f"WHEN {q(r.name)} THEN {q(r.verdict)}" for r in site)
    mine = sorted((pattern_rule(*p) for p in PATTERN_RULES), key=lambda r: r.rank, reverse=True)
    own = " ".join(f"WHEN regexp_matches('.' || host || path, {q(r.regex.removeprefix('.*?').replace(chr(92) + 'Z', chr(92) + 'z').replace(chr(92) + '-', '-'))}, 's') THEN {q(r.verdict)}" for r in mine)
    return f"""WITH u AS (SELECT page_id, CASE WHEN {has} THEN {rest} ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE {own} ELSE 'allow' END END AS verdict FROM r"""


OP7_SQL = _sql()
