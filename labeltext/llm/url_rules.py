"""URL filtering by given rules and by association rules mined with FP-growth.

A rule of host and path decides the urls it fits, the longest that fits first.
Those urls are the labels for the rest: each becomes a set of at most eight typed
tokens (scheme, top-level domain, domain, host, first path segment, extension,
query names, shape of the path), and Spark's FP-growth finds the token sets that
are frequent together with a verdict. A set whose share of one verdict reaches
the confidence becomes a rule, unless a smaller set of its tokens says the same
as surely. Rules are matched by an inverted index from token to rules: a rule
fires when all its tokens were hit; the surest firing rule decides, then the more
frequent, then the smaller, then by name.

Bounds: a url adds to 2^9 sets at most and a set needs ``support`` of all labelled
urls, so at most 2^9 / support sets are frequent, however large the table. Only
these rules, never urls, reach the driver and the tasks.

Defined cases: a null url, or one without "://", has an empty host and path and no
tokens; a url that no rule and no mined rule fits gets the default verdict; no
labelled urls give no mined rules; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT, CONFIDENCE = 0.005, 0.8
VERDICT = "verdict="


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TokenRule:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    count: int

    @property
    def rank(self) -> tuple:
        return (-self.confidence, -self.count, len(self.tokens), sorted(self.tokens), self.verdict)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_rule(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        one = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits(rule, host, path), one).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """At most eight typed tokens of a url that has a host."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)))), "&")
    shape = F.regexp_replace(F.regexp_replace(path, r"[0-9]+", "0"), r"[^0/.]+", "a")
    first = F.try_element_at(segments, F.lit(1))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    typed = {
        "scheme": F.lower(F.substring_index(url, "://", 1)),
        "tld": F.element_at(labels, -1),
        "domain": F.array_join(F.slice(F.reverse(labels), 1, 2), "."),
        "host": host,
        "first": first,
        "extension": extension,
        "query": names,
        "shape": shape,
    }
    all_ = F.array(*[F.when(value != "", F.concat(F.lit(f"{name}="), value)) for name, value in typed.items()])
    return F.when(host != "", F.array_compact(all_)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[TokenRule]:
    """Pruned rules from ``labelled(tokens, verdict)``."""
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(VERDICT), F.col("verdict"))).alias("items"))
    if baskets.isEmpty():
        return []
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    counts = {frozenset(r["items"]): r["freq"] for r in sets.collect()}  # at most 2^9 / support
    rules = []
    for items, count in counts.items():
        verdicts = [i for i in items if i.startswith(VERDICT)]
        rest = items - set(verdicts)
        if len(verdicts) == 1 and rest:
            share = count / counts[rest]
            if share >= confidence:
                rules.append(TokenRule(rest, verdicts[0].removeprefix(VERDICT), share, count))
    return pruned(rules)


def pruned(rules: list[TokenRule]) -> list[TokenRule]:
    """Rules that no smaller kept rule of the same verdict makes superfluous."""
    kept: list[TokenRule] = []
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.rank)):
        if not any(k.tokens < rule.tokens and k.verdict == rule.verdict and k.confidence >= rule.confidence for k in kept):
            kept.append(rule)
    return sorted(kept, key=lambda r: r.rank)


class RuleIndex:
    """Finds the first rule, in rank order, whose tokens all occur."""

    def __init__(self, rules: list[TokenRule], default: str):
        self.rules, self.default = rules, default
        self.of_token: dict[str, list[int]] = {}
        for number, rule in enumerate(rules):
            for token in rule.tokens:
                self.of_token.setdefault(token, []).append(number)
        self.known: dict[tuple, str] = {}

    def verdict(self, tokens: tuple[str, ...]) -> str:
        relevant = tuple(t for t in tokens if t in self.of_token)
        found = self.known.get(relevant)
        if found is None:
            hits = Counter(n for t in set(relevant) for n in self.of_token[t])
            fired = [n for n, k in hits.items() if k == len(self.rules[n].tokens)]
            found = self.rules[min(fired)].verdict if fired else self.default
            if len(self.known) < 100_000:
                self.known[relevant] = found
        return found


def mined_verdict(tokens: Column, rules: list[TokenRule], default: str) -> Column:
    index = RuleIndex(rules, default)

    @F.arrow_udf("string")
    def judged(lists: pa.Array) -> pa.Array:
        return pa.array([index.verdict(tuple(x or ())) for x in lists.to_pylist()], pa.string())

    return judged(tokens)


def judge(
    pages: DataFrame,
    rules: list[UrlRule],
    default: str = "allow",
    key: str = "page_id",
    url: str = "url",
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``(key, host, path, rule, verdict)`` of every row."""
    parts = pages.select(F.col(key).alias("key"), F.coalesce(url, F.lit("")).alias("url"))
    parts = parts.select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = parts.select(
        "key", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
        first_rule(rules, F.col("host"), F.col("path")).alias("found"),
    )
    labelled = seen.where(F.col("found").isNotNull() & (F.size("tokens") > 0)).select("tokens", "found.verdict")
    mined = mine(labelled, support, confidence)
    verdict = F.coalesce("found.verdict", mined_verdict(F.col("tokens"), mined, default))
    return seen.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def rules_of(lines: list[str]) -> list[UrlRule]:
    """Rules from lines such as ``block example.com/en/``."""
    split = (line.split(" ", 1) for line in lines)
    return [UrlRule(verdict, name.partition("/")[0].lower(), "/" + name.partition("/")[2]) for verdict, name in split]

