"""URL filters: weighted URL vocabulary counted by an Aho-Corasick automaton.

Hand-written host/path rules decide first (a rule fits its host and all subdomains when
the path starts with the rule's path; the longest rule wins).  Every other URL is judged
by the weighted vocabulary (``vocabulary``, a parameter): one automaton holds the strict and
soft terms; a hit counts only between boundaries (neither neighbour is an ASCII letter or
digit).  One strict hit blocks, as do two or more distinct soft terms whose weights add up
to ``soft_limit``.

Defined cases: a null URL has empty host and path and is allowed; one without ``://`` has
empty host and path and is judged by its terms; an empty host never meets a rule; very long
URLs are read whole in one pass; repeated rows are judged alike; an empty table gives an
empty result; columns of any name may be present (they are in the struct ``row``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the contract.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
STRICT, SOFT = vocabulary.read()
SOFT_LIMIT = 2.0


def build(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, terms in (("strict", strict), ("soft", soft)):
        for t in terms:
            auto.add_word(t, (kind, t))
    if len(auto):
        auto.make_automaton()
    return auto


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(auto: ahocorasick.Automaton, url: str) -> tuple[int, set[str]]:
    """Strict hits and the distinct soft terms of a URL (ASCII case folded)."""
    low = url.translate(_LOWER)
    strict, soft = 0, set()
    for end, (kind, term) in auto.iter(low) if len(auto) else ():
        start = end - len(term) + 1
        if (start and _word(low[start - 1])) or (end + 1 < len(low) and _word(low[end + 1])):
            continue
        if kind == "strict":
            strict += 1
        else:
            soft.add(term)
    return strict, soft


_LOWER = {c: c + 32 for c in range(65, 91)}


def host_path(url):
    """Host (A-Z lower-cased) and path as columns; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    host = F.translate(rest[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(rest[1], F.lit(""))


def rule_columns(host, path, rules=RULES):
    """(rule text, its verdict) of the longest fitting rule, as columns; null if none."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):  # the longest is outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit((r.host + r.path))).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT, soft_limit: float = SOFT_LIMIT, keep: tuple[str, ...] | None = None) -> DataFrame:
    """row (struct of the columns ``keep``, default: all), host, path, rule, verdict, strict_hits, soft_hits, soft_weight."""

    @F.pandas_udf("struct<strict_hits int, soft_hits int, soft_weight double>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = build(strict, soft)
        for urls in batches:
            found = [hits(auto, u or "") for u in urls]
            made = pd.DataFrame({"strict_hits": [s for s, _ in found], "soft_hits": [len(x) for _, x in found], "soft_weight": [float(sum(soft[t] for t in x)) for _, x in found]})
            yield made.astype({"strict_hits": "int32", "soft_hits": "int32", "soft_weight": "float64"})

    host, path = host_path(F.col(url_col))
    rows = pages.select(F.struct(*(pages.columns if keep is None else keep)).alias("row"), host.alias("host"), path.alias("path"), count(F.coalesce(F.col(url_col), F.lit(""))).alias("found"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("found.strict_hits") > 0) | ((F.col("found.soft_hits") > 1) & (F.col("found.soft_weight") >= soft_limit)), "block").otherwise("allow")
    return rows.select("row", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "found.strict_hits", "found.soft_hits", "found.soft_weight")
