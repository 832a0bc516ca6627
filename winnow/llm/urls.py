"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule is (host, path, verdict). It fits its host and all subdomains of it when the URL's path
starts with the rule's path; of those that fit, the longest rule wins. Where none fits, the
automaton runs over the whole lower-case URL. A hit counts when no letter or digit stands next to it.
One strict term, or `soft_limit` different soft terms, block the URL.

A URL that is null or has no `://` has an empty host and path, so no rule fits; null and empty URLs
have no terms and are allowed, others are still read for terms. Length is not limited: the automaton
is linear. Repeated rows get a row each, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import lower_ascii

# The rules that the query applies.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

STRICT = ("adult", "casino", "escort", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bets", "cheap", "click", "crack", "deals", "free", "loans", "pills", "poker", "prize", "promo", "sexy", "track", "win")
SOFT_LIMIT = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def winning_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct of the longest rule that fits, or null. Rules are a short list, written into the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(
            found
        )
    return found


class Vocabulary:
    """Counts of terms that stand on their own in a URL."""

    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("strict", strict), ("soft", soft)):
            for term in terms:
                self.automaton.add_word(term, (term, kind))
        self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int]:
        """Number of strict hits, and of different soft terms."""
        text = (url or "").lower()
        strict, soft = 0, set()
        for end, (term, kind) in self.automaton.iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if kind == "strict":
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)


def filter_urls(
    pages: DataFrame,
    *,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    url_col: str = "url",
) -> DataFrame:
    """Rows of `pages` with host, path, rule, n_strict, n_soft and verdict added; a map, no shuffle."""
    names = ["host", "path", "rule", "n_strict", "n_soft", "verdict"]
    keep = [c for c in pages.columns if c not in names]

    @F.pandas_udf("struct<n_strict:int,n_soft:int>")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(strict, soft)
        for part in urls:
            yield pd.DataFrame([vocabulary.hits(u) for u in part], columns=["n_strict", "n_soft"])

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"), count(F.col(url_col)).alias("_hits"))
    rows = rows.withColumn("_rule", winning_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("_hits.n_strict") > 0) | (F.col("_hits.n_soft") >= soft_limit)
    method = F.when(bad, "block").otherwise("allow")
    return rows.select(
        *keep,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.col("_hits.n_strict").alias("n_strict"),
        F.col("_hits.n_soft").alias("n_soft"),
        F.coalesce(F.col("_rule.verdict"), method).alias("verdict"),
    )


def url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url")).drop("url")
