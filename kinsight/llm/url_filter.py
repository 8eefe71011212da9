"""URL filters: fixed rules first, then words in host names.

Host labels and path parts that are written together are split into words by a unigram model (the most probable
split, found by dynamic programming), and a multinomial naive Bayes classifier scores the words. The dictionary is
counted over all pages: words of titles, of paths, and of host labels that a hyphen already separates. The
classifier learns from a bounded sample of addresses in which listed words mark the unwanted ones; it passes what it
learns on to the words that stand beside them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import bounded_sample, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that mark an address as unwanted.
UNWANTED = (
    "ad", "ads", "adult", "bet", "betting", "bitcoin", "casino", "cheap", "cialis", "click", "coupon", "crack", "dating", "escort",
    "gambling", "hack", "hacked", "hot", "keygen", "loan", "loans", "lottery", "malware", "nude", "payday", "phish",
    "pill", "pills", "pirate", "poker", "porn", "replica", "scam", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra",
    "warez", "win", "winner", "xxx",
)

_LETTERS = re.compile(r"[^\W\d_]+")


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule is a host, which stands for its subdomains too,
    and the beginning of a path. Equally long rules are tried in the given order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, pattern in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = pattern.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


@dataclass
class Unigrams:
    """Word probabilities and the most probable split; unknown words cost ten times more with each letter."""

    counts: dict[str, int]
    longest: int = 24
    known: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        total = max(1, sum(self.counts.values()))
        self.logs = {w: math.log(c / total) for w, c in self.counts.items()}
        self.unknown = [math.log(10 / total) - n * math.log(10) for n in range(self.longest + 1)]

    def split(self, text: str) -> list[str]:
        """Viterbi: best score of each prefix and where its last word begins; ties go to the longer last word."""
        if text not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            best, back = [0.0], [0]
            for end in range(1, len(text) + 1):
                score, start = max(
                    (best[i] + self.logs.get(text[i:end], self.unknown[end - i]), -i)
                    for i in range(max(0, end - self.longest), end)
                )
                best.append(score)
                back.append(-start)
            words, end = [], len(text)
            while end:
                words.append(text[back[end] : end])
                end = back[end]
            self.known[text] = words[::-1]
        return self.known[text]

    def words(self, host: str, path: str) -> list[str]:
        """The words of an address: host labels and path parts, split; numbers and signs only separate."""
        return [w for part in _LETTERS.findall(f"{host} {path}".lower()) for w in self.split(part)]


def dictionary(pages: DataFrame, most: int = 50_000, shared: int = 10) -> dict[str, int]:
    """Counts of the ``most`` frequent words of all titles, paths and hyphenated host labels, of the labels that
    stand in at least ``shared`` different hosts (counted by host), and of the listed words, which count once more.
    ``most`` bounds what is sent to the tasks."""
    title = F.coalesce(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    hyphens = F.array_join(F.filter(F.split(host_of(), r"\."), lambda label: label.contains("-")), " ")
    words = F.split(F.lower(F.concat_ws(" ", title, path_of(), hyphens)), r"[^\p{L}]+")
    counted = pages.select(F.explode(words).alias("word")).groupBy("word").count()
    hosts = pages.select(host_of().alias("host")).distinct()
    labels = hosts.select(F.explode(F.split("host", r"[^\p{L}]+")).alias("word")).groupBy("word").count()
    both = counted.unionByName(labels.filter(F.col("count") >= shared)).groupBy("word").agg(F.sum("count").alias("count"))
    rows = both.filter("length(word) between 2 and 24").orderBy(F.desc("count"), "word").limit(most).collect()
    found = {r["word"]: r["count"] for r in rows}
    return found | {w: found.get(w, 0) + 1 for w in UNWANTED}


@dataclass
class NaiveBayes:
    """Log-odds of each word and of the classes; words that were not learned count for neither side."""

    prior: float
    odds: dict[str, float]

    def score(self, words: list[str]) -> float:
        """Probability that an address with these words is unwanted."""
        logit = self.prior + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def fit(pages: DataFrame, split: Unigrams, most: int = 50_000, smoothing: float = 0.5) -> NaiveBayes:
    """Multinomial naive Bayes on about ``most`` addresses; those with a listed word are the unwanted ones."""
    ship(pages.sparkSession)
    sample = bounded_sample(pages.select("page_id", host_of().alias("host"), path_of().alias("path")), "page_id", most)
    listed = frozenset(UNWANTED)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [split.words(h, p) for h, p in zip(batch["host"], batch["path"], strict=True)]
            yield pd.DataFrame({"words": found, "unwanted": [int(not listed.isdisjoint(w)) for w in found]})

    marked = sample.mapInPandas(rows, "words array<string>, unwanted int")
    sizes = {r["unwanted"]: r["count"] for r in marked.groupBy("unwanted").count().collect()}
    counted = marked.select("unwanted", F.explode("words").alias("word")).groupBy("word")
    counts = counted.agg(F.sum("unwanted").alias("bad"), F.count("*").alias("all")).collect()
    bad, good = sum(r["bad"] for r in counts), sum(r["all"] - r["bad"] for r in counts)
    size = len(counts)
    odds = {
        r["word"]: math.log((r["bad"] + smoothing) / (bad + smoothing * size))
        - math.log((r["all"] - r["bad"] + smoothing) / (good + smoothing * size))
        for r in counts
    }
    return NaiveBayes(math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)), odds)


def judge(pages: DataFrame, rules: list[tuple[str, str]], most_words: int = 50_000, most_addresses: int = 50_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, words, score. The longest fitting rule decides; where
    none fits, the address is blocked from a score of 0.5 on. A null address or one without ``://`` has no words."""
    split = Unigrams(dictionary(pages, most_words))
    model = fit(pages, split, most_addresses)

    @F.pandas_udf("words array<string>, score double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            words = [split.words(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"words": words, "score": [model.score(w) for w in words]})

    parts = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    found = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), scored("host", "path").alias("s"))
    own = F.when(F.col("s.score") >= 0.5, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "s.words", "s.score"
    )
