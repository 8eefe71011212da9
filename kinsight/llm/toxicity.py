"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of two lexicons (a general list of insults, and words that labelled toxic texts use far more
often than others), how near lexicon words stand to second-person words, rates of capitals and punctuation, and
rates of obfuscated spelling. The model is fitted on a bounded sample of labelled texts; every text is scored, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import bounded_sample, fold_of, remembered, ship, text_or_empty, unused

#: Common insults, and words that address the reader (English, French, German, Spanish).
INSULTS = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "worthless", "disgusting", "pathetic", "dumb",
    "fool", "jerk", "garbage", "filthy", "vermin", "imbecile", "freak", "ugly", "liar", "crétin", "imbécile",
    "connard", "ordure", "abruti", "dummkopf", "abschaum", "trottel", "arschloch", "basura", "imbécil", "estúpido",
    "escoria", "idiota",
)
ADDRESS = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "vous", "votre", "ton", "du", "dich", "dir", "ihr",
    "dein", "tú", "ti", "usted", "vosotros",
)

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_]\S*[0-9@$*!|+]\S*[^\W\d_])\S+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_RUNS = re.compile(r"([!?.*#$%&@])\1+")
_LEET = str.maketrans("013457@$!|+", "oieastasilt")
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"!?-]")
_PAIRS = re.compile(r"(.)\1+")

_COLLAPSED = frozenset(_PAIRS.sub(r"\1", w) for w in INSULTS)

NAMES = (
    "insults", "insults_log", "insults_kinds", "learned", "learned_log", "learned_kinds", "learned_weight", "address",
    "address_near", "capitals", "capital_words", "exclamations", "questions", "marks_run", "symbols", "mixed",
    "hidden_insults", "stretched", "words_log", "word_length",
)


def features(text: str, insults: frozenset[str], learned: dict[str, float], address: frozenset[str]) -> list[float]:
    """The dense features of one text, in the order of NAMES; all are 0 for a text without words."""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(1, len(words))
    first = [i for i, w in enumerate(words) if w in insults]
    second = [i for i, w in enumerate(words) if w in learned]
    spoken = [i for i, w in enumerate(words) if w in address]
    hits = np.array(sorted({*first, *second}))
    near = 0
    if len(hits) and spoken:
        at = np.searchsorted(hits, spoken)
        gap = np.minimum(np.abs(hits[np.minimum(at, len(hits) - 1)] - spoken), np.abs(hits[np.maximum(at - 1, 0)] - spoken))
        near = int((gap <= 5).sum())
    chars = max(1, len(text))
    upper = sum(map(str.isupper, text))
    mixed = _MIXED.findall(lower) if _SYMBOLS.search(lower) or any(c in lower for c in "0123456789!") else []
    hidden = sum(_PAIRS.sub(r"\1", "".join(_WORD.findall(w.translate(_LEET)))) in _COLLAPSED for w in mixed)
    return [
        len(first) / n, math.log1p(len(first)), len({words[i] for i in first}),
        len(second) / n, math.log1p(len(second)), len({words[i] for i in second}), sum(learned[words[i]] for i in second) / n,
        len(spoken) / n, near / n,
        upper / chars, sum(1 for w in text.split() if len(w) > 1 and w.isupper()) / n,
        text.count("!") / chars, text.count("?") / chars, len(_RUNS.findall(text)) / n, len(_SYMBOLS.findall(text)) / chars,
        len(mixed) / n, hidden / n, len(_STRETCHED.findall(lower)) / n,
        math.log1p(len(words)), sum(map(len, words)) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth on binned features, for log loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    shrink: float = 2.0
    bins: int = 32
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles, method="lower")) for j in range(x.shape[1])]
        b, n = self.binned(x), len(y)
        self.start = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        margin = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = y - p, p * (1 - p)
            node = np.zeros(n, int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, self.bins)
            for level in range(self.depth):
                width, base = 2**level, 2**level - 1
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    cell = (node - base) * self.bins + b[:, j]
                    g, h = (
                        np.bincount(cell, w, width * self.bins).reshape(width, self.bins).cumsum(axis=1) for w in (slope, curve)
                    )
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = (
                        g**2 / (h + self.shrink)
                        + (total_g - g) ** 2 / (total_h - h + self.shrink)
                        - total_g**2 / (total_h + self.shrink)
                    )
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(width), at] > best + 1e-9
                    best = np.where(better, gain[np.arange(width), at], best)
                    own = base + np.flatnonzero(better)
                    feature[own], cut[own] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, slope, 2**self.depth) / (np.bincount(leaf, curve, 2**self.depth) + self.shrink)
            self.grown.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, value in self.grown:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step probabilities of the margins (pool adjacent violators); blocks as (mean margin, share)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, positives, rows
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([m, label, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


@dataclass
class ToxicityModel:
    """What scoring needs; its size depends on the parameters alone."""

    learned: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray
    prior: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        insults, address = frozenset(INSULTS), frozenset(ADDRESS)
        x = np.array([features(t, insults, self.learned, address) for t in texts], float).reshape(len(texts), len(NAMES))
        return np.clip(np.interp(self.trees.margins(x), self.at, self.share), 0, 1)


def learned_lexicon(sample: DataFrame, most: int = 300, least_share: float = 0.01, ratio: float = 5.0) -> dict[str, float]:
    """Words of at least ``least_share`` of the sample's toxic texts that are ``ratio`` times as frequent there as in
    the others, with their log ratios; the ``most`` most frequent ones."""
    sizes = sample.groupBy("toxic").count().collect()
    count = {r["toxic"]: r["count"] for r in sizes}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    if not toxic or not clean:
        return {}
    words = sample.select(
        "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    ).filter("word <> ''")
    counted = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("all"))
    rows = (
        counted.filter(F.col("t") >= max(3, least_share * toxic))
        .withColumn("log_ratio", F.log((F.col("t") / toxic) / ((F.col("all") - F.col("t") + 1) / clean)))
        .filter(F.col("log_ratio") >= math.log(ratio))
        .orderBy(F.desc("t"), "word")
        .limit(most)
        .collect()
    )
    return {r["word"]: float(r["log_ratio"]) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 5) -> ToxicityModel:
    """Fit on about ``most`` labelled texts of the learning folds (crc32 of doc_id as text modulo ``folds`` not 0).

    Equal texts count once in a class. Calibration uses margins of trees that did not see the text (three parts).
    Without labelled rows the prior share of toxic rows, or 0, is every text's score.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    known = bounded_sample(known.filter(fold_of("label_id", folds) != 0), "label_id", most)
    texts = docs.select(F.col("doc_id").alias("label_id"), text_or_empty().alias("text"))
    texts = texts.join(F.broadcast(known), "label_id")  # bounded by ``most``; the texts of other rows stay where they are
    sample = texts.groupBy("toxic", F.sha2("text", 256).alias("sha")).agg(F.min("text").alias("text"))
    words = learned_lexicon(sample)
    insults, address = frozenset(INSULTS), frozenset(ADDRESS)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("toxicity")
        for batch in batches:
            x = [features(t, insults, words, address) for t in batch["text"]]
            yield pd.DataFrame({"sha": batch["sha"], "toxic": batch["toxic"], "x": x})

    found = sample.mapInPandas(rows, "sha string, toxic int, x array<double>").toPandas()
    found = found.sort_values(["sha", "toxic"], ignore_index=True)
    y = found["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(words, None, np.zeros(1), np.zeros(1), float(y.mean()) if len(y) else 0.0)
    x = np.stack(found["x"].to_numpy())
    part, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        if len(set(y[part != k])) == 2:
            margin[part == k] = Trees().fit(x[part != k], y[part != k]).margins(x[part == k])
    at, share = isotonic(margin, y)
    return ToxicityModel(words, Trees().fit(x, y), at, share)


def scorer(model: ToxicityModel) -> Column:
    """Score of the column ``text``: between 0 and 1, null texts as empty ones."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered("toxicity")
        for batch in texts:
            parts = [model.scores([t or "" for t in batch.iloc[i : i + 500]]) for i in range(0, len(batch), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col("text").cast("string"))


def score(docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Empty and null texts are scored too."""
    model = fit(docs, labels, most, folds)
    scored = docs.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), scorer(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below 0.5."""
    model = fit(docs, labels, most)
    (mark,) = unused(docs, "__score")
    return docs.withColumn(mark, scorer(model)).filter(F.col(mark) < 0.5).select(*docs.columns)
