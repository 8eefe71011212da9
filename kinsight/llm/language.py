"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator seeded by its code point. A run of n letters is
bound to one vector: the letters' vectors, permuted by their place in the run, are multiplied. The vectors of all
runs of a text are added up, and the sum is compared with the languages' prototypes by cosine. Texts are lower-cased;
what isn't a letter ends a word, and word ends take part in the runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import bounded_sample, fold_of, remembered, ship

#: Sizes of text for which a bar is learned: powers of two of runs, the last one for all larger texts; and the lengths
#: of the beginnings of learning texts that stand for shorter ones.
SIZES, BEGINNINGS = 10, (8, 16, 32, 64, 128, 256, 512)


class LetterSpace:
    """Turns texts into sums of run vectors; the vectors of runs met before are remembered, up to ``limit``."""

    def __init__(self, dimensions: int, run: int, seed: int, limit: int = 40_000):
        self.dimensions, self.run, self.seed, self.limit = dimensions, run, seed, limit
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.vectors = np.empty((0, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def runs(self, text: str) -> np.ndarray:
        """Codes of all runs of a text, 21 bits a letter; empty where it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes = np.where(self.is_letter[codes], codes, 0)
        ends = np.concatenate([[0], codes, [0]])
        ends = ends[np.concatenate([[True], (ends[1:] != 0) | (ends[:-1] != 0)])]
        if len(ends) < 3:
            return np.zeros(0, np.int64)
        if len(ends) < self.run:
            ends = np.pad(ends, (0, self.run - len(ends)))
        out = np.zeros(len(ends) - self.run + 1, np.int64)
        for k in range(self.run):
            out = (out << 21) | ends[k : k + len(out)]
        return out

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of distinct run codes, one a row."""
        if len(self.place) > self.limit:
            self.forget()
        fresh = [c for c in codes.tolist() if c not in self.place]
        if fresh:
            made = np.ones((len(fresh), self.dimensions), np.int8)
            for k in range(self.run):
                back = self.run - 1 - k
                made *= np.stack([np.roll(self.letter(c >> 21 * back & 0x1FFFFF), back) for c in fresh])
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.vectors = np.concatenate([self.vectors, made])
        return self.vectors[[self.place[c] for c in codes.tolist()]]

    def sums(self, texts: list[str], together: int = 200_000) -> np.ndarray:
        """One row a text: the sum of its runs' vectors, scaled to length 1; zeros for a text without letters."""
        return self.measured(texts, together)[0]

    def measured(self, texts: list[str], together: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the texts, and how many runs each has."""
        out, group, held = np.zeros((len(texts), self.dimensions), np.float32), [], 0
        runs = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            codes = self.runs(text)
            runs[i] = len(codes)
            group.append((i, codes))
            held += len(codes)
            if held >= together or i == len(texts) - 1:
                self._add(group, out)
                group, held = [], 0
        return out, runs

    def _add(self, group: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        unique, inverse = np.unique(np.concatenate([codes for _, codes in group]), return_inverse=True)
        if not len(unique):
            return
        row = np.repeat(np.arange(len(group)), [len(codes) for _, codes in group])
        by_run = np.argsort(inverse, kind="stable")
        row, inverse = row[by_run], inverse[by_run]
        for at in range(0, len(unique), 4096):  # a bounded number of vectors, and of counts, at a time
            part = unique[at : at + 4096]
            own = slice(*np.searchsorted(inverse, [at, at + len(part)]))
            places = row[own] * len(part) + (inverse[own] - at)
            counts = np.bincount(places, minlength=len(group) * len(part)).reshape(len(group), -1)
            total = counts.astype(np.float32) @ self.bound(part).astype(np.float32)
            out[[i for i, _ in group]] += total
        rows = [i for i, _ in group]
        length = np.linalg.norm(out[rows], axis=1, keepdims=True)
        out[rows] = out[rows] / np.maximum(length, 1e-9)


def letter_space(dimensions: int, run: int, seed: int) -> LetterSpace:
    """One per Python worker and set of parameters."""
    key, known = (dimensions, run, seed), remembered("language")
    if key not in known:
        known[key] = LetterSpace(*key)
    return known[key]


@dataclass(frozen=True)
class LanguageModel:
    """Prototypes, one row a language; the languages are in alphabetical order, which settles ties. ``lengths`` are those
    of the sums of learning texts, before they were scaled to 1."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    run: int
    seed: int
    lengths: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.nearest(letter_space(self.prototypes.shape[1], self.run, self.seed).sums(texts))

    def nearest(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each sum and the cosine with its prototype; ``und`` and 0 where nothing was summed."""
        known = sums.any(axis=1)
        if not self.languages:
            return ["und"] * len(sums), np.zeros(len(sums))
        cosine = sums @ self.prototypes.T
        best = cosine.argmax(axis=1)
        score = np.where(known, np.clip(cosine[np.arange(len(sums)), best], 0, 1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], score


def size_classes(runs: np.ndarray) -> np.ndarray:
    """The size class of texts by their numbers of runs: the power of two below, at most ``SIZES`` - 1."""
    return np.array([min(SIZES - 1, max(0, int(n).bit_length() - 1)) for n in runs], np.int64)


def _learning(docs: DataFrame, most: int | None, folds: int, held: int) -> DataFrame:
    """The learning texts: (text, lang); all of them, or about ``most``."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", folds) != held))
    known = known if most is None else bounded_sample(known, "doc_id", most)
    return known.select("text", "lang")


def fit(
    docs: DataFrame, most: int | None = 20_000, folds: int = 3, held: int = 1, dimensions: int = 1024, run: int = 3, seed: int = 5
) -> LanguageModel:
    """Prototypes from about ``most`` texts, or all for None, with a language whose crc32 of doc_id as text modulo
    ``folds`` isn't ``held``. Every text counts alike, whatever its length; tasks send one partial sum a language."""
    ship(docs.sparkSession)
    learning = _learning(docs, most, folds, held)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, held_sums = letter_space(dimensions, run, seed), {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                sums = space.sums(list(some["text"]))
                for lang in sorted(set(some["lang"])):
                    held_sums[lang] = held_sums.get(lang, 0) + np.rint(1e6 * sums[some["lang"].to_numpy() == lang]).sum(axis=0)
        for lang, total in held_sums.items():
            yield pd.DataFrame({"lang": lang, "dimension": np.arange(dimensions), "value": total.astype(np.int64)})

    sums = learning.mapInPandas(partial, "lang string, dimension int, value long").groupBy("lang", "dimension")
    found = sums.agg(F.sum("value").alias("value")).toPandas()
    languages = tuple(sorted(set(found["lang"])))
    prototypes = np.zeros((len(languages), dimensions))
    prototypes[[languages.index(x) for x in found["lang"]], found["dimension"]] = found["value"]
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel(languages, (prototypes / np.maximum(length, 1e-9)).astype(np.float32), run, seed, length[:, 0] / 1e6)


def predictor(model: LanguageModel) -> Column:
    """Struct (lang_pred, score) of the column ``text``; ``und`` and 0 for a null text or one without letters."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs, scores = [], []
            for at in range(0, len(batch), 500):
                a, b = model.predict([t or "" for t in batch.iloc[at : at + 500]])
                langs += a
                scores.append(b)
            yield pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores).astype(float) if scores else []})

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame, most: int = 20_000, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    model = fit(docs, most, folds, held)
    found = docs.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), predictor(model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def bars(docs: DataFrame, model: LanguageModel, quantile: float, ease: float, folds: int = 3, held: int = 1) -> np.ndarray:
    """The least cosine by language and size class: ``ease`` times the ``quantile`` of all learning texts' cosines with
    the prototype of their own language's other texts. Beginnings of the texts stand for short ones, whose cosines are
    lower; a class without any takes the next smaller one's bar, and 0 if there is none. ``model`` was fitted on all
    learning texts too."""
    learning = _learning(docs, None, folds, held)

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, place = letter_space(model.prototypes.shape[1], model.run, model.seed), {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            for at in range(0, len(batch), 500):
                texts, langs = list(batch["text"].iloc[at : at + 500]), list(batch["lang"].iloc[at : at + 500])
                own = [place[x] for x in langs]
                whole, sizes = space.measured(texts)
                others = model.prototypes[own] * model.lengths[own, None] - whole
                others /= np.maximum(np.linalg.norm(others, axis=1, keepdims=True), 1e-3)
                for n in (None, *BEGINNINGS):
                    rows = [i for i, t in enumerate(texts) if n is None or len(t) > n]
                    parts = [texts[i][:n] for i in rows]
                    sums, runs = (whole, sizes) if n is None else space.measured(parts)
                    if not sums.any():
                        continue
                    found = pd.DataFrame({"lang": [langs[i] for i in rows], "size": size_classes(runs), "cosine": (sums * others[rows]).sum(axis=1).astype(float)})
                    yield found[sums.any(axis=1)]

    rows = learning.mapInPandas(cosines, "lang string, size int, cosine double").groupBy("lang", "size")
    found = {(r["lang"], r["size"]): r["bar"] for r in rows.agg(F.percentile_approx("cosine", quantile, 10_000).alias("bar")).collect()}
    out = np.zeros((len(model.languages), SIZES))
    for i, lang in enumerate(model.languages):
        for size in range(SIZES):
            out[i, size] = max(0.0, ease * found[lang, size]) if (lang, size) in found else out[i, size - 1] if size else 0.0
    return out


def accepted(docs: DataFrame, quantile: float = 0.01, ease: float = 0.4) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in some learned language: their text has letters, and
    its cosine with the best prototype reaches the bar that the learning texts set for that language and size. Both
    prototypes and bars come from all learning texts."""
    model = fit(docs, None)
    least = bars(docs, model, quantile, ease)

    @F.pandas_udf("boolean")
    def reached(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        space, place = letter_space(model.prototypes.shape[1], model.run, model.seed), {x: i for i, x in enumerate(model.languages)}
        for batch in texts:
            kept = []
            for at in range(0, len(batch), 500):
                some = [t or "" for t in batch.iloc[at : at + 500]]
                sums, runs = space.measured(some)
                langs, scores = model.nearest(sums)
                kept += [x in place and c >= least[place[x], n] for x, c, n in zip(langs, scores, size_classes(runs), strict=True)]
            yield pd.Series(kept, dtype=bool)

    return docs.filter(reached(F.col("text").cast("string")))
