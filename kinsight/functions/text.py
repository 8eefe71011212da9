"""Text expressions built from JVM-side functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_LETTERS = r"[^\p{L}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters. The first and last entry may be '' (text that starts or ends otherwise)."""
    return F.split(F.lower(text), NON_LETTERS)


def token_count(words: str) -> Column:
    """Number of non-empty entries of a ``tokens`` column, without walking it."""
    return F.expr(
        f"size({words}) - CAST(element_at({words}, 1) = '' AS INT) "
        f"- CAST(size({words}) > 1 AND element_at({words}, -1) = '' AS INT)"
    )


def only(words: Column, vocabulary: Iterable[str]) -> Column:
    """The entries of ``words`` that are in ``vocabulary``: the one pass over a long text."""
    members = sorted(set(vocabulary))
    return F.filter(words, lambda w: w.isin(members))


def count_in(words: Column, lexicon: Iterable[str]) -> Column:
    """How many of ``words`` are in ``lexicon`` (with repeats)."""
    return F.size(only(words, lexicon))


def has_any(words: Column, lexicon: Iterable[str]) -> Column:
    return F.arrays_overlap(words, F.lit(list(lexicon)))


def first_rule(words: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """Value of the first rule that has a keyword among ``words``."""
    chosen = F.lit(default)
    for value, keywords in reversed(rules):
        chosen = F.when(has_any(words, keywords), F.lit(value)).otherwise(chosen)
    return chosen


def like_any(text: Column, patterns: Iterable[str]) -> Column:
    """LIKE against any pattern. The costly wildcard match only runs where all literal parts occur."""
    hit = F.lit(False)
    for pattern in patterns:
        parts = [p for p in pattern.split("%") if p and "_" not in p]
        match = text.like(pattern)
        if len(parts) > 1:
            for part in reversed(parts):
                match = text.contains(part) & match
        hit = hit | match
    return hit


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+")))


def first_sentence(text: Column, max_words: int = 20) -> Column:
    """First sentence on one line, at most ``max_words`` words."""
    # anchored at the start, so the match ends with the sentence and never scans the rest of the text
    sentence = F.regexp_extract(text, r"^\s*([^.!?]*[.!?]?)", 1)
    return F.array_join(F.slice(F.split(strip(sentence), r"\s+"), 1, max_words), " ")
