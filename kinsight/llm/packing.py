"""Packing documents into training sequences by non-negative least squares.

A document's token ids are cut into whole windows and a rest shorter than a window. Combinations of two or three
rest lengths that fill a window exactly are the columns of a least-squares problem whose right side is the
histogram of rests; its non-negative solution, rounded down, says how often each combination is used. Rests that no
combination takes form one stream which is cut at window boundaries, and the last, shorter part of the stream at
powers of two.

Only the histogram (one row per length below the window) reaches the driver. A rest finds its place from its rank
among rests of equal length, and ranks are counted in hashed buckets, so a length that a third of all documents
share is spread over tasks. Ids are stored once in the shared folder and shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import ship, stored, text_or_empty
from kinsight.llm.encoding import encoder

TOKENS = "doc_id long, tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenised(docs: DataFrame, path: str, end_id: int, spaces_kept: bool = True) -> DataFrame:
    """(doc_id, tokens, ids): ids as little-endian integers of two bytes, the end id last. Null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path, spaces_kept), np.array([end_id], "<u2").tobytes()
        if encode.tokenizer.get_vocab_size() > 65536:
            raise ValueError("two bytes an id: the vocabulary must not exceed 65536")
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                ids = [b + end for b in encode(list(part["text"]), width=2)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "tokens": [len(b) // 2 for b in ids], "ids": ids})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, TOKENS)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the given lengths that add up to the window, one a row; a pair's third entry is 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = []
    for a in lengths[lengths <= window // 2]:
        if there[window - a]:
            found.append(np.array([[a, window - a, 0]]))
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        ok = there[b] & there[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def least_squares(columns: np.ndarray, counts: np.ndarray, block: int = 96, rounds: int = 24, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' use of each length nearest to ``counts``.

    The columns that promise the steepest descent enter in blocks; after each block, accelerated projected gradients
    solve for the columns that are in. Columns used less than once leave before the last solve. The work depends on
    the window and these parameters alone.
    """
    x = np.zeros(len(columns))

    def use(chosen: np.ndarray, times: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(columns[chosen, k], times, len(counts)) for k in range(3))
        total[0] = 0  # the place of a pair's missing third length
        return total

    def solve(chosen: np.ndarray) -> None:
        size = 1 / (3 * max(1.0, use(chosen, np.ones(len(chosen))).max()))  # of a step: 1 over a bound of the norm
        now = ahead = x[chosen]
        pace = 1.0
        for _ in range(steps):
            rest = counts - use(chosen, ahead)
            rest[0] = 0
            new = np.maximum(ahead + size * rest[columns[chosen]].sum(axis=1), 0)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, now, pace = new + (pace - 1) / faster * (new - now), new, faster
        x[chosen] = now

    inside = np.zeros(0, int)
    for _ in range(rounds):
        rest = counts - use(inside, x[inside])
        rest[0] = 0
        gain = rest[columns].sum(axis=1)
        gain[inside] = 0
        best = np.argsort(-gain, kind="stable")[:block]
        best = best[gain[best] > 1]
        if not len(best):
            break
        inside = np.concatenate([inside, best])
        solve(inside)
    often = inside[x[inside] >= 1]
    x[np.setdiff1d(inside, often)] = 0
    if len(often):
        solve(often)
    return x


class Plan:
    """Where the rests go. Sequences 0 .. ``combined`` - 1 are filled by combinations, then come those cut from the
    stream of other rests, then the whole windows from ``first_whole`` on."""

    def __init__(self, histogram: dict[int, int], window: int):
        self.window = window
        counts = np.zeros(window, np.int64)
        for length, times in histogram.items():
            counts[length] = times if length else 0
        left = counts.copy()
        slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, end, first sequence, offset)
        columns, self.combined = combinations(np.flatnonzero(counts), window), 0
        x = least_squares(columns, counts.astype(float)) if len(columns) else np.zeros(0)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            parts = [int(v) for v in columns[k] if v]
            times = min([int(x[k] + 1e-6), *(int(left[v]) // parts.count(v) for v in parts)])
            offset = 0
            for v in parts if times else []:
                rank = int(counts[v] - left[v])
                slots.setdefault(v, []).append((rank, rank + times, self.combined, offset))
                left[v] -= times
                offset += v
            self.combined += times
        self.slots = {v: np.array(s, np.int64) for v, s in slots.items()}
        self.taken = counts - left
        self.before = np.concatenate([[0], np.cumsum(left * np.arange(window))])  # of the stream, by length
        total = int(self.before[-1])
        whole, tail = divmod(total, window)
        ends, at = [], whole * window
        for size in (1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1):
            at += size
            ends.append(at)
        self.whole, self.ends = whole, ends
        self.first_whole = self.combined + whole + len(ends)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of a rest."""
        if rank < self.taken[length]:
            slots = self.slots[length]
            first, _, sequence, offset = slots[np.searchsorted(slots[:, 0], rank, "right") - 1].tolist()
            return [(length, sequence + rank - first, offset)]
        at = int(self.before[length]) + (rank - int(self.taken[length])) * length
        out = []
        while length:
            if at < self.whole * self.window:
                sequence, offset = divmod(at, self.window)
                room = self.window - offset
            else:
                k = next(i for i, end in enumerate(self.ends) if at < end)
                begin = self.ends[k - 1] if k else self.whole * self.window
                sequence, offset, room = self.whole + k, at - begin, self.ends[k] - at
            piece = min(room, length)
            out.append((piece, self.combined + sequence, offset))
            at, length = at + piece, length - piece
        return out


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = 1024, bucket_rows: int = 20_000) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids as little-endian 32-bit integers).

    Every id of every document, and its end id, lies in exactly one piece; a sequence holds ``window`` ids or a
    power of two, so none needs padding. An empty document is its end id alone; an empty table has no pieces;
    repeated rows are packed as often as they occur. ``bucket_rows`` is how many rows share a ranking task.
    """
    tokens = stored(tokenised(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "packing")
    buckets = max(16, tokens.count() // bucket_rows)
    slim = tokens.select(
        "row",
        F.expr(f"tokens div {window}").alias("full"),
        (F.col("tokens") % window).cast("int").alias("rest"),
        F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"),
    )
    sums = slim.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("windows"))
    by_rest = {r["rest"]: r for r in sums.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")).collect()}
    plan = Plan({k: r["n"] for k, r in by_rest.items()}, window)
    first_window, at = np.zeros(window, np.int64), plan.first_whole
    for k in sorted(by_rest):
        first_window[k], at = at, at + by_rest[k]["windows"]

    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "rest", "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"),
        F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("windows_before"),
    )
    inside = Window.partitionBy("rest", "bucket").orderBy("row")
    ranked = slim.select(
        "row", "rest", "bucket",
        (F.row_number().over(inside) - 1).alias("rank"),
        F.coalesce(F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("windows"),
    ).join(offsets, ["rest", "bucket"]).select(
        "row", "rest",
        (F.col("rank") + F.col("ranks_before")).alias("rank"),
        (F.col("windows") + F.col("windows_before")).alias("windows"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            out = []
            ids_of = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for doc_id, ids, rest, rank, windows in zip(
                ids_of, batch["ids"], batch["rest"], batch["rank"], batch["windows"], strict=True
            ):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                n, sequence = len(wide), int(first_window[rest] + windows)
                pieces = [(window, sequence + k, 0) for k in range(n // window)]
                pieces += plan.place(int(rest), int(rank)) if rest else []
                at = 0
                for length, where, offset in pieces:
                    out.append((doc_id, at, length, n, where, offset, wide[at : at + length].tobytes()))
                    at += length
                if len(out) >= 4000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return tokens.select("row", "doc_id", "ids").join(ranked.hint("shuffle_hash"), "row").mapInPandas(cut, PIECES)
