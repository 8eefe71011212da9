"""Phrase collocations from weighted acyclic automata.

One automaton counts all phrases: a state stands for a phrase, an arc adds a word, and a state's weight is how often
its phrase occurs. It grows by one word a round. Each shard of the corpus sorts its distinct phrases of the round into
a layer of a transducer: for each arc its two links, the phrase without its last word (``prefix``) and the phrase
without its first (``suffix``), and its count. Layers are cut by prefix range, the layers of one range are united and
their weights summed, and only states that reach the least count stay; the shards get their numbers back and go on
from them. A phrase can only be frequent where both of its links are, so nothing is lost and a later round is small.

The parts of a phrase are looked up by composing links: the weights along the prefix links are those of its
beginnings, along the suffix links those of its endings.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import emptied, ship, stored
from kinsight.llm.mixing import mixed

#: Where pieces end; words end at spaces and tabs.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" "
)

#: A shard: ``node`` has the phrase of each place ``pos`` (null: all places; 0: the end of a piece).
SHARD = "block long, lang string, pos binary, node binary, words binary, counts binary, n_words long, n_nodes long"
LAYER = (
    "cell long, block long, lang string, at binary, words binary, prefix binary, suffix binary, counts binary, "
    "pos binary, node binary, n_nodes long"
)
UNITED = (
    "block long, at binary, numbers binary, lang string, state array<long>, prefix array<long>, suffix array<long>, "
    "word array<binary>, weight array<long>"
)


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def packed(values: np.ndarray) -> bytes:
    """An array as bytes: all first bytes, all second bytes and so on, compressed."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def steps(values: np.ndarray) -> np.ndarray:
    """A sorted array as its first value and its steps, which compress better."""
    return np.diff(values, prepend=values.dtype.type(0))


# --- shards ----------------------------------------------------------------------------------------------------------


class Shard:
    """Words of one language, numbered as they come; number 0 ends a piece."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"\n"] = 0
        self.ids = array("I")

    def add(self, text: bytes, slice_bytes: int = 1 << 22) -> None:
        """All words of a text and the end of its last piece; long texts are taken in slices that end with a piece."""
        body, start = text.translate(_LOWER), 0
        while start < len(body):
            end = len(body)
            if end - start > slice_bytes:
                end = body.rfind(b"\n", start, start + slice_bytes) + 1 or body.find(b"\n", start) + 1 or len(body)
            words = body[start:end].replace(b"\n", b" \n ").split(b" ")
            self.ids.extend(map(self.numbers.__getitem__, filter(None, words)))
            start = end
        self.ids.append(0)

    def row(self, block: int, lang: str) -> tuple:
        ids = np.frombuffer(self.ids, dtype=np.uint32)
        counts = np.bincount(ids, minlength=len(self.numbers))
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(list(self.numbers)[1:]))
        return block, lang, None, packed(ids), words, packed(counts[1:].astype(np.int64)), int(counts[1:].sum()), len(counts)


def _numbered(block_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["body"], strict=True):
                shard = shards.setdefault(lang, Shard())
                shard.add(text)
                full = [lang] if len(shard.ids) >= block_words else []
                if not full and len(shards) > 8 and sum(len(s.ids) for s in shards.values()) >= block_words:
                    full = list(shards)
                for key in full:
                    yield pd.DataFrame([shards.pop(key).row(first + made, key)], columns=_columns(SHARD))
                    made += 1
        for key, shard in shards.items():
            yield pd.DataFrame([shard.row(first + made, key)], columns=_columns(SHARD))
            made += 1

    return run


def _word_layers(cells: int):
    """The first layer: words instead of links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, lang, packed_words, packed_counts in zip(
                batch["block"], batch["lang"], batch["words"], batch["counts"], strict=True
            ):
                body = zstandard.ZstdDecompressor().decompress(packed_words)
                words = np.array(body.split(b"\n") if body else [], dtype=object)
                counts, seed = unpacked(packed_counts, np.int64), zlib.crc32(lang.encode())
                cell = np.fromiter((zlib.crc32(w, seed) for w in words), np.int64, len(words)) % cells
                rows = []
                for c, at in _by_cell(cell):
                    joined = zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[at]))
                    rows.append((c, block, lang, packed(steps(at + 1)), joined, None, None, packed(counts[at]), None, None, None))
                yield pd.DataFrame(rows, columns=_columns(LAYER))

    return run


def _by_cell(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, places) for each cell that occurs, places ascending."""
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    for a, b in zip(starts, np.append(starts, len(order))[1:], strict=True):
        yield int(cell[order[a]]), order[a:b]


def _grown(cells: int):
    """A shard goes on by one word: its places whose phrase, and whose next place's phrase, are states of the last
    round give the arcs of this round."""

    def run(shard: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in shard.itertuples(index=False):
            state = np.zeros(int(row.n_nodes), dtype=np.int64)
            for at, found in zip(numbers["at"], numbers["numbers"], strict=True):
                state[np.cumsum(unpacked(at, np.int64))] = unpacked(found, np.int64)
            here = state[unpacked(row.node, np.uint32)]
            kept = np.flatnonzero(here)
            pos = kept if row.pos is None else np.cumsum(unpacked(row.pos, np.int64))[kept]
            here = here[kept]
            begins = np.flatnonzero(np.diff(pos) == 1)
            if not len(begins):
                continue
            states, rank = np.unique(here, return_inverse=True)
            keys, node, counts = np.unique(
                rank[begins] * len(states) + rank[begins + 1], return_inverse=True, return_counts=True
            )
            prefix, suffix = states[keys // len(states)], states[keys % len(states)]
            spread = np.where(prefix & 1, mixed(prefix, 1) ^ mixed(suffix, 2), mixed(prefix, 1))
            for c, at in _by_cell((spread % np.uint64(cells)).astype(np.int64)):
                rows.append((
                    c, row.block, row.lang, packed(steps(at)), None, packed(steps(prefix[at])), packed(suffix[at]),
                    packed(counts[at]), None, None, None,
                ))
            places = packed(steps(pos[begins])), packed(node.astype(np.uint32))
            rows.append((None, row.block, row.lang, None, None, None, None, None, *places, len(keys)))
        return pd.DataFrame(rows, columns=_columns(LAYER))

    return run


# --- union -----------------------------------------------------------------------------------------------------------


def _state_numbers(cell: int, weights: np.ndarray, hot: int) -> np.ndarray:
    """Numbers of a range's states; the lowest bit marks one whose arcs are spread over several ranges."""
    return ((cell + 1) << 33) + (np.arange(len(weights), dtype=np.int64) << 1) + (weights >= hot)


def _united_words(least: int, hot: int):
    def run(key: tuple, layers: pd.DataFrame) -> pd.DataFrame:
        cell, rows, base = int(key[0]), [], 0
        for lang, own in layers.groupby("lang", sort=True):
            totals: dict[bytes, int] = defaultdict(int)
            read = [
                (row, zstandard.ZstdDecompressor().decompress(row.words).split(b"\n"), unpacked(row.counts, np.int64))
                for row in own.itertuples(index=False)
            ]
            for _, words, counts in read:
                for word, n in zip(words, counts.tolist(), strict=True):
                    totals[word] += n
            often = sorted(w for w, n in totals.items() if n >= least)
            weights = np.array([totals[w] for w in often], dtype=np.int64)
            numbers = _state_numbers(cell, weights, hot) + (base << 1)
            base += len(often)
            rows.append((None, None, None, lang, numbers, None, None, often, weights))
            of = dict(zip(often, numbers.tolist(), strict=True))
            for row, words, _ in read:
                found = np.fromiter((of.get(w, 0) for w in words), np.int64, len(words))
                if found.any():
                    rows.append((row.block, row.at, packed(found), *[None] * 6))
        return pd.DataFrame(rows, columns=_columns(UNITED))

    return run


def _united_links(least: int, hot: int):
    def run(key: tuple, layers: pd.DataFrame) -> pd.DataFrame:
        cell, rows = int(key[0]), []
        prefixes = [np.cumsum(unpacked(x, np.int64)) for x in layers["prefix"]]
        prefix, suffix = np.concatenate(prefixes), np.concatenate([unpacked(x, np.int64) for x in layers["suffix"]])
        counts = np.concatenate([unpacked(x, np.int64) for x in layers["counts"]])
        firsts, p = np.unique(prefix, return_inverse=True)
        lasts, s = np.unique(suffix, return_inverse=True)
        arcs, arc = np.unique(p * len(lasts) + s, return_inverse=True)
        weights = np.zeros(len(arcs), dtype=np.int64)
        np.add.at(weights, arc, counts)
        often = np.flatnonzero(weights >= least)
        numbers = np.zeros(len(arcs), dtype=np.int64)
        numbers[often] = _state_numbers(cell, weights[often], hot)
        if len(often):
            links = firsts[arcs[often] // len(lasts)], lasts[arcs[often] % len(lasts)]
            rows.append((None, None, None, None, numbers[often], *links, None, weights[often]))
        found, start = numbers[arc], 0
        for block, at, own in zip(layers["block"], layers["at"], prefixes, strict=True):
            mine = found[start : start + len(own)]
            start += len(own)
            if mine.any():
                rows.append((block, at, packed(mine), *[None] * 6))
        return pd.DataFrame(rows, columns=_columns(UNITED))

    return run


def _states(united: DataFrame) -> DataFrame:
    arrays = F.arrays_zip("state", F.coalesce("prefix", "state").alias("prefix"), F.coalesce("suffix", "state").alias("suffix"), "weight")
    one = F.expr("if(word is null, cast(null as binary), word[nth])").cast("string")
    rows = united.filter("block is null and size(state) > 0").select("lang", "word", F.posexplode(arrays).alias("nth", "s"))
    return rows.select("lang", one.alias("word"), "s.state", "s.prefix", "s.suffix", F.col("s.weight").alias("a"))


def automaton(docs: DataFrame, least: int, longest: int, block_words: int, cell_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """(words per language, states by length of phrase).

    ``block_words`` bounds what a shard holds, ``cell_words`` the occurrences that meet in one range; a state with
    more of them has its arcs dealt over the ranges by the next word. Neither changes a result.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    shards = stored(texts.mapInPandas(_numbered(block_words), SHARD), "phrase-shards")
    totals = stored(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    mass = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = max(1, -(-mass // cell_words))
    layers = shards.select("block", "lang", "words", "counts").mapInPandas(_word_layers(cells), LAYER)
    rounds = [stored(layers.groupBy("cell").applyInPandas(_united_words(least, cell_words), UNITED), "phrase-states")]
    walked = shards
    for _ in range(longest - 1):
        mass = rounds[-1].select(F.sum(F.aggregate("weight", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
        cells = max(1, -(-mass // cell_words))
        numbers = rounds[-1].filter("block is not null").select("block", "at", "numbers")
        walks = shards.select("block", "lang", "pos", "node", "n_nodes")
        grown = stored(walks.groupBy("block").cogroup(numbers.groupBy("block")).applyInPandas(_grown(cells), LAYER), "phrase-layers")
        layers = grown.filter("cell is not null").select("cell", "block", "at", "prefix", "suffix", "counts")
        rounds.append(stored(layers.groupBy("cell").applyInPandas(_united_links(least, cell_words), UNITED), "phrase-states"))
        emptied(walked)
        walked = grown
        shards = grown.filter("cell is null")
    return totals, [_states(r) for r in rounds]


def composed(states: list[DataFrame]) -> list[DataFrame]:
    """Per length of phrase: state, links, lang, phrase, a, and the weights of its beginnings and endings by length."""
    none = F.array().cast("array<long>")
    out = [states[0].select("state", "prefix", "suffix", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a",
                            none.alias("begins"), none.alias("ends"))]
    for layer in states[1:]:
        head = out[-1].select(F.col("state").alias("prefix"), "lang", F.col("phrase").alias("head"),
                              F.concat("begins", F.array("a")).alias("begins"))
        tail = out[-1].select(F.col("state").alias("suffix"), "last", F.concat("ends", F.array("a")).alias("ends"))
        joined = layer.select("state", "prefix", "suffix", "a").join(head, "prefix").join(tail, "suffix")
        out.append(stored(joined.select(
            "state", "prefix", "suffix", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "begins", "ends",
        ), "phrase-parts"))
    return out


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, block_words: int = 2_000_000, cell_words: int = 1_000_000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language, best first.

    Phrases have 2 to ``longest`` words and occur at least ``least`` times. A phrase is scored by its weakest cut,
    floor(1000 a n / (l r)); ties go to the earliest cut, and between phrases to the more frequent, then the first in
    byte order. A phrase is left out where it always occurs inside one longer phrase: such a phrase has one that is a
    word longer and as frequent, so only those are asked. Null texts count as empty, a null language as ``und``; rows
    that repeat count again; an empty table has no phrases. Products are exact up to 38 digits.
    """
    totals, states = automaton(docs, least, longest, block_words, cell_words)
    layers = composed(states)
    rows = None
    for k, layer in enumerate(layers[1:], 1):
        own = layer.select("state", "lang", "phrase", "a", "begins", "ends")
        if k + 1 < len(layers):
            links = [layers[k + 1].select(F.col(link).alias("state"), "a") for link in ("prefix", "suffix")]
            longer = links[0].unionByName(links[1]).groupBy("state").agg(F.max("a").alias("longer"))
            own = own.join(longer, "state", "left").filter("longer is null or longer < a").drop("longer")
        rows = own if rows is None else rows.unionByName(own)
    cut = """transform(sequence(1, size(begins)), k -> struct(
        (cast(1000 as decimal(38, 0)) * (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))))
          div (cast(begins[k - 1] as decimal(19, 0)) * cast(ends[size(ends) - k] as decimal(19, 0))) as score,
        k as k, begins[k - 1] as l, ends[size(ends) - k] as r))"""
    scored = rows.join(totals, "lang").select("lang", "phrase", "a", "n", F.array_min(F.expr(cut)).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
