"""Token ids in shard files with a minimal perfect hash index.

A shard is one record of the file: the raw ids of consecutive documents, their keys in order, and an index. The
index is a minimal perfect hash: level by level, keys that are alone in their cell of a bit array stay there and
the others go on; the number of set bits before a key's cell is its slot. A slot holds the key's fingerprint, offset
and length, so a key is found by a few bit tests, whatever the size of the shard, and foreign keys are noticed. The
records lie in Parquet files, which any store that Spark reaches can hold; the manifest, written last, has the
shards' key ranges and the number of ids before each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.llm.common import ship, text_or_empty
from kinsight.llm.encoding import encoder
from kinsight.llm.mixing import mixed

SHARD = (
    "part int, shard int, documents long, nulls long, tokens long, first_key long, last_key long, keys binary, "
    "levels array<long>, bits binary, fingerprints binary, offsets binary, lengths binary, payload binary"
)
INDEX = ["part", "shard", "documents", "nulls", "keys", "levels", "bits", "fingerprints", "offsets", "lengths"]
DOCUMENT = "part int, shard int, doc_id long, start long, n_tokens long, ids binary"


def key_hashes(keys: np.ndarray, nulls: int) -> np.ndarray:
    """Hash of (key, how often it occurred before); keys are in order, and the first ``nulls`` of them are null."""
    n = len(keys)
    fresh = np.ones(n, bool)
    fresh[1:] = keys[1:] != keys[:-1]
    if 0 < nulls < n:
        fresh[nulls] = True
    starts = np.flatnonzero(fresh)
    occurrence = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    kind = np.where(np.arange(n) < nulls, 7, 3)
    return mixed(mixed(keys.view(np.uint64), 1) ^ mixed(occurrence.astype(np.uint64) * np.uint64(8) + kind.astype(np.uint64), 2), 3)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.before = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, values: np.ndarray, spread: float = 2.0) -> PerfectHash:
        if len(np.unique(values)) != len(values):
            raise ValueError("two keys have the same 64-bit hash")
        levels, bits, left = [], [], values
        while len(left):
            size = int(np.ceil(len(left) * spread))
            cell = mixed(left, 11 + len(levels)) % np.uint64(size)
            alone = np.bincount(cell.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            levels.append(size)
            left = left[~alone[cell.astype(np.int64)]]
        return cls(levels, np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, values: np.ndarray) -> np.ndarray:
        """Slot of each value; -1 where no level has it. A value that was not built in may get any slot."""
        found, base = np.full(len(values), -1, np.int64), 0
        open_ = np.arange(len(values))
        for level, size in enumerate(self.levels):
            cell = base + (mixed(values[open_], 11 + level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[cell]
            found[open_[hit]] = self.before[cell[hit]]
            open_, base = open_[~hit], base + size
        return found


def fingerprint(values: np.ndarray) -> np.ndarray:
    return mixed(values, 5).astype(np.uint32)


def shard_row(part: int, shard: int, keys: list[int | None], ids: list[bytes]) -> tuple:
    """One record; ``ids`` are two-byte integers."""
    nulls = sum(k is None for k in keys)
    array = np.array([0 if k is None else k for k in keys], np.int64)
    hashes = key_hashes(array, nulls)
    table = PerfectHash.build(hashes)
    slot = table.slots(hashes)
    length = np.array([len(b) // 2 for b in ids], np.int64)
    offset = np.cumsum(length) - length
    prints, offsets, lengths = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    prints[slot], offsets[slot], lengths[slot] = fingerprint(hashes), offset, length
    real = array[nulls:]
    return (
        part, shard, len(keys), nulls, int(length.sum()), int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None,
        array.tobytes(), table.levels, np.packbits(table.bits).tobytes(), prints.tobytes(), offsets.tobytes(), lengths.tobytes(),
        b"".join(ids),
    )


class ShardIndex:
    """The index of one record, for lookups by key."""

    def __init__(self, row):
        self.keys, self.nulls = np.frombuffer(row.keys, np.int64), int(row.nulls)
        levels = [int(v) for v in row.levels]
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8))[: sum(levels)].astype(bool)
        self.table = PerfectHash(levels, bits)
        self.prints = np.frombuffer(row.fingerprints, np.uint32)
        self.offsets, self.lengths = np.frombuffer(row.offsets, np.int64), np.frombuffer(row.lengths, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are there (by fingerprint), and their offsets and lengths."""
        slot = self.table.slots(hashes)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == fingerprint(hashes[there])
        slot = np.where(there, slot, 0)
        return there, self.offsets[slot], self.lengths[slot]


def write(docs: DataFrame, folder: str, path: str, end_id: int, spaces_kept: bool = False, shard_tokens: int = 1 << 21) -> None:
    """Write all documents, in ascending order of doc_id (null first, equal ones by a hash of the text), as shards of
    about ``shard_tokens`` ids below ``folder``. Null texts are empty; an empty table gives no shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SHARD.split(", ")]
        encode, end = encoder(path, spaces_kept), np.array([end_id], "<u2").tobytes()
        if encode.tokenizer.get_vocab_size() > 65536:
            raise ValueError("two bytes an id: the vocabulary must not exceed 65536")
        part, shard, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                for key, found in zip(some["doc_id"], encode(list(some["text"]), width=2), strict=True):
                    keys.append(None if pd.isna(key) else int(key))
                    ids.append(found + end)
                    held += len(ids[-1]) // 2
                    if held >= shard_tokens:
                        yield pd.DataFrame([shard_row(part, shard, keys, ids)], columns=columns)
                        shard, keys, ids, held = shard + 1, [], [], 0
        if keys:
            yield pd.DataFrame([shard_row(part, shard, keys, ids)], columns=columns)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInPandas(run, SHARD).write.option("compression", "zstd").parquet(f"{folder}/shards")
    spark = docs.sparkSession
    shards = spark.read.parquet(f"{folder}/shards").select("part", "shard", "documents", "tokens", "first_key", "last_key")
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("before_part"))
    shards.join(base, "part").withColumn(
        "tokens_before", F.col("before_part") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    ).drop("before_part").write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files, found through the index: doc_id, start (ids of all documents before it),
    n_tokens, ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DOCUMENT.split(", ")]
        for batch in batches:
            for row in batch.itertuples():
                index = ShardIndex(row)
                there, offsets, lengths = index.find(key_hashes(index.keys, index.nulls))
                if not there.all():
                    raise ValueError("a key of the shard is not in its index")
                ids = np.frombuffer(row.payload, "<u2")
                out = [
                    (row.part, row.shard, None if k < index.nulls else int(key), int(o), int(n), ids[o : o + n].astype("<u4").tobytes())
                    for k, (key, o, n) in enumerate(zip(index.keys, offsets, lengths, strict=True))
                ]
                for at in range(0, len(out), 500):
                    yield pd.DataFrame(out[at : at + 500], columns=columns)

    ship(spark)
    shards = spark.read.parquet(f"{folder}/shards").select(*INDEX, "payload").mapInPandas(run, DOCUMENT)
    base = spark.read.parquet(f"{folder}/manifest").select("part", "shard", "tokens_before")
    return shards.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("tokens_before") + F.col("start")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> DataFrame:
    """The documents with the given keys (the first of equal ones in each shard); key ranges prune the shards."""
    wanted = sorted(set(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = np.array(wanted, np.int64)
        for batch in batches:
            for row in batch.itertuples():
                index = ShardIndex(row)
                there, offsets, lengths = index.find(key_hashes(array, 0))
                ids = np.frombuffer(row.payload, "<u2")
                for key, o, n in zip(array[there], offsets[there], lengths[there], strict=True):
                    yield pd.DataFrame(
                        [(row.part, row.shard, int(key), int(o), int(n), ids[o : o + n].astype("<u4").tobytes())],
                        columns=[c.split()[0] for c in DOCUMENT.split(", ")],
                    )

    ship(spark)
    near = F.lit(False)
    for key in wanted:
        near = near | ((F.col("first_key") <= key) & (F.col("last_key") >= key))
    return spark.read.parquet(f"{folder}/shards").filter(near).select(*INDEX, "payload").mapInPandas(run, DOCUMENT)
