"""Which keys have been delivered before, answered without reading all that has.

Each batch leaves its keys in sorted files, and for each file a summary: its lowest and highest key, and a Bloom filter.
The keys of a later batch are held against the ranges first, then, where a range may hold them, against the filter;
only files that are left are opened, for an exact comparison. Keys that grow with time, as numbers from a sequence do,
fall behind the ranges of old files, so a batch costs the same however long the history is. Keys in no order cost what
their filters cost, and still open hardly a file.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.session import run_folder
from kinsight.sources.buckets import read_if_there

#: Bits of one row of a filter, as ``bitmap_construct_agg`` makes them.
ROW_BITS = 32768
SEEDS = (11, 23, 47)


def _places(key: Column, cells: Column) -> Column:
    """Where a key's bits lie in a filter of so many cells."""
    return F.array(*[F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), cells) for seed in SEEDS])


def _bit_is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1


class KnownKeys:
    """Keys by batch under ``root``: ``keys/batch=<n>`` the sorted files, ``filters/batch=<n>`` and, written last,
    ``files/batch=<n>`` with one row per file. A repeated batch replaces its own."""

    def __init__(self, spark: SparkSession, root: str, key: str, bits_per_key: int = 16):
        self.spark, self.root, self.key, self.bits_per_key = spark, root.rstrip("/"), key, bits_per_key

    def add(self, keys: DataFrame, batch: int) -> None:
        """Remember the keys of a batch."""
        path = f"{self.root}/keys/batch={batch}"
        own = keys.select(self.key).filter(F.col(self.key).isNotNull())
        own.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema(own.schema).parquet(path).select(self.key, F.col("_metadata.file_name").alias("file"))
        # a power of two, at least one row of bits
        cells = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.count("*") * self.bits_per_key, F.lit(ROW_BITS))))).cast("long")
        files = kept.groupBy("file").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), cells.alias("cells"))
        place = kept.join(files.select("file", "cells"), "file").select("file", F.explode(_places(F.col(self.key), F.col("cells"))).alias("place"))
        filters = place.groupBy("file", F.floor(F.col("place") / ROW_BITS).alias("nth")).agg(
            F.expr(f"bitmap_construct_agg(place % {ROW_BITS})").alias("bits"))
        filters.write.mode("overwrite").parquet(f"{self.root}/filters/batch={batch}")
        files.write.mode("overwrite").parquet(f"{self.root}/files/batch={batch}")

    def _overlaps(self, pieces: list, below: int) -> list[tuple]:
        """(piece, batch, file, low, high, cells) of the files whose range meets a piece's range. The driver compares
        the ranges of files and pieces, which are as many as a file listing has rows."""
        files = read_if_there(self.spark, f"{self.root}/files")
        if files is None:
            return []
        listed = sorted(files.filter(F.col("batch") < below).select("low", "high", "batch", "file", "cells").collect(), key=lambda r: r["low"])
        lows, found = [r["low"] for r in listed], []
        for piece, low, high in pieces:
            # files start at or before the piece's end; those that end before its start don't meet it
            found += [(piece, r["batch"], r["file"], r["low"], r["high"], r["cells"]) for r in listed[: bisect_right(lows, high)] if r["high"] >= low]
        return found

    def suspects(self, keys: DataFrame, below: int) -> list[str]:
        """The key files of earlier batches that may hold one of the keys."""
        folder = run_folder(self.spark, "incoming-keys")
        asked = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        asked.repartitionByRange(self.key).withColumn("piece", F.spark_partition_id()).write.parquet(folder)
        asked = self.spark.read.parquet(folder)
        pieces = [tuple(r) for r in asked.groupBy("piece").agg(F.min(self.key), F.max(self.key)).collect()]
        overlaps = self._overlaps(pieces, below)
        if not overlaps:
            return []
        kind = keys.schema[self.key].dataType.simpleString()
        near = self.spark.createDataFrame(overlaps, f"piece int, batch long, file string, low {kind}, high {kind}, cells long")
        inside = asked.join(near, "piece").filter(F.col(self.key).between(F.col("low"), F.col("high")))
        place = inside.select("batch", "file", self.key, F.explode(_places(F.col(self.key), F.col("cells"))).alias("place"))
        place = place.withColumn("nth", F.floor(F.col("place") / ROW_BITS))
        batches = sorted({o[1] for o in overlaps})
        filters = self.spark.read.parquet(f"{self.root}/filters").filter(F.col("batch").isin(batches)).withColumn("batch", F.col("batch").cast("long"))
        hits = place.join(filters, ["batch", "file", "nth"]).filter(_bit_is_set(F.col("bits"), F.col("place") % ROW_BITS))
        likely = hits.groupBy("batch", "file", self.key).agg(F.count("*").alias("n")).filter(F.col("n") == len(SEEDS))
        return sorted(f"{self.root}/keys/batch={r[0]}/{r[1]}" for r in likely.select("batch", "file").distinct().collect())

    def unseen(self, rows: DataFrame, batch: int) -> tuple[DataFrame, list[str]]:
        """(one row per key that no batch below this one had, the key files that were opened to tell)."""
        once = rows.dropDuplicates([self.key])
        opened = self.suspects(once, batch)
        if not opened:
            return once, []
        known = self.spark.read.schema(once.select(self.key).schema).parquet(*opened)
        return once.join(known, self.key, "left_anti"), opened
