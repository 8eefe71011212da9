"""Differences between two stored tables, found from checksums.

A table is stored in hash buckets of its key, with a tree of checksums over them: a leaf is the exact, order-free sum of
the row hashes of one bucket, a node the sum of its children. Two tables are compared from the root down; only nodes
under a difference are looked at, and only buckets whose leaves differ are read and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.operators.curated import change_feed
from kinsight.sources.buckets import bucket_of, read_if_there

#: Children of a node, as bits of the bucket number.
FAN_BITS = 4


class HashedTable:
    """``leaves`` is a power of two and the same for all tables that are compared."""

    def __init__(self, spark: SparkSession, root: str, key: str, hash_col: str = "_row_hash", leaves: int = 256):
        self.spark, self.root, self.key, self.hash_col, self.leaves = spark, root.rstrip("/"), key, hash_col, leaves
        self.depth = -(-(leaves.bit_length() - 1) // FAN_BITS)

    def write(self, rows: DataFrame) -> None:
        """Store the rows by bucket and the checksums of every level; level 0 is the root."""
        rows.withColumn("b", bucket_of(self.key, self.leaves)).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/data")
        stored = read_if_there(self.spark, f"{self.root}/data")
        path = f"{self.root}/sums"
        none = self.spark.createDataFrame([], "level int, node long, rows long, total decimal(38,0)")
        if stored is None:
            none.write.mode("overwrite").parquet(path)
            return
        word = F.conv(F.substring(self.hash_col, 1, 15), 16, 10).cast("decimal(20,0)")
        leaf = stored.groupBy(F.col("b").cast("long").alias("node")).agg(F.count("*").alias("rows"), F.sum(word).cast("decimal(38,0)").alias("total"))
        each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("node", FAN_BITS * (self.depth - level)).alias("node"))
                                   for level in range(self.depth + 1)]))
        leaf.select(each.alias("at"), "rows", "total").groupBy("at.level", "at.node").agg(
            F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total")
        ).write.mode("overwrite").parquet(path)

    def sums(self, level: int, under: list[int] | None) -> dict[int, tuple]:
        """Node -> (rows, sum) of one level, restricted to the children of nodes of the level above."""
        found = self.spark.read.parquet(f"{self.root}/sums").filter(F.col("level") == level)
        if under is not None:
            found = found.filter(F.shiftright("node", FAN_BITS).isin(under))
        return {r["node"]: (r["rows"], r["total"]) for r in found.collect()}

    def buckets(self, wanted: list[int]) -> DataFrame | None:
        """The rows of some buckets, from their folders alone; None where none of them has a row."""
        sums = self.spark.read.parquet(f"{self.root}/sums").filter((F.col("level") == self.depth) & F.col("node").isin(wanted))
        held = sorted(r["node"] for r in sums.select("node").collect())
        return self.spark.read.parquet(*[f"{self.root}/data/b={n}" for n in held]) if held else None


def differing(old: HashedTable, new: HashedTable) -> list[int]:
    """Buckets whose rows are not the same."""
    if (old.leaves, old.depth) != (new.leaves, new.depth):
        raise ValueError("tables are compared over the same number of buckets")
    under = None
    for level in range(old.depth + 1):
        a, b = old.sums(level, under), new.sums(level, under)
        under = sorted(n for n in a.keys() | b.keys() if a.get(n) != b.get(n))
        if not under:
            break
    return under


def changes(old: HashedTable, new: HashedTable) -> DataFrame:
    """The inserts, updates and deletes between two stored tables, as ``change_feed`` has them; equal buckets are not
    read."""
    wanted = differing(old, new)
    before, after = old.buckets(wanted), new.buckets(wanted)
    if before is None and after is None:
        sample = read_if_there(new.spark, f"{new.root}/data")
        sample = old.spark.range(0).select(F.col("id").alias(old.key), F.lit("").alias(old.hash_col)) if sample is None else sample
        before = after = sample.limit(0)
    before = after.limit(0) if before is None else before
    after = before.limit(0) if after is None else after
    return change_feed(before, after, new.key, new.hash_col).filter("change_type <> 'unchanged'")
