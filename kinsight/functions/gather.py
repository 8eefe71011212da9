"""Ordered gathering of all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, key: str, bucket: Column, order: list[Column], item: Column) -> DataFrame:
    """(key, items): one array per key with every row's item, in the order (bucket, order).

    Rows meet per (key, bucket) first and are sorted there, so that the work on a key with very many rows is spread
    over its buckets; what meets per key is one sorted array per bucket, which only needs to be laid end to end.
    """
    rows = df.select(key, bucket.alias("_b"), F.struct(*order).alias("_o"), item.alias("_i"))
    parts = rows.groupBy(key, "_b").agg(F.sort_array(F.collect_list(F.struct("_o", "_i"))).alias("_p"))
    whole = parts.select(key, F.struct("_b", F.col("_p._i").alias("_items")).alias("_part")).groupBy(key)
    return whole.agg(F.sort_array(F.collect_list("_part")).alias("_parts")).select(
        key, F.flatten("_parts._items").alias("items")
    )
