"""Row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(df: DataFrame, name: str) -> Column:
    """Column as text with '' for NULL, dates and timestamps in a pinned format.

    ``concat_ws`` skips NULLs, which would let ('a', NULL, 'b') and
    ('a', 'b', NULL) share a hash, so NULL is spelled out.
    """
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.DateType):
        value = F.date_format(value, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(value.cast("string"), F.lit(""))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over the '|'-joined text of ``columns``."""
    return F.sha2(F.concat_ws("|", *[as_text(df, c) for c in columns]), 256)


def with_missing_hashes(df: DataFrame, columns: list[str], target: str = "_row_hash") -> DataFrame:
    """Fill ``target`` only where it is still NULL."""
    return df.withColumn(target, F.coalesce(F.col(target), row_hash(df, columns)))


def table_checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-insensitive fingerprint of a table: row count plus the exact sum of row hashes.

    Each row contributes the first 15 hex digits of its SHA-256; the sum is a
    decimal, so partial sums merge in any order without overflow or rounding.
    """
    word = F.conv(F.substring(row_hash(df, columns), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(word.alias("_word")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum("_word"), F.lit(0)).cast("string").alias("checksum"),
    )
