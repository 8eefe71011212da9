"""Duplicate suppression whose cost does not follow the history."""

from pathlib import Path

from pyspark.sql import functions as F

from kinsight.sources.known import KnownKeys
from kinsight.streaming import incremental


def test_only_files_that_may_hold_a_key_are_opened(spark, tmp_path):
    known = KnownKeys(spark, str(tmp_path / "known"), "k")
    for batch in range(12):
        known.add(spark.range(batch * 1000, batch * 1000 + 1000).selectExpr("id AS k"), batch)
    files = list(Path(tmp_path / "known" / "keys").rglob("*.parquet"))
    fresh, opened = known.unseen(spark.range(12_000, 13_000).selectExpr("id AS k"), 12)
    assert opened == [] and fresh.count() == 1000
    # a duplicate from the first batch, far older than any recent past
    late = spark.range(12_000, 12_100).selectExpr("id AS k").unionByName(spark.createDataFrame([(17,), (17,)], "k long"))
    fresh, opened = known.unseen(late, 12)
    assert fresh.count() == 100 and len(opened) == 1 and "batch=0" in opened[0] and len(files) >= 12
    # what is opened does not follow the number of batches
    for batch in range(12, 18):
        known.add(spark.range(batch * 1000, batch * 1000 + 1000).selectExpr("id AS k"), batch)
    again = spark.range(18_000, 18_100).selectExpr("id AS k").unionByName(spark.createDataFrame([(17,)], "k long"))
    assert known.unseen(again, 18)[1] == opened
    # a batch is never compared with itself or later ones
    assert known.unseen(spark.createDataFrame([(17_500,)], "k long"), 17)[0].count() == 1


def test_filters_tell_apart_keys_in_no_order(spark, tmp_path):
    known = KnownKeys(spark, str(tmp_path / "known"), "k")
    name = F.sha2(F.col("id").cast("string"), 256).alias("k")
    for batch in range(4):
        known.add(spark.range(batch * 500, batch * 500 + 500).select(name), batch)
    asked = spark.range(2000, 2003).select(name)
    fresh, opened = known.unseen(asked.unionByName(spark.range(600, 601).select(name)), 4)
    assert fresh.count() == 3 and any("batch=1" in f for f in opened)
    assert len(opened) < len(list(Path(tmp_path / "known" / "keys").rglob("*.parquet"))) / 2
    everything = spark.range(0, 2500).select(name)
    assert known.unseen(everything, 4)[0].count() == 500


def test_sink_suppresses_old_and_repeated_deliveries(spark, tmp_path):
    table = str(tmp_path / "out")
    sink = incremental.insert_only_sink(spark, table, "k")
    rows = lambda a, b, v: spark.range(a, b).selectExpr("id AS k", f"{v} AS v")
    assert incremental.stored_batches(spark, table) is None
    sink(rows(0, 100, 0), 0)
    sink(rows(50, 150, 1), 1)
    sink(rows(50, 150, 1), 1)
    sink(rows(0, 10, 2).limit(0), 2)
    sink(rows(0, 160, 3), 3)
    got = sorted((r.k, r.v) for r in incremental.stored_batches(spark, table).collect())
    assert got == [(k, 0 if k < 100 else 1 if k < 150 else 3) for k in range(160)]
    assert incremental.stored_batches(spark, table, below=1).count() == 100
