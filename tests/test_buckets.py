"""Tables that are maintained by what changes."""

import re
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from kinsight.operators import aggregates
from kinsight.sources import buckets
from kinsight.sources.buckets import Buckets, KeyedLog, bucket_of
from kinsight.streaming import incremental


def folders(root, version):
    return {p.name for p in Path(root, "data", f"v={version}").glob("b=*")}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_reads_and_writes_its_own_buckets(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "k", per_bucket=100)
    first = table.replace(spark.range(6_400).selectExpr("id AS k", "0 AS v"), 1)
    assert first.buckets == 64 and sum(first.rows.values()) == 6_400
    changed = spark.createDataFrame([(7, 1), (99_999, 1)], "k long, v int")
    second = table.upsert(2, changed)
    touched = {f"b={r[0]}" for r in changed.select(bucket_of("k", 64)).collect()}
    assert folders(table.root, 2) == touched and len(touched) == 2
    assert {b for b, v in second.holders.items() if v == 2} == {int(x[2:]) for x in touched}
    # the merge is given nothing but these buckets
    seen = []
    table.change(3, changed, lambda old: (seen.extend(old.inputFiles()), old)[1])
    assert {Path(f).parent.name for f in seen} == touched
    assert table.read().count() == 6_401 and rows_of(table.lookup([7, 8, 99_999, -5])) == [(7, 1), (8, 0), (99_999, 1)]
    assert {Path(f).parent.name for f in table.lookup([7]).inputFiles()} < touched


def test_a_replay_changes_nothing_and_unfinished_versions_are_not_seen(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "k", per_bucket=30)
    one, two = spark.range(100).selectExpr("id AS k", "1 AS v"), spark.createDataFrame([(3, 2), (500, 2)], "k long, v int")
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    table.replace(one, 1)
    table.change(2, two, lambda old: add(old, two))
    want = rows_of(table.read())
    table.change(2, two, lambda old: add(old, two))
    assert rows_of(table.read()) == want and (3, 3) in want and len(want) == 101
    spark.range(5).selectExpr("id AS k", "9 AS v").write.parquet(f"{table.root}/data/v=3/b=0")
    assert rows_of(table.read()) == want and rows_of(table.read(below=2)) == rows_of(one)


def test_buckets_follow_the_size(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "k", per_bucket=100)
    assert table.replace(spark.range(10).selectExpr("id AS k"), 1).buckets == 1
    assert table.upsert(2, spark.range(10, 500).selectExpr("id AS k")).buckets == 1
    grown = table.upsert(3, spark.range(500, 510).selectExpr("id AS k"))
    assert grown.buckets == 8 and table.read().count() == 510
    assert table.delete(4, spark.range(100).selectExpr("id AS k")).buckets == 8 and table.read().count() == 410
    assert table.reclaim() == [1, 2, 3] and table.read().count() == 410


def test_large_rows_make_smaller_buckets(spark, tmp_path):
    rows = spark.range(600).selectExpr("id AS k", "repeat('x', 2000) AS v", "transform(sequence(1, 20), i -> struct(repeat('w', 30) AS term, i AS tf)) AS words")
    table = Buckets(spark, str(tmp_path / "t"), "k", per_bucket=1_000, bucket_bytes=200_000)
    made = table.replace(rows, 1)
    assert 2_000 + 20 * 30 < made.row_bytes < 10_000
    assert made.buckets == 16 and max(made.rows.values()) * made.row_bytes < 3 * table.bucket_bytes
    assert len(list(Path(table.root, "data", "v=1").glob("b=*/*.parquet"))) == 16
    assert rows_of(table.read().select("k")) == rows_of(rows.select("k"))
    gone = table.delete(2, spark.range(100).selectExpr("id AS k"))
    assert gone.buckets == 16 and gone.row_bytes == made.row_bytes and sum(gone.rows.values()) == 500
    # a table that starts without rows learns their size from the first ones
    later = Buckets(spark, str(tmp_path / "later"), "k", per_bucket=1_000, bucket_bytes=200_000)
    later.replace(rows.limit(0), 1)
    assert later.upsert(2, rows).buckets == 16 and later.read().count() == 600


def test_empty_tables_and_batches(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "k")
    assert table.read() is None and table.pointer() is None
    none = spark.createDataFrame([], "k string, v int")
    table.replace(none, 1)
    assert table.read().count() == 0 and table.lookup(["a"]).count() == 0
    table.upsert(2, spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"))
    table.upsert(3, none)
    assert table.pointer().version == 3 and table.read().count() == 2


def test_copies_are_emptied_and_deletions_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "run_folder", lambda _, purpose: str(tmp_path / purpose))
    table = Buckets(spark, str(tmp_path / "t"), "k", per_bucket=100, at_once=1)
    made = table.replace(spark.range(6_400).selectExpr("id AS k", "repeat('x', 50) AS v").repartition(7), 1)
    assert made.buckets == 64 and spark.read.parquet(str(tmp_path / "buckets")).count() == 0
    # a deletion is written some buckets at a time, and says the same
    gone, parts = spark.range(0, 6_400, 3).selectExpr("id AS k").repartition(5), []
    opened = table._open
    monkeypatch.setattr(table, "_open", lambda pointer, own=None: (parts.append(own), opened(pointer, own))[1])
    left = table.delete(2, gone)
    step = 2 * spark.sparkContext.defaultParallelism
    assert [len(p) for p in parts] == [step] * (64 // step) and sum(parts, []) == list(range(64)) and len(parts) > 1
    assert rows_of(table.read().select("k")) == [(i,) for i in range(6_400) if i % 3] and sum(left.rows.values()) == 4_266
    assert rows_of(table.read(below=2).select("k")) == [(i,) for i in range(6_400)]
    table.delete(2, gone)
    assert table.read().count() == 4_266 and len(list(Path(table.root, "data", "v=2").glob("b=*/*.parquet"))) == 64


def test_spent_shuffles_give_back_their_space(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before = shuffled()
    Buckets(spark, str(tmp_path / "t"), "k")._write(spark.range(0, 1_000, 1, 30).selectExpr("id AS k"), 1, 4, {}, 8)
    dealt = len(shuffled() - before)
    for _ in range(20):  # the files of 30 tasks go a moment later, those of small counts are left
        if dealt < 30:
            break
        time.sleep(0.5)
        dealt = len(shuffled() - before)
    assert dealt < 30


def contacts(spark, first, last):
    text = "CAST(id % 97 AS STRING) AS customer_id"
    return spark.range(first, last).selectExpr(
        "CAST(id AS STRING) AS interaction_id", text, "if(id % 3 = 0, 'phone', 'chat') AS channel", "if(id % 2 = 0, 'inbound', 'outbound') AS direction",
        "if(id % 5 = 0, 'complaint', 'inquiry') AS disposition", "CAST(timestamp_seconds(1700000000 + id * 3600) AS TIMESTAMP_NTZ) AS interaction_date")


def test_history_is_opened_by_bucket(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "customer_id", per_bucket=400)
    for number, (a, b) in enumerate(((0, 5000), (5000, 5300), (5300, 5310))):
        log.append(contacts(spark, a, b), number)
    log.append(contacts(spark, 5000, 5300), 1)
    assert log.read().count() == 5310
    keys = spark.createDataFrame([("5",), ("5",), ("nobody",)], "customer_id string")
    found = log.of_keys(keys)
    assert rows_of(found.select("interaction_id")) == rows_of(contacts(spark, 0, 5310).filter("customer_id = '5'").select("interaction_id"))
    opened = {str(Path(r[0]).parent) for r in log.read().select("_metadata.file_path").distinct().collect()}
    own = {str(Path(r[0]).parent) for r in log.near(keys).select("_metadata.file_path").distinct().collect()}
    assert 0 < len(own) < len(opened) / 4
    assert log.of_keys(keys, below=1).count() == contacts(spark, 0, 5000).filter("customer_id = '5'").count()


def test_sinks_touch_the_customers_of_the_batch_only(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "customer_id", per_bucket=500)
    serving = Buckets(spark, str(tmp_path / "serving"), "customer_id", per_bucket=12)
    sinks = {
        "fold": incremental.fold_sink(spark, str(tmp_path / "fold"), per_bucket=12),
        "recompute": incremental.recompute_sink(
            spark, log, str(tmp_path / "recompute"), refresh=incremental.serving_refresh(serving), per_bucket=12),
    }
    batches = [contacts(spark, 0, 4000), contacts(spark, 4000, 4003)]
    for name, sink in sinks.items():
        for number, rows in enumerate(batches):
            sink(rows, number)
        sink(batches[1], 1)
        assert len(folders(tmp_path / name, 2)) <= 3 < len(folders(tmp_path / name, 1))
    want = rows_of(aggregates.agg_customer_interaction(contacts(spark, 0, 4003)))
    for name in sinks:
        assert rows_of(Buckets(spark, str(tmp_path / name), "customer_id").read()) == want
    assert rows_of(serving.read()) == want
    assert datetime(2024, 1, 1) < max(r[4] for r in want)
