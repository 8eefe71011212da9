"""Late snapshots, checksum trees, loads with figures."""

import random
from datetime import date, datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from kinsight.functions.hashing import row_hash
from kinsight.operators import curated
from kinsight.schemas import SCHEMAS
from kinsight.sources.checksums import HashedTable, changes, differing
from kinsight.sources.loads import LandedTable, check


def snapshot(spark, state):
    df = spark.createDataFrame(list(state.items()), "k int, v string")
    return df.withColumn("_row_hash", row_hash(df, ["k", "v"]))


def expected(snapshots):
    """The history read off the snapshots in order of their dates."""
    out, dates = [], sorted(snapshots)
    for k in {k for s in snapshots.values() for k in s}:
        start = None
        for i, d in enumerate(dates):
            value, after = snapshots[d].get(k), None if i + 1 == len(dates) else snapshots[dates[i + 1]].get(k)
            if value is None:
                continue
            start = start or d
            if i + 1 == len(dates):
                out.append((k, value, start, None, True))
            elif after != value:
                out.append((k, value, start, dates[i + 1], False))
                start = None
    return sorted(out, key=str)


def test_any_order_of_arrival_gives_one_history(spark):
    rng = random.Random(9)
    days = [date(2025, 1, d) for d in (1, 5, 9, 20)]
    snapshots = {d: {k: rng.choice("ab") for k in range(40) if rng.random() < 0.8} for d in days}
    want = expected(snapshots)
    for order in list(permutations(days))[::3]:
        history = snapshot(spark, {}).withColumn("valid_from", F.lit(None).cast("date")).withColumn(
            "valid_to", F.lit(None).cast("date")).withColumn("is_current", F.lit(True))
        for i, day in enumerate(order):
            history = curated.scd2_insert(history, snapshot(spark, snapshots[day]), "k", day, list(order[:i]))
        again = curated.scd2_insert(history, snapshot(spark, snapshots[days[1]]), "k", days[1], days)
        rows = [sorted((tuple(r) for r in h.select("k", "v", "valid_from", "valid_to", "is_current").collect()), key=str) for h in (history, again)]
        assert rows == [want, want]


def test_one_changed_row_of_a_million_reads_one_bucket(spark, tmp_path):
    rows = spark.range(1_000_000).selectExpr("id AS k", "md5(CAST(id AS STRING)) AS _row_hash")
    old, new = (HashedTable(spark, str(tmp_path / n), "k", leaves=64) for n in ("old", "new"))
    old.write(rows)
    new.write(rows.withColumn("_row_hash", F.when(F.col("k") == 77, F.md5(F.lit("other").cast("binary"))).otherwise(F.col("_row_hash"))))
    assert len(differing(old, new)) == 1 and differing(old, old) == []
    found = changes(old, new)
    assert [tuple(r) for r in found.collect()] == [(77, "update", "INSERT", True)]
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1
    assert changes(old, old).count() == 0


def test_changes_equal_the_whole_comparison(spark, tmp_path):
    rng = random.Random(2)
    states = [{k: rng.choice("ab") for k in range(300) if rng.random() < 0.9} for _ in range(2)] + [{}]
    frames = [snapshot(spark, s) for s in states]
    tables = [HashedTable(spark, str(tmp_path / str(i)), "k", leaves=32) for i in range(3)]
    for table, frame in zip(tables, frames, strict=True):
        table.write(frame)
    for i, j in ((0, 1), (1, 0), (0, 2), (2, 1), (2, 2)):
        want = curated.change_feed(frames[i], frames[j], "k").filter("change_type <> 'unchanged'")
        assert sorted(map(tuple, changes(tables[i], tables[j]).collect())) == sorted(map(tuple, want.collect()))


def landed(spark, n, batch="B", spoilt=False):
    rows = spark.range(n).selectExpr("id AS k", f"'{batch}' AS _batch_id", "'f.csv' AS _source_file", "TIMESTAMP_NTZ '2025-01-01 00:00:00' AS _loaded_at")
    whole = rows.withColumn("_row_hash", row_hash(rows, ["k"]))
    return whole.withColumn("_row_hash", F.when(F.col("k") > 1, F.col("_row_hash"))) if spoilt else whole


def test_loads_are_repeatable_and_carry_their_figures(spark, tmp_path):
    table = LandedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.load(landed(spark, 10), 1, full=True)
    table.load(landed(spark, 5), 2)
    table.load(landed(spark, 5), 2)
    assert table.read().count() == 15
    row = table.figures("t").first()
    assert (row["rows"], row.null_hashes, row.min_hash_length, row.audit_nulls, row.rejected, row.loads) == (15, 0, 64, 0, 0, 2)
    # a batch without its mark is not there, and a full load replaces what came before it
    landed(spark, 100).write.parquet(f"{table.root}/data/batch=3")
    assert table.read().count() == 15
    for _ in range(2):
        table.load(landed(spark, 7, spoilt=True), 4, full=True)
        assert table.read().count() == 7
    wanted = spark.createDataFrame([("t", 7)], "table_name string, expected_rows long")
    failed = check(table.figures("t"), wanted).first()
    assert (failed.rows_loaded, failed.null_hashes, failed.status) == (7, 2, "FAIL")
    # figures are read from the marks: no file of the table is opened
    assert all("/loads/" in f for f in table.figures("t").inputFiles())


def test_rejects_are_counted_while_loading(spark, tmp_path):
    from kinsight.sources import landing

    (tmp_path / "in.csv").write_text("V1,P1,a,10,1\nV2,P1,a,ten,1\nV3,P1\n")
    raw = landing.read_lenient(spark, str(tmp_path / "in.csv"), SCHEMAS["coverages"], header=False)
    table = LandedTable(spark, str(tmp_path / "t"))
    figures = table.load(raw, 1)
    assert (figures["rows"], figures["rejected"], figures["null_hashes"]) == (3, 2, None)
    none = LandedTable(spark, str(tmp_path / "none"))
    assert none.load(landed(spark, 0), 1)["rows"] == 0 and none.read().count() == 0


@pytest.mark.parametrize("moment", [datetime(2024, 1, 1)])
def test_load_marks_keep_the_ids_of_their_batch(spark, tmp_path, moment):
    table = LandedTable(spark, str(tmp_path / "t"))
    table.load(landed(spark, 2, batch="B1"), 1)
    row = table.marks().first()
    assert (row.first_id, row.last_id) == ("B1", "B1")
