import hashlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kinsight.functions.hashing import row_hash, table_checksum
from kinsight.operators import curated
from kinsight.schemas import SCHEMAS
from kinsight.sources import landing, tables

NOW = "TIMESTAMP_NTZ '2025-01-02 00:00:00'"
REPS = "representative_id,name,role,active,team\n"


def write(tmp_path, text, name="reps.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_csv_keeps_quotes_breaks_and_nulls(spark, tmp_path):
    path = write(tmp_path, REPS + 'R1,"A ""B"", C\nD",service_rep,TRUE,\nR2, x ,supervisor,FALSE,t\n')
    rows = landing.read_strict(spark, path, SCHEMAS["service_representatives"], multi_line=True).orderBy("representative_id").collect()
    assert rows[0].name == 'A "B", C\nD' and rows[0].team is None and rows[1].name == " x "


@pytest.mark.parametrize("line", ["R1,only,three", "R1,a,b,c,d,too,many"])
def test_strict_load_aborts_on_wrong_column_count(spark, tmp_path, line):
    path = write(tmp_path, REPS + line + "\n")
    with pytest.raises(Exception):
        landing.read_strict(spark, path, SCHEMAS["service_representatives"]).collect()


def test_lenient_load_splits_rejects(spark, tmp_path):
    text = "coverage_id,policy_id,coverage_type,limit_amount,deductible_amount\nV1,P1,a,10,1\nV2,P1,a,ten,1\nV3,P1\n"
    landed = landing.land_lenient(spark, write(tmp_path, text), SCHEMAS["coverages"], str(tmp_path / "landed"))
    good, bad = landing.split_rejects(landed)
    assert [r.coverage_id for r in good.collect()] == ["V1"]
    assert sorted(r._corrupt_record for r in bad.collect()) == ["V2,P1,a,ten,1", "V3,P1"]


def test_load_stamps_and_checks(spark, tmp_path):
    path = write(tmp_path, REPS + "R1,a,service_rep,TRUE,\nR2,b,service_rep,TRUE,x\n")
    df = landing.load_table(spark, "service_representatives", path, "B1", datetime(2025, 1, 1))
    row = landing.load_check({"reps": df}, spark.createDataFrame([("reps", 2)], "table_name string, expected_rows long")).first()
    assert row.status == "PASS" and row.min_hash_length == 64
    assert landing.load_check({"reps": df}, spark.createDataFrame([("reps", 3)], "table_name string, expected_rows long")).first().status == "FAIL"
    assert {r._source_file for r in df.collect()} == {"reps.csv"}


def test_manifest_detects_change(spark, tmp_path):
    write(tmp_path, "a\n", "a.csv"), write(tmp_path, "b\n", "b.csv")
    manifest = spark.createDataFrame(
        [tuple(r) for r in landing.file_manifest(spark, str(tmp_path)).collect()], "filename string, bytes long, sha256 string")
    write(tmp_path, "changed\n", "b.csv"), write(tmp_path, "c\n", "c.csv")
    found = landing.verify_manifest(landing.file_manifest(spark, str(tmp_path)), manifest)
    assert {r.filename: r.status for r in found.collect()} == {"a.csv": "ok", "b.csv": "changed", "c.csv": "unlisted"}


def test_large_files_are_hashed_by_ranges(spark, tmp_path):
    folder, into = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    records = ["id,text"] + [f'{i},"said ""{i}""\n\nand more, {"y" * (i % 50)}"' if i % 3 else f"{i},plain" for i in range(4000)]
    write(folder, "\n".join(records) + "\n", "big.csv"), write(folder, "", "empty.csv"), write(folder, "id\n", "header.csv")
    write(folder, "id\r\n1\r\n\r\n2", "crlf.csv"), write(folder, "x", "other.txt")
    write(folder, "id\n" + "z" * 30_000 + "\n2\n", "longline.csv")
    (folder / "latin.csv").write_bytes(b"id\n\xe9\xff\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = {r.filename: r for r in landing.block_manifest(spark, str(folder), into, block_bytes=10_000).collect()}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert {n: r.rows for n, r in rows.items()} == {
        "big.csv": 4000, "header.csv": 0, "crlf.csv": 2, "longline.csv": 2, "latin.csv": 1}
    size = (folder / "big.csv").stat().st_size
    assert rows["big.csv"].bytes == size and rows["big.csv"].blocks == -(-size // 10_000) > 10
    # the digest by hand: a line belongs to the range it begins in
    data, ranges, at = (folder / "big.csv").read_bytes(), {}, 0
    for line in data.split(b"\n")[:-1]:
        ranges.setdefault(max(at - 1, 0) // 10_000, hashlib.sha256()).update(line + b"\n")
        at += len(line) + 1
    joined = ",".join(ranges[k].hexdigest() for k in sorted(ranges))
    assert rows["big.csv"].sha256 == hashlib.sha256(f"{size}:{joined}".encode()).hexdigest()
    again = {r.filename: r.sha256 for r in landing.block_manifest(spark, str(folder), into + "2", block_bytes=10_000).collect()}
    assert again == {n: r.sha256 for n, r in rows.items()}
    at = size // 2
    (folder / "big.csv").write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    (folder / "crlf.csv").write_text("id\n1\n\n2\n", encoding="utf-8")
    found = landing.verify_manifest(landing.block_manifest(spark, str(folder), into + "3", block_bytes=10_000), spark.createDataFrame(
        [(n, r.sha256) for n, r in rows.items()], "filename string, sha256 string"))
    assert {r.filename for r in found.collect() if r.status != "ok"} == {"big.csv", "crlf.csv"}


def test_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(row_hash(df, ["x", "y", "z"]).alias("h")).distinct().count() == 2


def test_checksum_ignores_layout(spark):
    df = spark.range(100).withColumn("d", F.lit(Decimal("1.50")))
    a, b = (table_checksum(x, ["id", "d"]).first() for x in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert a == b and table_checksum(df.filter("id > 0"), ["id", "d"]).first() != a


def test_upsert_and_insert_only(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn(
        "_loaded_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).withColumn("_processed_at", F.col("_loaded_at"))
    source = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "k int, v string")
    out = {r.k: r for r in tables.upsert(target, source.distinct(), ["k"], F.expr(NOW)).collect()}
    assert [out[k].v for k in (1, 2, 3)] == ["a", None, "c"]
    assert out[2]._loaded_at.year == 2024 and out[2]._processed_at.year == 2025 and out[1]._processed_at.year == 2024
    assert [r.k for r in tables.insert_only(target, source, "k").collect()] == [3]


def test_surrogate_keys_are_dense_and_stable(spark):
    first = tables.dense_keys(spark.range(0, 1000, 2).selectExpr("id AS k"), "k", "sk")
    again = {r.k: r.sk for r in tables.next_keys(first, spark.range(1000).selectExpr("id AS k"), "k", "sk").collect()}
    assert sorted(again.values()) == list(range(1, 1001))
    assert all(again[r.k] == r.sk for r in first.collect()) and again[0] == 1
    hashed = tables.hash_keys(spark.range(1000).selectExpr("id AS k"), "k", "sk")
    assert hashed.select("sk").distinct().count() == 1000


def test_snapshots_ignore_incomplete_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.latest_snapshot(spark, root) is None
    for version in (1, 2):
        tables.write_snapshot(spark.range(version), root, version)
    (tmp_path / "t" / "v000000000002" / "_SUCCESS").unlink()
    assert tables.latest_snapshot(spark, root).count() == 1


def test_scd2_and_change_feed(spark):
    def version(rows):
        df = spark.createDataFrame(rows, "k int, v string")
        return df.withColumn("_row_hash", row_hash(df, ["k", "v"]))

    old, new = version([(1, "a"), (2, "b"), (3, "c")]), version([(1, "a"), (2, "B"), (4, "d")])
    history = old.withColumn("valid_from", F.lit(date(2025, 1, 1))).withColumn(
        "valid_to", F.lit(None).cast("date")).withColumn("is_current", F.lit(True))
    out = curated.scd2_apply(history, new, "k", F.lit(date(2025, 2, 1)))
    current = {r.k: r.v for r in out.filter("is_current").collect()}
    assert current == {1: "a", 2: "B", 4: "d"} and out.count() == 5
    assert out.filter("not is_current and valid_from >= valid_to").count() == 0
    feed = {r.k: r.change_type for r in curated.change_feed(old, new, "k").collect()}
    assert feed == {1: "unchanged", 2: "update", 3: "delete", 4: "insert"}


def test_a_retried_append_stands_once(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_log(spark.range(3), path, "s-0")
    for _ in range(2):
        tables.append_log(spark.range(3, 5), path, "s-1")
    log = tables.read_log(spark, path)
    assert log.columns == ["id"] and sorted(r.id for r in log.collect()) == [0, 1, 2, 3, 4]


def test_load_figures_come_from_what_was_written(spark, tmp_path):
    from kinsight.sources.loads import LandedTable

    rows = spark.range(50).selectExpr(
        "id", "if(id % 10 = 0, null, sha2(string(id), 256)) AS _row_hash", "'b' AS _batch_id",
        "if(id = 3, null, timestamp_ntz '2024-01-01 00:00:00') AS _loaded_at", "'f' AS _source_file")
    table = LandedTable(spark, str(tmp_path / "t"))
    got = table.load(rows, 1, full=True)
    assert (got["rows"], got["null_hashes"], got["min_hash_length"], got["rejected"]) == (50, 5, 64, 0)
    assert got["first_id"] == got["last_id"] == "b" and got["is_full"] and got["audit_nulls"] >= 1
    assert all(f.endswith(".zstd.parquet") for f in table.read().inputFiles())
    none = table.load(rows.limit(0), 2)
    assert (none["rows"], none["null_hashes"], none["min_hash_length"]) == (0, 0, None)


def test_sessions_share_one_ranking(spark):
    from kinsight.plans.queries import Decisions
    from kinsight.plans.pipeline import Build
    from kinsight.sources.testbed import SETTINGS, Testbed

    made = Decisions(Build(Testbed(spark, "/root/testdata/sf0.001"), SETTINGS))
    assert made.log.count() > 0
    assert all("/decision_primary/" in f for f in made.primary.inputFiles()) and made.primary.inputFiles()
