"""CSV landing: declared schemas, strict and lenient loads, audit stamps, load checks, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsight.functions.hashing import with_missing_hashes
from kinsight.schemas import SCHEMAS

# Comma separated, header row, '"' quoting, empty field = NULL, no trimming, UTF-8.
CSV_FORMAT = {
    "header": "true", "sep": ",", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
    "encoding": "UTF-8", "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    # the column count of every row is checked, also when only some columns are used
    "columnPruning": "false", "enforceSchema": "false",
    "dateFormat": "yyyy-MM-dd",
}


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def read_strict(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Any malformed row aborts the load.

    Files are split between tasks; ``multi_line`` allows line breaks inside
    quoted fields, at the price of one task per file.
    """
    options = {**CSV_FORMAT, "multiLine": str(multi_line).lower()}
    return spark.read.options(**options).option("mode", "FAILFAST").schema(nullable(schema)).csv(path)


def read_lenient(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, header: bool = True
) -> DataFrame:
    """Malformed rows are kept aside: their text is in ``_corrupt_record`` (NULL for good rows)."""
    options = {**CSV_FORMAT, "multiLine": str(multi_line).lower(), "header": str(header).lower(),
               "enforceSchema": "true"}
    full = nullable(schema).add("_corrupt_record", T.StringType())
    return spark.read.options(**options).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").schema(full).csv(path)


def land_lenient(
    spark: SparkSession, path: str, schema: T.StructType, target: str, multi_line: bool = False, header: bool = True
) -> DataFrame:
    """Lenient load: every row is parsed in full and stored at ``target``, rejects with their text.

    Judging rows on the raw reader would not do: it skips the fields a query
    does not ask for, and with them their errors.
    """
    read_lenient(spark, path, schema, multi_line, header).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def split_rejects(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("_corrupt_record").isNotNull()
    return loaded.filter(~bad).drop("_corrupt_record"), loaded.filter(bad)


def write_csv(df: DataFrame, path: str) -> None:
    """Write in the landing format (used for hand-over files and round-trip checks)."""
    df.write.mode("overwrite").options(
        header="true", quote='"', escape='"', nullValue="", emptyValue='""', encoding="UTF-8",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def stamp_audit(df: DataFrame, batch_id: str, loaded_at: datetime, business: list[str] | None = None) -> DataFrame:
    """Add load time, source file, batch id and row hash to rows read from files."""
    columns = business or df.columns
    stamped = df.select(
        "*",
        F.lit(loaded_at.isoformat()).cast("timestamp_ntz").alias("_loaded_at"),
        F.col("_metadata.file_name").alias("_source_file"),
        F.lit(batch_id).alias("_batch_id"),
        F.lit(None).cast("string").alias("_row_hash"),
    )
    return with_missing_hashes(stamped, columns)


def load_table(
    spark: SparkSession, name: str, path: str, batch_id: str, loaded_at: datetime, multi_line: bool = False
) -> DataFrame:
    """Strict load of one declared landing table with its audit columns."""
    return stamp_audit(read_strict(spark, path, SCHEMAS[name], multi_line), batch_id, loaded_at)


def load_check(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Per table: rows loaded, missing hashes, shortest hash, PASS/FAIL. ``expected`` (table_name, expected_rows) comes
    from a manifest or the files themselves; a table it doesn't name is not compared."""
    out = None
    for name, df in tables.items():
        row = df.agg(
            F.count("*").alias("rows_loaded"),
            (F.count("*") - F.count("_row_hash")).alias("null_hashes"),
            F.min(F.length("_row_hash")).alias("min_hash_length"),
        ).select(F.lit(name).alias("table_name"), "rows_loaded", "null_hashes", "min_hash_length")
        out = row if out is None else out.unionByName(row)
    counts_match = F.coalesce(F.col("rows_loaded") == F.col("expected_rows"), F.lit(True))
    good = counts_match & (F.col("null_hashes") == 0) & (F.col("min_hash_length") == 64)
    return out.join(expected, "table_name", "left").withColumn("status", F.when(good, "PASS").otherwise("FAIL")).drop("expected_rows")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Name, size and SHA-256 of each file. Files are hashed one per task and must fit binaryFile's size limit;
    ``block_manifest`` has none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


BLOCK = "filename string, path string, bytes long, start long, sha256 string, quotes long, rows_even long, rows_odd long"


def _block_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of a file, from its lines in order: their digest, how many quotes they have, and how many
    records end in them if the block begins outside (even) or inside (odd) a quoted field."""
    schema = pa.schema([("filename", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("start", pa.int64()), ("sha256", pa.string()),
                        ("quotes", pa.int64()), ("rows_even", pa.int64()), ("rows_odd", pa.int64())])
    now, digest, quotes, even, odd = None, None, 0, 0, 0

    def closed() -> pa.RecordBatch:
        path, size, start = now
        row = (path.rsplit("/", 1)[-1], path, size, start, digest.hexdigest(), quotes, even, odd)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        names, sizes, begins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "bytes", "start"))
        new = np.flatnonzero((names[1:] != names[:-1]) | (begins[1:] != begins[:-1])) + 1
        for a, b in zip([0, *new], [*new, len(names)], strict=True):
            if b == a:
                continue
            if now != (names[a], int(sizes[a]), int(begins[a])):
                if now is not None:
                    yield closed()
                now, digest, quotes, even, odd = (names[a], int(sizes[a]), int(begins[a])), hashlib.sha256(), 0, 0, 0
            lines = batch.column("line").slice(a, b - a)
            for line in lines:
                digest.update(line.as_buffer() or b"")
                digest.update(b"\n")
            # a record ends where the quotes so far are even; a blank line outside quotes is no record
            inside = (quotes + np.cumsum(pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False))) & 1
            filled = np.not_equal(pc.binary_length(lines).to_numpy(zero_copy_only=False), 0) & ~pc.equal(lines, pa.scalar(b"\r", lines.type)).to_numpy(zero_copy_only=False)
            even += int((filled & (inside == 0)).sum())
            odd += int((filled & (inside == 1)).sum())
            # blank lines inside quotes neither end a record nor add quotes, so they need no care
            quotes += int(pc.sum(pc.count_substring(lines, b'"')).as_py())
    if now is not None:
        yield closed()


def block_manifest(spark: SparkSession, folder: str, into: str, pattern: str = "*.csv", block_bytes: int = 128 << 20,
                   header: bool = True) -> DataFrame:
    """(filename, path, bytes, rows, blocks, sha256) of each CSV file, stored in ``into``; for files of any size.

    A file is read in ranges of ``block_bytes``, one task each, however many executors there are. A line belongs to the
    range it begins in. Each range gives the SHA-256 of its lines, and a file's digest is the SHA-256 of its size and
    its ranges' digests in order: it depends on the bytes and on ``block_bytes`` alone, and two manifests compare where
    these are equal. ``rows`` counts records in the same pass, without the header line; line breaks inside quotes end
    none, and blank lines are none. Driver and tasks see a row per
    range. Spark's readers pass over files of no bytes, so these are not listed.
    """
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    try:
        # with both alike a range is exactly so long, whatever the size of the folder and the number of cores
        for name in names[:2]:
            spark.conf.set(name, str(block_bytes))
        spark.conf.unset(names[2])
        lines.mapInArrow(_block_digests, BLOCK).write.mode("overwrite").parquet(f"{into}/blocks")
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    blocks = spark.read.schema(BLOCK).parquet(f"{into}/blocks")
    inside = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.withColumn("open", F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2).groupBy("path").agg(
        F.sum(F.when(F.col("open") == 0, F.col("rows_even")).otherwise(F.col("rows_odd"))).alias("records"),
        F.count("*").alias("blocks"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "sha256"))), lambda x: x["sha256"]), ",").alias("digests"))
    # names and sizes alone: the content of the files is not read
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    records = F.coalesce(F.col("records"), F.lit(0))
    made = files.join(counted, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "bytes",
        (F.greatest(records - 1, F.lit(0)) if header else records).cast("long").alias("rows"),
        F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"),
        F.sha2(F.concat_ws(":", F.col("bytes").cast("string"), F.coalesce("digests", F.lit(""))), 256).alias("sha256"))
    made.write.mode("overwrite").parquet(f"{into}/files")
    return spark.read.schema(made.schema).parquet(f"{into}/files")


def verify_manifest(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (filename, sha256) against the files found: ok / changed / missing / unlisted."""
    want = manifest.select("filename", F.col("sha256").alias("expected"))
    have = actual.select("filename", F.col("sha256").alias("found"))
    return want.join(have, "filename", "full_outer").withColumn(
        "status",
        F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unlisted")
        .when(F.col("found") == F.col("expected"), "ok").otherwise("changed"),
    )
