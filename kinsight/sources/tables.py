"""Merging into stored tables: upsert, insert-only, surrogate keys, versioned snapshots, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.session import run_folder, shared_root
from kinsight.sources.buckets import Buckets


def upsert(target: DataFrame, source: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Matched rows take the source values, keep ``_loaded_at`` and get a new ``_processed_at``;
    unmatched source rows are inserted; other target rows stay as they are.

    One full-outer equi-join on the business key, which is unique on both sides.
    """
    business = [c for c in source.columns if c not in ("_loaded_at", "_processed_at", *keys)]
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("o"))
    new = source.select(*keys, F.struct(*[F.col(c) for c in business], F.lit(True).alias("_hit")).alias("n"))
    hit = F.col("n").isNotNull()
    return old.join(new, keys, "full_outer").select(
        *keys,
        *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in business],
        F.coalesce("o._loaded_at", now).alias("_loaded_at"),
        F.when(hit, now).otherwise(F.col("o._processed_at")).alias("_processed_at"),
    )


def one_per_key(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key, the one with the greatest ``by``; a merge needs unique keys on both sides."""
    others = [c for c in rows.columns if c not in (key, by)]
    best = rows.groupBy(key).agg(F.max(F.struct(by, *others)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in (by, *others)])


def insert_only(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the target does not have yet; existing keys are never reprocessed."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def dense_keys(df: DataFrame, key: str, name: str, start: int | Column = 0) -> DataFrame:
    """Numbers start+1, start+2, ... in key order, without a single-task sort.

    Rows are range-partitioned and sorted on the key; a row's number is its
    position in its partition plus the size of all earlier partitions. The
    numbered rows are checkpointed first, so that both uses see the same
    partitions even when an executor is lost in between.
    """
    shared_root(df.sparkSession)
    position = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(F.col(key).asc()).sortWithinPartitions(key).select(
        "*", F.shiftright(position, 33).cast("int").alias("_part"),
        position.bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    ).checkpoint()
    # one row per partition: bounded by the partition count, hence safe to broadcast
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_pos") + start + 1).drop(
        "_part", "_pos", "_offset"
    )


def hash_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """Surrogate key from the business key alone: no numbering, no shuffle, stable across rebuilds and loads. It has
    128 bits, so that two keys never share one at any table size."""
    return df.withColumn(name, F.md5(F.col(key).cast("string").cast("binary")))


def next_keys(existing: DataFrame, incoming: DataFrame, key: str, name: str) -> DataFrame:
    """Existing rows keep their surrogate key; new business keys continue after the highest one."""
    highest = existing.agg(F.coalesce(F.max(name), F.lit(0))).scalar()
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return existing.select(key, name).unionByName(dense_keys(fresh, key, name, highest).select(key, name))


# --- serving tables ----------------------------------------------------------------------------------------------

SERVING_BUCKETS = 64


def _serving_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_serving(df: DataFrame, path: str, key: str, buckets: int = SERVING_BUCKETS) -> None:
    """Store a table for reads of single keys: partitioned by a hash of the key, sorted inside, so that a read opens
    one folder and skips the row groups without the key."""
    df.withColumn("_bucket", _serving_bucket(F.col(key), buckets)).repartition("_bucket").sortWithinPartitions(key) \
        .write.mode("overwrite").partitionBy("_bucket").parquet(path)


def read_serving(spark: SparkSession, path: str, key: str, values: list, buckets: int = SERVING_BUCKETS) -> DataFrame:
    """The rows of the given keys; their buckets are constants of the plan and prune the scan."""
    table = spark.read.parquet(path)
    own = [_serving_bucket(F.lit(v), buckets) for v in values]
    return table.filter(F.col("_bucket").isin(*own) & F.col(key).isin(values)).drop("_bucket")


def refresh_serving(changed: DataFrame, path: str, key: str, buckets: int = SERVING_BUCKETS) -> None:
    """Exchange the rows of the changed keys. Only buckets that hold one are read and written again; they are put
    together in the shared folder first, because a folder can't be read and replaced at once."""
    spark = changed.sparkSession
    fresh = changed.withColumn("_bucket", _serving_bucket(F.col(key), buckets))
    table = spark.read.parquet(path)
    touched = table.join(fresh.select("_bucket").distinct(), "_bucket", "left_semi")
    merged = touched.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*table.columns))
    staged = run_folder(spark, "serving")
    merged.write.parquet(staged)
    spark.read.schema(merged.schema).parquet(staged).repartition("_bucket").sortWithinPartitions(key).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


# --- stored versions -------------------------------------------------------------------------------------------


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write version ``version`` of a table to its own folder. A rerun of the same version replaces only itself."""
    path = f"{root.rstrip('/')}/v{version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """Newest complete version (below a given one), or None. A version counts once its success marker exists; tables in
    buckets know their versions themselves."""
    bucketed = Buckets(spark, root, "").read(below)
    if bucketed is not None:
        return bucketed
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = []
    for status in fs.listStatus(folder):
        version = status.getPath().getName()
        complete = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        if complete and version.startswith("v") and (below is None or int(version[1:]) < below):
            found.append(version)
    return spark.read.parquet(f"{root.rstrip('/')}/{max(found)}") if found else None


def append_log(df: DataFrame, path: str, batch: str) -> None:
    """Append one batch to a log of decisions. A batch owns its folder, so one that is retried stands once."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
