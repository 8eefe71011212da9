"""Tables that are maintained by what changes: hash buckets, of which a batch writes new versions of the touched ones.

    root/data/v=<version>/b=<bucket>/...    rows of a bucket as of a version
    root/pointer/v=<version>/...            one row per bucket: the version that holds it, and its rows

The pointer of a version is written last. A reader takes the newest pointer and opens exactly the folders it names; a
version without a pointer was never finished and is not seen. A batch that is repeated builds on the pointer below its
own number, and so replaces what it wrote itself and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsight.session import emptied, run_folder, spent_shuffles_dropped

POINTER = "bucket long, version long, rows long, buckets long, columns string, row_bytes long"


def bucket_of(key: str | Column, buckets: int) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(buckets)).cast("long")


def size_of(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.StructType):
        size = sum((size_of(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        size = sum((size_of(value.getField(f.name), T.ArrayType(f.dataType)) for f in kind.elementType.fields), 16 * F.size(value))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.concat_ws("", value)) + 16 * F.size(value)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.BinaryType)):
        size = 8 * F.size(value)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = 2 * F.octet_length(F.to_json(value))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(8)).cast("long")


def row_size(df: DataFrame) -> Column:
    return sum((size_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing has been written. A known schema saves looking for it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass(frozen=True)
class Pointer:
    """Which version holds each bucket; ``rows`` counts a bucket's rows, none for an empty bucket. ``row_bytes`` is what
    a row takes on average."""

    version: int
    buckets: int
    schema: T.StructType
    holders: dict[int, int]
    rows: dict[int, int]
    row_bytes: int = 0

    def folders(self, root: str, buckets: list[int] | None = None) -> list[str]:
        wanted = self.holders if buckets is None else [b for b in buckets if b in self.holders]
        return [f"{root}/data/v={self.holders[b]}/b={b}" for b in wanted]


class Buckets:
    """One maintained table.

    ``per_bucket`` is how many rows a bucket should hold, fewer where rows are so large that they would pass
    ``bucket_bytes``, for a bucket is written by one task. The count of buckets is the power of two that fits the table
    when it is first written, and doubles, with one full rewrite, once buckets hold twice as many. The driver knows one
    number per bucket and never a row. A deletion writes ``at_once`` buckets after the other, or two a core if that is
    more, so that its shuffles don't take the space of the whole table.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, per_bucket: int = 1_000_000, bucket_bytes: int = 128 << 20,
                 at_once: int = 32):
        self.spark, self.root, self.key, self.per_bucket, self.bucket_bytes = spark, root.rstrip("/"), key, per_bucket, bucket_bytes
        self.at_once = at_once

    def room(self, row_bytes: int) -> int:
        """How many rows of this size a bucket should hold."""
        return min(self.per_bucket, max(1, self.bucket_bytes // max(1, row_bytes)))

    def fitting(self, rows: int, row_bytes: int = 0) -> int:
        buckets = 1
        while buckets * self.room(row_bytes) < rows:
            buckets *= 2
        return buckets

    def pointer(self, below: int | None = None) -> Pointer | None:
        """The newest finished version, or the newest below a number."""
        found = read_if_there(self.spark, f"{self.root}/pointer", POINTER + ", v long")
        if found is not None and below is not None:
            found = found.filter(F.col("v") < below)
        newest = None if found is None else found.agg(F.max("v")).first()[0]
        if newest is None:
            return None
        rows = self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer/v={newest}").collect()
        held = [r for r in rows if r["version"] is not None]
        return Pointer(
            int(newest), rows[0]["buckets"], T._parse_datatype_json_string(rows[0]["columns"]),
            {r["bucket"]: r["version"] for r in held}, {r["bucket"]: r["rows"] for r in held}, rows[0]["row_bytes"] or 0,
        )

    def _open(self, pointer: Pointer, buckets: list[int] | None = None) -> DataFrame:
        folders = pointer.folders(self.root, buckets)
        if not folders:
            return self.spark.createDataFrame([], pointer.schema)
        return self.spark.read.schema(pointer.schema).parquet(*folders)

    def read(self, below: int | None = None) -> DataFrame | None:
        pointer = self.pointer(below)
        return None if pointer is None else self._open(pointer)

    def lookup(self, values: list) -> DataFrame:
        """The rows of single keys, from the folders of their buckets alone."""
        pointer = self.pointer()
        hashes = self.spark.createDataFrame([(v,) for v in values], T.StructType([pointer.schema[self.key]]))
        own = [r[0] for r in hashes.select(bucket_of(self.key, pointer.buckets)).distinct().collect()]
        return self._open(pointer, own).filter(F.col(self.key).isin(values))

    def _write(self, rows: DataFrame, version: int, buckets: int, kept: dict[int, tuple[int, int]], row_bytes: int, *more: DataFrame) -> Pointer:
        """Write rows of whole buckets as ``version``, each bucket by its own task, then the pointer; ``kept`` are the
        buckets that stay. ``more`` are the rows of further buckets, written one frame after the other."""
        path, mode = f"{self.root}/data/v={version}", "overwrite"
        for part in (rows, *more):
            dealt = part.withColumn("b", bucket_of(self.key, buckets)).repartitionById(buckets, F.col("b").cast("int")).sortWithinPartitions("b", self.key)
            with spent_shuffles_dropped(self.spark):
                dealt.write.mode(mode).partitionBy("b").parquet(path)
            mode = "append"
        counts = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("b", T.LongType())])).parquet(path).groupBy("b").count().collect()
        held = {**kept, **{r["b"]: (version, r["count"]) for r in counts}}
        columns = rows.schema.json()
        listed = [(b, *held.get(b, (None, None)), buckets, columns, row_bytes) for b in range(buckets)]
        self.spark.createDataFrame(listed, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pointer/v={version}")
        return Pointer(version, buckets, rows.schema, {b: v for b, (v, _) in held.items()}, {b: n for b, (_, n) in held.items()}, row_bytes)

    def replace(self, rows: DataFrame, version: int) -> Pointer:
        """The whole table anew. The rows are made once: they are put down to be counted and sized, then dealt to buckets;
        the copy is emptied when that is done."""
        if self._sealed(version):
            return self.pointer()
        folder = run_folder(self.spark, "buckets")
        with spent_shuffles_dropped(self.spark):
            rows.write.parquet(folder)
        made = self.spark.read.schema(rows.schema).parquet(folder)
        count, size = made.agg(F.count(F.lit(1)), F.sum(row_size(made))).first()
        row_bytes = -(-(size or 0) // max(1, count))
        pointer = self._write(made, version, self.fitting(count, row_bytes), {}, row_bytes)
        emptied(self.spark, folder, made.schema)
        return pointer

    def _sealed(self, version: int) -> bool:
        """Whether older rows that this version was made from are gone; then it was finished."""
        sealed = read_if_there(self.spark, f"{self.root}/sealed", "version long")
        return sealed is not None and sealed.filter(F.col("version") >= version).limit(1).count() > 0

    def change(self, version: int, keys: DataFrame, merged: Callable[[DataFrame | None], DataFrame], by_row: bool = False) -> Pointer:
        """Write new versions of the buckets that hold ``keys``.

        ``merged`` is given the rows of these buckets as of the newest version below (None for the first) and returns
        all their rows from now on; the other buckets are neither read nor written. ``by_row`` says that it decides on
        each row for itself and adds none: then it is given some of the buckets at a time.
        """
        if self._sealed(version):
            return self.pointer()
        pointer = self.pointer(below=version)
        if pointer is None:
            return self.replace(merged(None), version)
        if not pointer.rows or sum(pointer.rows.values()) > 2 * self.room(pointer.row_bytes) * pointer.buckets:
            return self.replace(merged(self._open(pointer)), version)
        touched = {r[0] for r in keys.select(bucket_of(self.key, pointer.buckets)).distinct().collect()}
        if not touched:
            return self._write(self.spark.createDataFrame([], pointer.schema), version, pointer.buckets, self._kept(pointer, set()), pointer.row_bytes)
        own = sorted(touched)
        step = max(self.at_once, 2 * self.spark.sparkContext.defaultParallelism) if by_row else len(own)
        parts = [merged(self._open(pointer, own[i : i + step])) for i in range(0, len(own), step)]
        return self._write(parts[0], version, pointer.buckets, self._kept(pointer, touched), pointer.row_bytes, *parts[1:])

    @staticmethod
    def _kept(pointer: Pointer, touched: set[int]) -> dict[int, tuple[int, int]]:
        return {b: (v, pointer.rows[b]) for b, v in pointer.holders.items() if b not in touched}

    def upsert(self, version: int, changed: DataFrame) -> Pointer:
        """Exchange the rows of the keys in ``changed``, one row per key, and add those that are new."""

        def exchanged(old: DataFrame | None) -> DataFrame:
            if old is None:
                return changed
            return old.join(changed.select(self.key), self.key, "left_anti").unionByName(changed.select(*old.columns))

        return self.change(version, changed.select(self.key), exchanged)

    def delete(self, version: int, keys: DataFrame) -> Pointer:
        """Drop the rows of these keys."""
        return self.change(version, keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"), by_row=True)

    def reclaim(self) -> list[int]:
        """Empty the versions that the newest pointer no longer names, for readers that have moved on. Returns them."""
        pointer, spark = self.pointer(), self.spark
        stored = read_if_there(spark, f"{self.root}/data")
        if pointer is None or stored is None or "v" not in stored.columns:
            return []
        # versions above the pointer are being written
        old = [r[0] for r in stored.select("v").distinct().collect() if r[0] not in pointer.holders.values() and r[0] <= pointer.version]
        for version in old:
            spark.createDataFrame([], pointer.schema).write.mode("overwrite").parquet(f"{self.root}/data/v={version}")
        return sorted(old)

    def scrub(self) -> list[int]:
        """Replace each bucket folder that the newest pointer no longer names by a row of nulls, so that no row that was
        exchanged or deleted stays on disk. ``reclaim`` frees whole versions; here a version that still holds other
        buckets loses the outdated ones. One write a version, whatever the number of buckets. Returns these versions.

        The newest version is sealed first: it can't be built again from what lay below it, and a batch up to it that
        is repeated changes nothing.
        """
        pointer, spark = self.pointer(), self.spark
        stored = read_if_there(spark, f"{self.root}/data")
        if pointer is None or stored is None or "v" not in stored.columns:
            return []
        found = stored.filter(F.col("v") <= pointer.version).groupBy("v", "b").agg(
            F.count("*").alias("rows"), F.count(self.key).alias("keyed")).filter("rows > 1 or keyed > 0").collect()
        spark.createDataFrame([(pointer.version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.root}/sealed")
        old: dict[int, list[int]] = {}
        for row in found:
            if pointer.holders.get(row["b"]) != row["v"]:
                old.setdefault(row["v"], []).append(row["b"])
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in pointer.schema.fields]
        for version, buckets in old.items():
            spark.createDataFrame([(b,) for b in buckets], "b long").select(*blank, "b").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("b").parquet(f"{self.root}/data/v={version}")
        return sorted(old)


class KeyedLog:
    """An append-only table that can be asked for the rows of a few keys.

    A batch owns its folder, in which rows lie by the hash bucket of their key; a repeated batch replaces its folder.
    How many buckets a batch has follows from its own rows, so small batches make few files. ``spread`` tasks share the
    rows of a bucket, so that a key with very many rows is written by several.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, per_bucket: int = 100_000, spread: int = 8):
        self.spark, self.root, self.key, self.per_bucket, self.spread = spark, root.rstrip("/"), key, per_bucket, spread

    def append(self, rows: DataFrame, batch: int) -> None:
        buckets, count = 1, rows.count()
        while buckets * self.per_bucket < count:
            buckets *= 2
        salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != self.key]), F.lit(self.spread))
        rows.withColumn("b", bucket_of(self.key, buckets)).repartition("b", salt).write.mode("overwrite").partitionBy("b") \
            .parquet(f"{self.root}/batch={batch}/of={buckets}")

    def read(self, below: int | None = None) -> DataFrame | None:
        rows = read_if_there(self.spark, self.root)
        if rows is not None and below is not None:
            rows = rows.filter(F.col("batch") < below)
        return rows

    def near(self, keys: DataFrame, below: int | None = None) -> DataFrame | None:
        """The rows of the folders that may hold one of the keys, as stored: their buckets are found first, for each
        count of buckets that batches have, and are constants of the scan."""
        rows = self.read(below)
        if rows is None:
            return None
        own = F.lit(False)
        for n in [r[0] for r in rows.select("of").distinct().collect()]:
            touched = [r[0] for r in keys.select(bucket_of(self.key, n)).distinct().collect()]
            if len(touched) == n:
                own = own | (F.col("of") == n)
            elif touched:
                own = own | ((F.col("of") == n) & F.col("b").isin(touched))
        return rows.filter(own)

    def of_keys(self, keys: DataFrame, below: int | None = None) -> DataFrame | None:
        """All rows of the given keys."""
        rows = self.near(keys, below)
        if rows is None:
            return None
        return rows.drop("batch", "of", "b").join(keys.select(self.key).distinct(), self.key, "left_semi")
