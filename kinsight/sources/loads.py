"""Landed tables: batches with a commit mark, and the figures of what was written.

    root/data/batch=<number>/...     the rows of a batch
    root/loads/batch=<number>/...    one row, written last: the figures of the load, and whether it was a full one

Rows count once their batch has its mark. A repeated batch replaces its own rows and mark; a full load makes all earlier
batches history. Reconciliation reads marks, not tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.schemas import AUDIT_COLUMNS
from kinsight.sources.buckets import read_if_there

FIGURES = "is_full boolean, rows long, null_hashes long, min_hash_length int, audit_nulls long, rejected long, first_id string, last_id string"


class LandedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, rows: DataFrame, batch: int, full: bool = False) -> dict:
        """Write one batch. Its figures come from what then lies there, from the few columns they need: observed metrics
        of a write are computed row by row outside generated code, which takes as long as the write itself. Columns that
        a table doesn't have give null figures."""
        none = F.lit(None)
        has = lambda *names: all(n in rows.columns for n in names)
        missing = F.greatest(*[F.col(c).isNull() for c in AUDIT_COLUMNS]) if has(*AUDIT_COLUMNS) else None
        path = f"{self.root}/data/batch={batch}"
        # row hashes are hexadecimal digits, which take half the room under zstd
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        seen = self.spark.read.schema(rows.schema).parquet(path).agg(
            F.count(F.lit(1)).alias("rows"),
            (F.count_if(F.col("_row_hash").isNull()) if has("_row_hash") else F.max(none.cast("long"))).alias("null_hashes"),
            (F.min(F.length("_row_hash")) if has("_row_hash") else F.max(none.cast("int"))).alias("min_hash_length"),
            (F.count_if(missing) if missing is not None else F.max(none.cast("long"))).alias("audit_nulls"),
            (F.count_if(F.col("_corrupt_record").isNotNull()) if has("_corrupt_record") else F.count_if(F.lit(False))).alias("rejected"),
            (F.min("_batch_id") if has("_batch_id") else F.max(none.cast("string"))).alias("first_id"),
            (F.max("_batch_id") if has("_batch_id") else F.max(none.cast("string"))).alias("last_id"),
        ).first().asDict()
        figures = {"is_full": full, **seen}
        names = [part.split()[0] for part in FIGURES.split(", ")]
        mark = self.spark.createDataFrame([tuple(figures[n] for n in names)], FIGURES)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/loads/batch={batch}")
        return figures

    def marks(self) -> DataFrame | None:
        """The marks of the live batches: the newest full load and what came after it."""
        found = read_if_there(self.spark, f"{self.root}/loads")
        if found is None:
            return None
        newest = found.agg(F.max(F.when(F.col("is_full"), F.col("batch")))).first()[0]
        return found if newest is None else found.filter(F.col("batch") >= newest)

    def read(self) -> DataFrame | None:
        """The rows of the live batches."""
        marks = self.marks()
        if marks is None:
            return None
        live = [r[0] for r in marks.select("batch").collect()]
        return self.spark.read.parquet(*[f"{self.root}/data/batch={n}" for n in sorted(live)])

    def figures(self, name: str) -> DataFrame:
        """One row for the table: what its live batches hold together."""
        return self.marks().agg(
            F.sum("rows").alias("rows"), F.sum("null_hashes").alias("null_hashes"), F.min("min_hash_length").alias("min_hash_length"),
            F.sum("audit_nulls").alias("audit_nulls"), F.sum("rejected").alias("rejected"), F.count("*").alias("loads"),
        ).select(F.lit(name).alias("table_name"), "*")


def check(figures: DataFrame, expected: DataFrame) -> DataFrame:
    """The post-load check from figures: table_name, rows_loaded, null_hashes, min_hash_length, status."""
    counts_match = F.coalesce(F.col("rows_loaded") == F.col("expected_rows"), F.lit(True))
    good = counts_match & (F.col("null_hashes") == 0) & (F.col("min_hash_length") == 64)
    rows = figures.select("table_name", F.col("rows").alias("rows_loaded"), "null_hashes", "min_hash_length")
    return rows.join(expected, "table_name", "left").withColumn("status", F.when(good, "PASS").otherwise("FAIL")).drop("expected_rows")
