"""Incremental maintenance: change stream in, affected customers recomputed, serving data refreshed.

All sinks work per micro-batch and are idempotent: a batch writes the version
that carries its own number, built on the newest version below it, so a batch
replayed after a failure replaces its own output and nothing else. Maintained
tables lie in hash buckets; a batch reads and writes the buckets of the customers
it touches (``kinsight.sources.buckets``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinsight.operators.aggregates import agg_customer_interaction, fold_interaction_delta
from kinsight.sources.buckets import Buckets, KeyedLog, read_if_there
from kinsight.sources.known import KnownKeys


def change_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Append-only stream of the rows arriving in a folder; the checkpoint is the consumer's offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that has arrived since the checkpoint, then stop."""
    query = (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def skip_existing(stream: DataFrame, checkpoint: str) -> None:
    """Move the consumer past the rows that are already there, so that only new rows follow."""
    run_available(stream, checkpoint, lambda batch, number: None)


def affected(history: DataFrame, changes: DataFrame, key: str = "customer_id") -> DataFrame:
    """The full history of the keys that changed."""
    return history.join(changes.select(key).distinct(), key, "left_semi")


def recompute_sink(
    spark: SparkSession, history: KeyedLog | Callable[[], DataFrame], table: str,
    aggregate: Callable[[DataFrame], DataFrame] = agg_customer_interaction,
    refresh: Callable[[DataFrame], None] | None = None, key: str = "customer_id", per_bucket: int = 1_000_000,
) -> Callable[[DataFrame, int], None]:
    """Re-aggregate the affected customers over their whole history and exchange their rows in ``table``.

    For aggregates that cannot be merged from partial results. A ``KeyedLog`` as history takes each batch in first and
    opens only the buckets of its customers; a function gives a table that is scanned. ``refresh`` is called with the
    re-aggregated rows of the batch, to bring a serving table up to date.
    """
    kept = Buckets(spark, table, key, per_bucket)

    def on_batch(batch: DataFrame, number: int) -> None:
        if isinstance(history, KeyedLog):
            history.append(batch, number)
            past = history.of_keys(batch.select(key), below=number + 1)
        else:
            past = affected(history(), batch, key)
        pointer = kept.upsert(number + 1, aggregate(past))
        if refresh:
            fresh = kept.read(below=pointer.version + 1)
            refresh(fresh.join(batch.select(key).distinct(), key, "left_semi"))

    return on_batch


def fold_sink(
    spark: SparkSession, table: str, aggregate: Callable[[DataFrame], DataFrame] = agg_customer_interaction,
    fold: Callable[[DataFrame, DataFrame], DataFrame] = fold_interaction_delta, key: str = "customer_id",
    per_bucket: int = 1_000_000,
) -> Callable[[DataFrame, int], None]:
    """Merge the batch's own aggregate into the buckets of its customers: neither the history nor another bucket is read.

    The cheap path for counts and maxima; the cost of a batch depends on the batch and the buckets it touches.
    """
    kept = Buckets(spark, table, key, per_bucket)

    def on_batch(batch: DataFrame, number: int) -> None:
        delta = aggregate(batch)
        kept.change(number + 1, batch.select(key), lambda old: delta if old is None else fold(old, delta))

    return on_batch


def serving_refresh(serving: Buckets) -> Callable[[DataFrame], None]:
    """For ``recompute_sink``: exchange the changed rows in a serving table, in the buckets that hold them."""

    def refresh(changed: DataFrame) -> None:
        pointer = serving.pointer()
        serving.upsert(1 if pointer is None else pointer.version + 1, changed)

    return refresh


def insert_only_sink(spark: SparkSession, table: str, key: str,
                     transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Add rows whose key is not stored yet, whatever the age of the earlier delivery.

    Each batch owns the folder of its number. Which keys are stored is told by their summaries; only key files that may
    hold a key of the batch are opened. A half-written replay of a batch is not part of what it is compared with.
    """
    known = KnownKeys(spark, f"{table.rstrip('/')}-known", key)

    def on_batch(batch: DataFrame, number: int) -> None:
        fresh, _ = known.unseen(batch, number)
        out = transform(fresh) if transform else fresh
        path = f"{table}/batch={number}"
        out.write.mode("overwrite").parquet(path)
        known.add(spark.read.schema(out.schema).parquet(path), number)

    return on_batch


def stored_batches(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """All rows written by ``insert_only_sink``, optionally only those of earlier batches."""
    rows = read_if_there(spark, table)
    if rows is None:
        return None
    return (rows if below is None else rows.filter(F.col("batch") < below)).drop("batch")


def before_after(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Baseline against refreshed value per key, and whether it grew."""
    old = before.select(key, F.col(column).alias("before"))
    new = after.select(key, F.col(column).alias("after"))
    return new.join(old, key, "full_outer").select(
        key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"),
    ).withColumn("delta", F.col("after") - F.col("before"))


def latency_record(query: StreamingQuery, first_seen: datetime) -> dict:
    """End-to-end latency of the last batch: from the moment the rows were written (a time without zone is UTC) to the
    end of the batch, as the stream's own progress has it."""
    progress = query.lastProgress
    finished = first_seen
    if progress:
        began = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00"))
        finished = began + timedelta(milliseconds=progress["durationMs"].get("triggerExecution", 0))
        finished = finished.astimezone(first_seen.tzinfo) if first_seen.tzinfo else finished.replace(tzinfo=None)
    return {
        "batch": progress["batchId"] if progress else None,
        "rows": progress["numInputRows"] if progress else 0,
        "trigger_ms": progress["durationMs"].get("triggerExecution") if progress else None,
        "end_to_end_seconds": (finished - first_seen).total_seconds(),
    }
