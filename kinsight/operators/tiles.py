"""Contact windows that move with the clock, from day tiles.

A tile sums up one customer's contacts of one day in measures that merge: counts, sums, least and greatest. A window
of whole days is the merge of their tiles; only the two days that the window's edges cut are read contact by contact.
So the windows of another day cost the tiles of that span and the contacts of two days, and new or late contacts add
tiles of their own to the days they belong to.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.config import Clock
from kinsight.operators.enrichment import SCORE
from kinsight.sources.buckets import read_if_there

_DONE = "enrichment_status = 'completed'"

#: Measure -> (how contacts make it, how tiles merge).
MEASURES = {
    "contacts": ("count(*)", "sum"),
    "transcripts": ("count(transcript_id)", "sum"),
    "completed": (f"count_if({_DONE})", "sum"),
    "failed": ("count_if(enrichment_status = 'failed')", "sum"),
    "negative": ("count_if(sentiment_label = 'negative')", "sum"),
    "positive": ("count_if(sentiment_label = 'positive')", "sum"),
    "worst": ("min(sentiment_score)", "min"),
    "scored": (f"count(CASE WHEN {_DONE} THEN sentiment_score END)", "sum"),
    "score_sum": (f"sum(CASE WHEN {_DONE} THEN sentiment_score END)", "sum"),
    "done_negative": (f"count_if({_DONE} AND sentiment_label = 'negative')", "sum"),
    "done_complaint": (f"count_if({_DONE} AND is_complaint)", "sum"),
    "done_escalation": (f"count_if({_DONE} AND is_escalation)", "sum"),
    "done_worst": (f"min(CASE WHEN {_DONE} THEN sentiment_score END)", "min"),
    "last_negative": (f"max(CASE WHEN {_DONE} AND sentiment_label = 'negative' THEN interaction_date END)", "max"),
}

#: What tiles and edges need of an enriched contact.
CONTACT = ("customer_id", "interaction_id", "interaction_date", "transcript_id", "enrichment_status", "sentiment_label",
           "sentiment_score", "is_complaint", "is_escalation")


def tiles(enriched: DataFrame, *by: str) -> DataFrame:
    """One row per customer and ``by``, with every measure. A contact without a time belongs to the day null."""
    return enriched.groupBy("customer_id", *by).agg(*[F.expr(f"{sql} AS {name}") for name, (sql, _) in MEASURES.items()])


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Tiles of the same customer and ``by`` as one."""
    return parts.groupBy("customer_id", *by).agg(*[F.expr(f"{how}({name}) AS {name}") for name, (_, how) in MEASURES.items()])


def _average(total: str, count: str) -> str:
    """The average as ``avg`` of the scores has it: four digits more than a score."""
    precision, scale = (int(x) for x in SCORE[8:-1].split(","))
    return f"CAST(try_divide(sum({total}), sum({count})) AS DECIMAL({precision + 4},{scale + 4}))"


class DayTiles:
    """Stored contacts and tiles, both by day and batch; a repeated batch replaces its own folders.

    ``spread`` tasks share the contacts of a day when it is written. Tiles of one day from several batches are merged
    when they are read, so a late contact needs no rewrite.
    """

    def __init__(self, spark: SparkSession, root: str, spread: int = 8):
        self.spark, self.root, self.spread = spark, root.rstrip("/"), spread

    def add(self, enriched: DataFrame, batch: int) -> None:
        path = f"{self.root}/contacts/batch={batch}"
        day = F.to_date("interaction_date").alias("day")
        salt = F.pmod(F.xxhash64("interaction_id"), F.lit(self.spread))
        enriched.select(*CONTACT, day).repartition("day", salt).write.mode("overwrite").partitionBy("day").parquet(path)
        stored = read_if_there(self.spark, path)
        if stored is not None:
            tiles(stored.withColumn("day", F.to_date("day")), "day").write.mode("overwrite").parquet(f"{self.root}/tiles/batch={batch}")

    def tiles(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tiles").drop("batch")

    def contacts_of(self, *moments: datetime) -> DataFrame:
        """The contacts of the days of these moments."""
        rows = self.spark.read.parquet(f"{self.root}/contacts")
        return rows.filter(F.col("day").isin([m.date() for m in moments])).drop("batch")

    def parts(self, moments: dict[str, datetime]) -> DataFrame:
        """Tiles by period: the name of the latest of ``moments`` that a contact isn't before, else ``older``."""
        ordered = sorted(moments.items(), key=lambda m: m[1], reverse=True)
        cut_days = [m.date() for m in moments.values()]

        def period(column: str, test) -> F.Column:
            out = F.lit("older")
            for name, moment in reversed(ordered):
                out = F.when(test(F.col(column), moment), name).otherwise(out)
            return out.alias("period")

        whole = self.tiles().filter(F.col("day").isNull() | ~F.col("day").isin(cut_days))
        whole = whole.withColumn("period", period("day", lambda c, m: c > F.lit(m.date())))
        exact = period("interaction_date", lambda c, m: c >= F.expr(f"TIMESTAMP_NTZ '{m:%Y-%m-%d %H:%M:%S.%f}'"))
        edges = tiles(self.contacts_of(*moments.values()).withColumn("period", exact), "period")
        return whole.select("customer_id", "period", *MEASURES).unionByName(edges.select("customer_id", "period", *MEASURES))

    def _periods(self, clock: Clock) -> DataFrame:
        days = timedelta(days=clock.window_days)
        return self.parts({"current": clock.now - days, "prior": clock.now - 2 * days})

    def engagement_windows(self, clock: Clock) -> DataFrame:
        """What ``profile.engagement_windows`` gives over all contacts, at any clock."""
        now, before = "period = 'current'", "period = 'prior'"

        def total(measure: str, when: str, how: str = "sum") -> str:
            value = f"{how}(CASE WHEN {when} THEN {measure} END)"
            return f"coalesce({value}, 0L)" if how == "sum" else value

        def average(when: str) -> str:
            return _average(f"CASE WHEN {when} THEN score_sum END", f"CASE WHEN {when} THEN scored END")

        wanted = {
            "enriched_interactions_90d": total("completed", now), "negative_count_90d": total("negative", now),
            "positive_count_90d": total("positive", now), "avg_current": average(now), "avg_prior": average(before),
            "worst_sentiment_90d": total("worst", now, "min"), "interaction_rows": "sum(contacts)",
            "transcripts_total": "sum(transcripts)", "transcripts_enriched": "sum(completed)",
            "transcripts_failed": "sum(failed)", "risk_negative_90d": total("done_negative", now),
            "risk_complaint_90d": total("done_complaint", now), "risk_escalation_90d": total("done_escalation", now),
            "risk_worst_90d": total("done_worst", now, "min"), "risk_last_negative": total("last_negative", now, "max"),
            "interactions_current_90d": total("contacts", now), "interactions_prior_90d": total("contacts", before),
        }
        return self._periods(clock).groupBy("customer_id").agg(*[F.expr(f"{sql} AS {name}") for name, sql in wanted.items()])

    def sentiment_windows(self, clock: Clock) -> DataFrame:
        """What ``risk.sentiment_windows`` gives: customers with a completed enrichment in either window."""
        recent = self.engagement_windows(clock)
        seen = self._periods(clock).filter("period <> 'older'").groupBy("customer_id").agg(F.sum("completed").alias("_seen"))
        return recent.join(seen.filter("_seen > 0"), "customer_id", "left_semi").selectExpr(
            "customer_id", "enriched_interactions_90d AS total_enriched_90d", "risk_negative_90d AS negative_count_90d",
            "risk_complaint_90d AS complaint_count_90d", "risk_escalation_90d AS escalation_count_90d",
            "avg_current AS avg_sentiment_90d", "risk_worst_90d AS worst_sentiment_90d",
            "risk_last_negative AS last_negative_date", "avg_prior AS avg_sentiment_prior_90d",
        )

    def interaction_frequency(self, clock: Clock) -> DataFrame:
        return self.engagement_windows(clock).select("customer_id", "interactions_current_90d", "interactions_prior_90d")

    def contacts_since(self, moment: datetime, name: str) -> DataFrame:
        """Contacts per customer from a moment on, for summaries of any span."""
        return self.parts({"since": moment}).filter("period = 'since'").groupBy("customer_id").agg(F.sum("contacts").alias(name))
