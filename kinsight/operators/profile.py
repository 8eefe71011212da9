"""The one-row-per-customer profile: structured base, sentiment summary, timeline, enriched view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.config import Clock
from kinsight.functions.gather import gather
from kinsight.functions.numeric import count_if, count_where


def customer_360_base(
    customers: DataFrame, households: DataFrame, policy: DataFrame, claim: DataFrame, payment: DataFrame,
    interaction: DataFrame, clock: Clock,
) -> DataFrame:
    """customer ⟕ household ⟕ four per-customer aggregates; exactly one row per customer.

    Every right side is unique on its key. The joins carry no hints: the planner
    broadcasts a side only below its size threshold and otherwise sort-merges on
    the customer_id partitioning the aggregates already have.
    """
    joined = (
        customers.join(households.drop("_source_hash", "_batch_id"), "household_id", "left")
        .join(policy.withColumn("_ap", F.lit(True)), "customer_id", "left")
        .join(claim.withColumn("_ac", F.lit(True)), "customer_id", "left")
        .join(payment.withColumnsRenamed({"total_amount_paid": "payments_total_paid"})
              .withColumn("_py", F.lit(True)), "customer_id", "left")
        .join(interaction.withColumn("_ai", F.lit(True)), "customer_id", "left")
    )
    lineage = [c for c in ("_source_table", "_source_hash", "_batch_id") if c in customers.columns]
    return joined.selectExpr(
        "customer_id", "first_name", "last_name", "date_of_birth", "email", "phone", "address_line_1", "city",
        "state", "postal_code", "customer_since", "status AS customer_status",
        "household_id", "member_count AS household_member_count", "primary_state AS household_primary_state",
        "household_status", "earliest_since AS household_earliest_since",
        *_zero_filled("total_policies", "active_policies", "distinct_product_count"),
        "product_holdings", "nearest_renewal_date",
        f"datediff(nearest_renewal_date, DATE '{clock.today}') AS days_to_renewal",
        *_zero_filled("total_annual_premium", "active_annual_premium"),
        "total_coverage_limit", "total_deductible",
        *_zero_filled("total_claims", "open_claims", "settled_claims", "denied_claims"),
        "total_reserve_amount", "total_paid_amount AS claims_total_paid", "earliest_filed_date", "latest_filed_date",
        *_zero_filled("total_payments"),
        *[f"coalesce({name}_count, 0L) AS payments_{name}"
          for name in ("on_time", "late", "missed", "grace_period", "pending")],
        "latest_paid_date", *_zero_filled("total_amount_due"), "payments_total_paid",
        *_zero_filled("total_interactions"),
        "coalesce(inbound_count, 0L) AS interactions_inbound",
        "coalesce(outbound_count, 0L) AS interactions_outbound",
        "latest_interaction_date", "latest_channel",
        "coalesce(complaint_count, 0L) AS interactions_complaints",
        "coalesce(inquiry_count, 0L) AS interactions_inquiries",
        "coalesce(request_count, 0L) AS interactions_requests",
        "email IS NOT NULL AS has_email", "phone IS NOT NULL AS has_phone", "date_of_birth IS NOT NULL AS has_dob",
        "_ap IS NOT NULL AS has_policies", "_ac IS NOT NULL AS has_claims", "_py IS NOT NULL AS has_payments",
        "_ai IS NOT NULL AS has_interactions",
        *[f"{c} AS customer{c}" for c in lineage],
    )


def _zero_filled(*names: str) -> list[str]:
    return [f"coalesce({n}, 0) AS {n}" for n in names]


def direction(current: str, prior: str, missing: str) -> str:
    """SQL text: how an average moved against the prior window; a step of more than 0.1 counts."""
    return (
        f"CASE WHEN {current} IS NULL OR {prior} IS NULL THEN '{missing}' WHEN {current} < {prior} - 0.1 THEN 'worsening' "
        f"WHEN {current} > {prior} + 0.1 THEN 'improving' ELSE 'stable' END"
    )


def engagement_windows(enriched: DataFrame, clock: Clock) -> DataFrame:
    """Everything the profile, the signals and the recommendations need to know about contacts.

    One pass, one shuffle: the sentiment summary, both risk windows, the contact
    frequency and the enrichment coverage are conditional aggregates over the same
    grouping. Two definitions of "negative" are kept apart on purpose: the summary
    counts any labelled contact, the risk signal only completed enrichments.
    """
    done, current, prior = "enrichment_status = 'completed'", clock.current_sql(), clock.prior_sql()
    recent = f"{done} AND {current}"
    return enriched.groupBy("customer_id").agg(
        # summary
        count_where("enriched_interactions_90d", recent),
        count_where("negative_count_90d", f"sentiment_label = 'negative' AND {current}"),
        count_where("positive_count_90d", f"sentiment_label = 'positive' AND {current}"),
        F.expr(f"avg(CASE WHEN {recent} THEN sentiment_score END) AS avg_current"),
        F.expr(f"avg(CASE WHEN {done} AND {prior} THEN sentiment_score END) AS avg_prior"),
        F.expr(f"min(CASE WHEN {current} THEN sentiment_score END) AS worst_sentiment_90d"),
        # coverage
        F.expr("count(*) AS interaction_rows"),
        F.expr("count(transcript_id) AS transcripts_total"),
        count_where("transcripts_enriched", done),
        count_where("transcripts_failed", "enrichment_status = 'failed'"),
        # risk windows
        count_where("risk_negative_90d", f"{recent} AND sentiment_label = 'negative'"),
        count_where("risk_complaint_90d", f"{recent} AND is_complaint"),
        count_where("risk_escalation_90d", f"{recent} AND is_escalation"),
        F.expr(f"min(CASE WHEN {recent} THEN sentiment_score END) AS risk_worst_90d"),
        F.expr(f"max(CASE WHEN {recent} AND sentiment_label = 'negative' THEN interaction_date END) AS risk_last_negative"),
        # frequency
        count_where("interactions_current_90d", current),
        count_where("interactions_prior_90d", prior),
    )


SUMMARY = (
    "enriched_interactions_90d", "negative_count_90d", "positive_count_90d",
    "round(avg_current, 3) AS avg_sentiment_90d", "worst_sentiment_90d", "round(avg_prior, 3) AS avg_sentiment_prior_90d",
    direction("avg_current", "avg_prior", "insufficient_data") + " AS sentiment_direction",
    "round(try_divide(CAST(transcripts_enriched AS DECIMAL(18,0)), CAST(transcripts_total AS DECIMAL(18,0))), 2) "
    "AS enrichment_coverage_pct",
)


def sentiment_summary(windows: DataFrame) -> DataFrame:
    """Customer sentiment summary, from ``engagement_windows``."""
    return windows.selectExpr("customer_id", *SUMMARY, "transcripts_total", "transcripts_enriched")


def timeline_entries(enriched: DataFrame, clock: Clock) -> DataFrame:
    """Completed contacts of both windows, one row each, with the display object."""
    return enriched.filter(
        (F.col("enrichment_status") == "completed") & clock.in_recent(F.col("interaction_date"))
    ).select(
        "customer_id", "interaction_date", "interaction_id",
        F.struct(
            "interaction_id",
            F.date_format("interaction_date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"),
            "channel", "disposition",
            F.round("sentiment_score", 3).cast("double").alias("sentiment_score"),
            "sentiment_label", "summary",
            F.col("primary_topic").alias("topic"), F.col("primary_intent").alias("intent"),
            F.col("urgency_level").alias("urgency"), "is_complaint",
        ).alias("detail"),
    )


def timeline(entries: DataFrame) -> DataFrame:
    """Per customer the ordered array of all contact details, newest first.

    The day is the bucket: a customer with a third of all contacts still
    spreads over as many buckets as the two windows have days.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', interaction_date)")
    return gather(
        entries, "customer_id", bucket=-F.floor(micros / 86_400_000_000), order=[-micros, F.col("interaction_id")],
        item=F.col("detail"),
    ).withColumnRenamed("items", "details")


NBA_COLUMNS = (
    "action_id", "action_type", "action_name", "action_description", "action_category", "final_score",
    "confidence_level", "confidence_score", "evidence_signals", "data_completeness", "eligibility_check",
)


def serve(joined: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """The serving columns with their defaults and the system-status ladder; with ``details`` (from ``timeline``) also
    every contact of both windows."""
    extra = []
    if details is not None:
        joined = joined.join(details.withColumnRenamed("details", "recent_interaction_details"), "customer_id", "left")
        extra = ["recent_interaction_details"]

    degraded = "coalesce(enriched_interactions_90d, 0) = 0 AND has_interactions"
    return joined.selectExpr(
        "customer_id", "first_name", "last_name", "date_of_birth", "email", "phone", "address_line_1", "city",
        "state", "postal_code", "customer_since", "customer_status", "household_id", "household_member_count",
        "total_policies", "active_policies", "distinct_product_count", "product_holdings", "nearest_renewal_date",
        "days_to_renewal", "total_annual_premium", "active_annual_premium",
        "total_claims", "open_claims", "settled_claims", "denied_claims", "total_reserve_amount",
        "claims_total_paid",
        "total_payments", "payments_on_time", "payments_late", "payments_missed", "payments_grace_period",
        "payments_pending", "latest_paid_date",
        "total_interactions", "interactions_inbound", "interactions_outbound", "latest_interaction_date",
        "latest_channel", "interactions_complaints",
        *_zero_filled("enriched_interactions_90d", "negative_count_90d", "positive_count_90d"),
        "avg_sentiment_90d", "worst_sentiment_90d", "avg_sentiment_prior_90d",
        "coalesce(sentiment_direction, 'insufficient_data') AS sentiment_direction",
        *_zero_filled("enrichment_coverage_pct"),
        *extra,
        *_zero_filled("composite_risk_score"),
        "coalesce(risk_tier, 'low') AS risk_tier",
        "worsening_signals", "improving_signals",
        "coalesce(overall_direction, 'stable') AS risk_direction",
        "nba_action_id", "nba_action_type", "nba_action_name", "nba_action_description", "nba_action_category",
        *_zero_filled("nba_final_score"),
        "coalesce(nba_confidence_level, 'low') AS nba_confidence_level",
        *_zero_filled("nba_confidence_score"),
        "nba_evidence_signals", "nba_data_completeness", "nba_eligibility_check",
        "has_email", "has_phone", "has_dob", "has_policies", "has_claims", "has_payments", "has_interactions",
        "coalesce(enriched_interactions_90d, 0) > 0 AS has_enrichment",
        "composite_risk_score IS NOT NULL AS has_risk_signals",
        "nba_action_id IS NOT NULL AS has_recommendation",
        f"CASE WHEN {degraded} THEN 'degraded_no_enrichment' WHEN nba_action_id IS NULL THEN 'degraded_no_recommendation' "
        "WHEN nba_confidence_level = 'low' THEN 'low_confidence' ELSE 'full' END AS system_status",
        f"CASE WHEN {degraded} THEN "
        "'AI enrichment unavailable — showing structured data only. Recommendation withheld.' "
        "WHEN nba_action_id IS NULL THEN "
        "'Insufficient signals for a recommendation. Please review available context.' "
        "WHEN nba_confidence_level = 'low' THEN "
        "'Low confidence — limited enrichment data. Review evidence carefully.' END AS system_message",
    )


# --- reports over the enriched profile -------------------------------------------------------------------------


def status_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy("system_status").agg(F.count("*").alias("customer_count")).orderBy(
        F.desc("customer_count"), "system_status"
    )


def risk_action_matrix(profile: DataFrame) -> DataFrame:
    return profile.groupBy("risk_tier", "nba_action_type").agg(F.count("*").alias("cnt")).orderBy(
        "risk_tier", F.desc("cnt"), "nba_action_type"
    )


def coverage_kpis(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count("*").alias("total_customers"),
        count_if(F.col("has_enrichment")).alias("with_enrichment"),
        count_if(F.col("has_recommendation")).alias("with_recommendation"),
        count_if(F.col("system_status") == "full").alias("fully_operational"),
    )
