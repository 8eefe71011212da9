"""Decision history: recommendation log, audit events, follow-ups, snapshots, outcomes and their analysis.

Logs are append-only. Ids are derived from (customer, moment) once and reused,
so replaying the same decisions yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.functions.numeric import count_if, ratio

COMMITTED = ("approved", "modified")


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def moment_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that is never a broadcast. The planner sizes a side by its compressed files; decisions and payloads take a
    few bytes of a file and some hundreds in memory, so that below its threshold all of them would go to the driver."""
    return left.join(right.hint("merge"), on, how)


def recommendation_log(decisions: DataFrame, primary: DataFrame) -> DataFrame:
    """What was shown: one row per presented recommendation.

    ``decisions`` holds (customer_id, presented_at, decision, action_text, notes,
    representative_id, session_id); customers without a recommendation log nothing.
    """
    shown = primary.select(
        "customer_id", "action_type", "action_name", "action_description", "confidence_level", "confidence_score",
        "composite_risk_score", "risk_tier", "final_score",
        F.to_json(F.struct("evidence_signals", "data_completeness", "eligibility_check"))
        .alias("recommendation_payload"),
    )
    moment = F.col("presented_at")
    return merged(decisions, shown, "customer_id").select(
        stable_id(F.col("customer_id"), moment_text(moment)).alias("recommendation_log_id"),
        "customer_id", moment.alias("recommendation_timestamp"), "action_type", "action_name", "action_description",
        "confidence_level", "confidence_score", "composite_risk_score", "risk_tier", "final_score",
        "recommendation_payload", "session_id", "representative_id", moment.alias("created_at"),
        F.lit(True).alias("_immutable"),
    )


def _logged(decisions: DataFrame, log: DataFrame) -> DataFrame:
    keyed = decisions.withColumn(
        "recommendation_log_id", stable_id(F.col("customer_id"), moment_text(F.col("presented_at"))))
    shown = log.select("recommendation_log_id", "action_name", "action_description", "risk_tier", "confidence_level")
    return merged(keyed, shown, "recommendation_log_id")


def decision_events(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Audit trail: a 'presented' event for every recommendation and one for what became of it."""
    both = _logged(decisions, log).withColumn("event_type", F.explode(F.array(F.lit("presented"), F.col("decision"))))
    decided = F.col("event_type") != "presented"
    return both.select(
        stable_id(F.col("recommendation_log_id"), F.col("event_type")).alias("event_id"),
        "recommendation_log_id", "customer_id", "event_type",
        F.when(decided, F.col("decided_at")).otherwise(F.col("presented_at")).alias("event_timestamp"),
        F.when(decided, F.col("notes")).alias("event_notes"),
        F.col("representative_id").alias("actor"),
        F.to_json(F.struct("action_name", "confidence_level", "risk_tier")).alias("metadata"),
        F.lit(True).alias("_immutable"),
    )


def follow_ups(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Committed actions only: approved as shown, or modified to the representative's text."""
    committed = decisions.filter(F.col("decision").isin(*COMMITTED))
    modified = F.col("decision") == "modified"
    return _logged(committed, log).select(
        stable_id(F.col("recommendation_log_id"), F.lit("follow-up")).alias("follow_up_id"),
        "recommendation_log_id", "customer_id", F.col("decision").alias("follow_up_status"),
        F.when(modified, F.col("action_text")).otherwise(F.col("action_description")).alias("action_taken"),
        F.nullif("notes", F.lit("")).alias("notes"),
        F.col("representative_id").alias("assigned_to"), F.col("decided_at").alias("created_at"),
        F.lit(True).alias("_immutable"),
    )


def latest_recommendation(log: DataFrame) -> DataFrame:
    """Newest log entry per customer, as an aggregate with map-side combine rather than a window."""
    newest = F.max(F.struct("created_at", "recommendation_log_id", "action_type", "risk_tier")).alias("m")
    return log.groupBy("customer_id").agg(newest).select("customer_id", "m.*")


def context_snapshot(log: DataFrame, profile: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile as JSON, frozen per recommendation for audit replay."""
    kept = columns or profile.columns
    frozen = profile.select(
        "customer_id", F.to_json(F.struct(*kept)).alias("snapshot_data"),
        F.to_json(F.struct(*[c for c in profile.columns if c.startswith("has_")])).alias("data_completeness"),
    )
    shown = log.select("recommendation_log_id", "customer_id", F.col("created_at").alias("captured_at"))
    return merged(shown, frozen, "customer_id").select(
        stable_id(F.col("recommendation_log_id"), F.lit("snapshot")).alias("context_snapshot_id"),
        "recommendation_log_id", "customer_id", "captured_at", "snapshot_data", "data_completeness",
    )


def action_outcomes(
    follow_up: DataFrame, policies: DataFrame, today: Column, horizon_days: int = 365,
    escalations: DataFrame | None = None,
) -> DataFrame:
    """What happened after a committed action: the customer's next policy term within the horizon decides.

    Follow-ups, terms and escalations of a customer are laid on one line of dates and read backwards once, carrying
    the nearest later term and escalation along; no follow-up ever meets a term it doesn't need. Policies shrink to
    one row per (customer, start date) first. ``escalations`` (customer_id, escalated_on) marks escalated follow-ups.
    """
    status = F.col("status")
    kind = (
        F.when(status.isin("active", "renewed", "bound"), "renewed").when(status.isin("lapsed", "cancelled"), "lapsed")
        .otherwise("no_change")
    )
    terms = policies.select("customer_id", F.col("effective_date").alias("on"), kind.alias("kind")).groupBy(
        "customer_id", "on"
    ).agg(F.max("kind").alias("kind"))
    acted = follow_up.select("customer_id", F.to_date("created_at").alias("on"), "follow_up_id")
    line = acted.unionByName(terms, allowMissingColumns=True)
    if escalations is not None:
        marks = escalations.select("customer_id", F.col("escalated_on").alias("on")).distinct()
        line = line.unionByName(marks.withColumn("raised", F.lit(True)), allowMissingColumns=True)
    else:
        line = line.withColumn("raised", F.lit(None).cast("boolean"))
    # on one date the follow-ups come first, so that only later dates count
    back = Window.partitionBy("customer_id").orderBy(F.desc("on"), F.col("follow_up_id").isNull())
    sofar = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.date_add("decided_on", horizon_days)
    found = line.select(
        "customer_id", "follow_up_id", F.col("on").alias("decided_on"),
        F.last(F.when(F.col("kind").isNotNull(), F.struct(F.col("on").alias("started"), "kind")), ignorenulls=True)
        .over(sofar).alias("later"),
        F.last(F.when(F.col("raised"), F.col("on")), ignorenulls=True).over(sofar).alias("raised_on"),
    ).filter(F.col("follow_up_id").isNotNull())
    out = found.withColumn("next", F.when(F.col("later.started") <= end, F.col("later")))
    escalated = F.coalesce(F.col("raised_on") <= end, F.lit(False))
    known = F.col("next").isNotNull()
    outcome = (
        F.when(known, F.col("next.kind")).when(escalated, "escalated").when(end > today, "unknown")
        .otherwise("no_change")
    )
    return out.select(
        stable_id(F.col("follow_up_id"), F.lit("outcome")).alias("outcome_id"), "follow_up_id", "customer_id",
        outcome.alias("outcome_type"),
        F.when(known, F.col("next.started")).otherwise(F.least(end, today)).alias("observed_date"),
        F.when(known, "correlated").otherwise("unknown").alias("attribution_method"),
        F.when(known & (F.datediff("next.started", "decided_on") <= 90), "high").when(known, "medium")
        .otherwise("low").alias("attribution_confidence"),
    )


def decision_history(log, snapshots, follow_up, outcomes, events) -> DataFrame:
    """The whole life of each recommendation, one row per audit event."""
    life = log.select("recommendation_log_id", "customer_id", "action_type", "risk_tier", "created_at")
    life = merged(life, snapshots.select("recommendation_log_id", "context_snapshot_id"), "recommendation_log_id")
    life = merged(life, follow_up.select("recommendation_log_id", "follow_up_id", "follow_up_status"),
                  "recommendation_log_id", "left")
    life = merged(life, outcomes.select("follow_up_id", "outcome_type", "observed_date"), "follow_up_id", "left")
    life = merged(life, events.select("recommendation_log_id", "event_type", "event_timestamp"), "recommendation_log_id")
    return life.select(
        "recommendation_log_id", "customer_id", "action_type", "risk_tier", "created_at", "context_snapshot_id",
        "follow_up_id", "follow_up_status", "outcome_type", "observed_date", "event_type", "event_timestamp")


def outcome_rates(outcomes: DataFrame, follow_up: DataFrame, log: DataFrame, signals: DataFrame) -> DataFrame:
    """Renewal rate by combination of active signals and action. A customer has at most one row per signal, so a
    combination is a short list; ``none`` stands for no active signal."""
    active = signals.filter(F.col("weighted_score") > 0).groupBy("customer_id").agg(
        F.array_join(F.sort_array(F.collect_list("signal_type")), " + ").alias("signal_combination"))
    linked = merged(outcomes.select("follow_up_id", "customer_id", "outcome_type"),
                    follow_up.select("follow_up_id", "recommendation_log_id"), "follow_up_id")
    linked = merged(linked, log.select("recommendation_log_id", "action_type"), "recommendation_log_id")
    linked = merged(linked, active, "customer_id", "left").withColumn(
        "signal_combination", F.coalesce("signal_combination", F.lit("none")))
    renewed = count_if(F.col("outcome_type") == "renewed")
    return linked.groupBy("signal_combination", "action_type").agg(
        F.count("*").alias("follow_ups"), renewed.alias("renewed"), ratio(renewed, F.count("*"), 4).alias("renewal_rate")
    )


def decision_integrity(log, events, follow_up, outcomes) -> DataFrame:
    """Lifecycle rules as PASS/FAIL rows: nothing without its parent, nothing for a rejection, unique ids, immutable."""
    def duplicates(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")

    rejected = events.filter(F.col("event_type").isin("rejected", "timeout")).select("recommendation_log_id")
    violations = {
        "follow_up_without_recommendation": merged(follow_up, log, "recommendation_log_id", "left_anti"),
        "event_without_recommendation": merged(events, log, "recommendation_log_id", "left_anti"),
        "follow_up_for_rejected": merged(follow_up, rejected, "recommendation_log_id", "left_semi"),
        "outcome_without_follow_up": merged(outcomes, follow_up, "follow_up_id", "left_anti"),
        "duplicate_recommendation_id": duplicates(log, "recommendation_log_id"),
        "duplicate_event_id": duplicates(events, "event_id"),
        "duplicate_follow_up_id": duplicates(follow_up, "follow_up_id"),
        "mutable_rows": log.select("_immutable").unionByName(events.select("_immutable"))
        .unionByName(follow_up.select("_immutable")).filter(~F.coalesce("_immutable", F.lit(False))),
    }
    rows = None
    for name, bad in violations.items():
        row = bad.agg(F.count("*").alias("violations")).select(
            F.lit(name).alias("check_name"), "violations",
            F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def programme_metrics(log: DataFrame, events: DataFrame, follow_up, outcomes, interactions, policies) -> DataFrame:
    """Adoption, handle time and retention of guided customers against the rest, and action-outcome correlation."""
    decided = events.filter(F.col("event_type") != "presented").agg(
        F.count("*").alias("decided"), count_if(F.col("event_type") == "approved").alias("approved"),
        count_if(F.col("event_type").isin(*COMMITTED)).alias("committed"),
    )
    guided = follow_up.select("customer_id").distinct().withColumn("guided", F.lit(True))
    per_customer_time = interactions.filter(F.col("duration_seconds").isNotNull()).groupBy("customer_id").agg(
        F.sum("duration_seconds").alias("s"), F.count("*").alias("n")
    )
    in_force = policies.groupBy("customer_id").agg(
        F.max(F.col("status").isin("active", "renewed").cast("int")).alias("kept")
    )
    is_guided = F.coalesce("guided", F.lit(False))
    customers = merged(merged(in_force, per_customer_time, "customer_id", "full_outer"), guided, "customer_id", "left").agg(
        ratio(F.sum(F.when(is_guided, F.col("s"))), F.sum(F.when(is_guided, F.col("n"))), 4).alias("handle_guided"),
        ratio(F.sum(F.when(~is_guided, F.col("s"))), F.sum(F.when(~is_guided, F.col("n"))), 4).alias("handle_control"),
        ratio(F.sum(F.when(is_guided, F.col("kept"))), F.count(F.when(is_guided, F.col("kept"))), 4).alias("kept_guided"),
        ratio(F.sum(F.when(~is_guided, F.col("kept"))), F.count(F.when(~is_guided, F.col("kept"))), 4)
        .alias("kept_control"),
    )
    linked = merged(
        follow_up.select("follow_up_id", (F.col("follow_up_status") == "approved").cast("double").alias("x")),
        outcomes.select("follow_up_id", (F.col("outcome_type") == "renewed").cast("double").alias("y")), "follow_up_id"
    ).agg(F.round(F.corr("x", "y"), 6).alias("corr"))

    def rows(df: DataFrame, **metrics: Column) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
        return df.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")

    return (
        rows(decided, acceptance_rate=ratio(F.col("approved"), F.col("decided"), 4),
             adoption_rate=ratio(F.col("committed"), F.col("decided"), 4))
        .unionByName(rows(customers, handle_time_change=F.col("handle_guided") - F.col("handle_control"),
                          retention_delta=F.col("kept_guided") - F.col("kept_control")))
        .unionByName(rows(linked, approval_renewal_correlation=F.col("corr")))
    )


def evidence_rate(recommendations: DataFrame) -> DataFrame:
    """Share of recommendations with at least one contributing signal."""
    backed = F.exists("evidence_signals", lambda e: e["weighted_score"] > 0)
    return recommendations.agg(
        F.count("*").alias("recommendations"), count_if(backed).alias("with_evidence")
    ).withColumn("evidence_rate", ratio(F.col("with_evidence"), F.col("recommendations"), 4))
