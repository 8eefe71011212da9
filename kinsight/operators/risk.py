"""Eight named, weighted, explainable signals per customer and the composite score.

Signals are built as an array of eight structs on the customer's own row, so
turning wide into long, ranking evidence and summing the composite never
shuffle again after the per-customer joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.config import RISK_TIERS, SIGNAL_WEIGHTS, TIER_ORDER, Clock
from kinsight.functions.numeric import count_if, count_where, ordinal
from kinsight.operators.profile import direction

# --- inputs ----------------------------------------------------------------------------------------------------


def sentiment_windows(enriched: DataFrame, clock: Clock) -> DataFrame:
    """Completed enrichments of the current window, and the average of the prior one."""
    current = clock.current_sql()
    return enriched.filter(f"enrichment_status = 'completed' AND {clock.recent_sql()}").groupBy("customer_id").agg(
        count_where("total_enriched_90d", current),
        count_where("negative_count_90d", f"{current} AND sentiment_label = 'negative'"),
        count_where("complaint_count_90d", f"{current} AND is_complaint"),
        count_where("escalation_count_90d", f"{current} AND is_escalation"),
        F.expr(f"avg(CASE WHEN {current} THEN sentiment_score END) AS avg_sentiment_90d"),
        F.expr(f"min(CASE WHEN {current} THEN sentiment_score END) AS worst_sentiment_90d"),
        F.expr(f"max(CASE WHEN {current} AND sentiment_label = 'negative' THEN interaction_date END) "
               "AS last_negative_date"),
        F.expr(f"avg(CASE WHEN NOT {current} THEN sentiment_score END) AS avg_sentiment_prior_90d"),
    )


def interaction_frequency(interactions: DataFrame, clock: Clock) -> DataFrame:
    return interactions.groupBy("customer_id").agg(
        count_where("interactions_current_90d", clock.current_sql()),
        count_where("interactions_prior_90d", clock.prior_sql()),
    )


def product_gaps(policy_aggregate: DataFrame) -> DataFrame:
    """NULL holdings read as no gap here; a customer without any policy row has every gap (see ``risk_wide``)."""
    return policy_aggregate.selectExpr(
        "customer_id", "active_policies",
        *[f"coalesce(product_holdings NOT LIKE '%{p}%', false) AS missing_{p}"
          for p in ("home", "umbrella", "auto", "renters")],
    )


def risk_wide(base: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per customer with every signal input: base ⟕ the one-pass contact windows."""
    return signal_inputs(base.join(windows, "customer_id", "left"))


def signal_inputs(joined: DataFrame, carry: str | None = None) -> DataFrame:
    """Signal inputs of a row that already holds base and window columns.

    ``carry`` names a struct column that keeps the whole input row.
    """
    def gap(product: str) -> str:
        held = f"coalesce(product_holdings NOT LIKE '%{product}%', false)"
        return f"CASE WHEN has_policies THEN {held} ELSE true END AS missing_{product}"

    def zero(name: str, alias: str | None = None) -> str:
        return f"coalesce({name}, 0L) AS {alias or name}"

    kept = [f"struct({', '.join(joined.columns)}) AS {carry}"] if carry else []
    return joined.selectExpr(
        "customer_id", "first_name", "last_name", "nearest_renewal_date", "days_to_renewal",
        zero("risk_negative_90d", "negative_count_90d"),
        zero("risk_complaint_90d", "complaint_count_90d"),
        zero("risk_escalation_90d", "escalation_count_90d"),
        "avg_current AS avg_sentiment_90d", "risk_worst_90d AS worst_sentiment_90d",
        "risk_last_negative AS last_negative_date", "avg_prior AS avg_sentiment_prior_90d",
        "payments_late", "payments_missed", "total_payments", "open_claims", "total_claims",
        zero("interactions_current_90d"), zero("interactions_prior_90d"),
        "active_policies", gap("home"), gap("umbrella"), "product_holdings", "has_policies",
        zero("transcripts_total"), zero("transcripts_enriched"), zero("transcripts_failed"), zero("interaction_rows"),
        *kept,
    )


# --- the eight signals -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SignalRule:
    """SQL text of one signal over the columns of ``signal_inputs``."""

    value: str
    score: str
    evidence: str
    direction: str = "'stable'"
    applies: str | None = None


def _number(value: str) -> str:
    """Two-decimal text without trailing zeros: -0.60 -> -0.6, 0.00 -> 0."""
    return f"regexp_replace(CAST(CAST(round({value}, 2) AS DECIMAL(20,2)) AS STRING), '\\\\.?0+$', '')"


def _exact(value: str) -> str:
    return f"CAST({value} AS DECIMAL(18,0))"


_BAD_PAYMENTS = "(payments_late + payments_missed)"
_TREND = direction("avg_sentiment_90d", "avg_sentiment_prior_90d", "stable")

# Steps, weights of evidence and wording of the published signals.
SIGNAL_RULES = {
    "renewal_proximity": SignalRule(
        applies="nearest_renewal_date IS NOT NULL",
        value="days_to_renewal",
        score="greatest(0, least(1, (60 - CAST(days_to_renewal AS DECIMAL(10,0))) / CAST(60 AS DECIMAL(2,0))))",
        evidence="concat('Nearest renewal in ', days_to_renewal, ' days', CASE WHEN days_to_renewal <= 14 THEN "
                 "' — URGENT' WHEN days_to_renewal <= 30 THEN ' — approaching' ELSE '' END)",
    ),
    "sentiment_negative": SignalRule(
        value="negative_count_90d",
        score="CASE negative_count_90d WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 1.0 END",
        direction=_TREND,
        evidence="concat(negative_count_90d, ' negative interaction(s) in last 90 days', CASE WHEN worst_sentiment_90d "
                 f"IS NOT NULL THEN concat(' (worst score: ', {_number('worst_sentiment_90d')}, ')') ELSE '' END)",
    ),
    "sentiment_trend": SignalRule(
        value="coalesce(avg_sentiment_90d, 0)",
        score="CASE WHEN avg_sentiment_90d IS NULL OR avg_sentiment_prior_90d IS NULL THEN 0.0 "
              "WHEN avg_sentiment_90d < avg_sentiment_prior_90d - 0.3 THEN 0.9 "
              "WHEN avg_sentiment_90d < avg_sentiment_prior_90d - 0.1 THEN 0.5 ELSE 0.1 END",
        direction=_TREND,
        evidence="concat('Sentiment trend: ', CASE WHEN avg_sentiment_90d IS NULL THEN 'insufficient data' ELSE "
                 f"concat('avg ', {_number('avg_sentiment_90d')}, ' (prior: ', "
                 f"{_number('coalesce(avg_sentiment_prior_90d, 0)')}, ')') END)",
    ),
    "payment_risk": SignalRule(
        value=_BAD_PAYMENTS,
        score=f"CASE WHEN total_payments = 0 THEN 0 ELSE least(1, try_divide({_exact(_BAD_PAYMENTS)}, "
              f"{_exact('total_payments')}) * 2.5) END",
        evidence=f"CASE WHEN {_BAD_PAYMENTS} = 0 THEN 'All payments on time' ELSE concat({_BAD_PAYMENTS}, "
                 "' late/missed of ', total_payments, ' total payments') END",
    ),
    "complaint_activity": SignalRule(
        value="complaint_count_90d + escalation_count_90d",
        score="CASE WHEN escalation_count_90d > 0 THEN 1.0 WHEN complaint_count_90d >= 2 THEN 0.8 "
              "WHEN complaint_count_90d = 1 THEN 0.5 ELSE 0.0 END",
        direction="CASE WHEN escalation_count_90d > 0 THEN 'worsening' ELSE 'stable' END",
        evidence="CASE WHEN complaint_count_90d + escalation_count_90d = 0 THEN 'No complaints or escalations in 90 days' "
                 "ELSE concat(complaint_count_90d, ' complaint(s), ', escalation_count_90d, "
                 "' escalation(s) in 90 days') END",
    ),
    "claim_activity": SignalRule(
        value="open_claims",
        score="CASE open_claims WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 ELSE 0.8 END",
        evidence="CASE WHEN open_claims = 0 THEN 'No open claims' ELSE "
                 "concat(open_claims, ' open claim(s) — active service load') END",
    ),
    # scores a rise in contacts: many contacts without resolution are the risk
    "engagement_drop": SignalRule(
        value="interactions_current_90d",
        score="CASE WHEN interactions_current_90d > interactions_prior_90d + 2 THEN 0.7 "
              "WHEN interactions_current_90d > interactions_prior_90d THEN 0.3 ELSE 0.0 END",
        direction="CASE WHEN interactions_current_90d > interactions_prior_90d + 1 THEN 'worsening' "
                  "WHEN interactions_current_90d < interactions_prior_90d - 1 THEN 'improving' ELSE 'stable' END",
        evidence="concat(interactions_current_90d, ' interactions in last 90d vs ', interactions_prior_90d, "
                 "' in prior 90d')",
    ),
    "cross_sell_opportunity": SignalRule(
        value="CAST(missing_home AS INT) + CAST(missing_umbrella AS INT)",
        score="CASE WHEN active_policies >= 2 AND missing_home THEN 0.7 "
              "WHEN active_policies >= 2 AND missing_umbrella THEN 0.6 WHEN active_policies = 1 THEN 0.4 ELSE 0.0 END",
        evidence="CASE WHEN NOT missing_home AND NOT missing_umbrella THEN 'Full product suite — no cross-sell gap' "
                 "ELSE concat('Missing: ', CASE WHEN missing_home THEN 'home ' ELSE '' END, "
                 "CASE WHEN missing_umbrella THEN 'umbrella ' ELSE '' END, '(', active_policies, ' active policies)') END",
    ),
}


def _signal_sql(name: str, weight: Decimal) -> str:
    rule = SIGNAL_RULES[name]
    raw, fixed = f"CAST({rule.score} AS DECIMAL(24,18))", f"CAST({weight} AS DECIMAL(5,4))"
    body = (
        f"named_struct('signal_type', '{name}', 'signal_value', CAST({rule.value} AS DECIMAL(20,8)), "
        f"'signal_score', CAST(round({raw}, 3) AS DECIMAL(6,3)), 'signal_weight', {fixed}, "
        f"'weighted_score', CAST(round({raw} * {fixed}, 4) AS DECIMAL(7,4)), "
        f"'signal_direction', {rule.direction}, 'evidence_text', {rule.evidence}, 'unrounded_score', {raw})"
    )
    return f"CASE WHEN {rule.applies} THEN {body} END" if rule.applies else body


def with_signals(wide: DataFrame, weights: dict[str, Decimal] | None = None) -> DataFrame:
    """Adds ``signals``: the customer's signals as one array, in the fixed signal order."""
    weights = weights or SIGNAL_WEIGHTS
    every = ", ".join(_signal_sql(s, weights[s]) for s in SIGNAL_RULES)
    return wide.withColumn("signals", F.expr(f"array_compact(array({every}))"))


def risk_signals(with_array: DataFrame) -> DataFrame:
    """Long form: one row per customer and signal."""
    return with_array.select("customer_id", F.explode("signals").alias("s")).select(
        "customer_id", "s.signal_type", "s.signal_value", "s.signal_score", "s.signal_weight", "s.weighted_score",
        "s.signal_direction", "s.evidence_text",
    )


def one_signal(wide: DataFrame, name: str, weights: dict[str, Decimal] | None = None) -> DataFrame:
    """A single signal, without computing the other seven."""
    weight = (weights or SIGNAL_WEIGHTS)[name]
    return wide.select("customer_id", F.expr(_signal_sql(name, weight)).alias("s")).filter("s is not null").select(
        "customer_id", "s.signal_value", "s.signal_score", "s.weighted_score", "s.signal_direction",
        "s.evidence_text",
    )


def risk_signals_configured(with_array: DataFrame, weights: DataFrame) -> DataFrame:
    """Signals weighted from a configuration table instead of the built-in weights."""
    scored = with_array.select("customer_id", F.explode("signals").alias("s")).select(
        "customer_id", F.col("s.signal_type").alias("signal_type"), "s.signal_score", "s.unrounded_score",
    )
    weight = F.col("signal_weight").cast("decimal(5,4)")
    return scored.join(weights.select("signal_type", "signal_weight"), "signal_type").select(
        "customer_id", "signal_type", "signal_score", weight.alias("signal_weight"),
        F.round(F.col("unrounded_score") * weight, 4).cast("decimal(7,4)").alias("weighted_score"),
    )


# --- composite -------------------------------------------------------------------------------------------------


def tier_sql(total: str) -> str:
    steps = " ".join(f"WHEN {total} >= {start} THEN '{name}'" for name, start in RISK_TIERS)
    return f"CASE {steps} ELSE '{TIER_ORDER[-1]}' END"


def overall_sql(worse: str, better: str) -> str:
    return (
        f"CASE WHEN {worse} >= 2 OR ({worse} >= 1 AND {better} = 0) THEN 'worsening' "
        f"WHEN {better} >= 2 THEN 'improving' ELSE 'stable' END"
    )


def with_risk(with_array: DataFrame) -> DataFrame:
    """Composite score, tier and directions on the customer's own row (no shuffle)."""
    weighty = "filter(signals, s -> s.signal_weight > 0)"
    row = with_array.withColumns({
        "_total": F.expr("aggregate(signals, CAST(0 AS DECIMAL(12,4)), "
                         "(acc, s) -> CAST(acc + s.weighted_score AS DECIMAL(12,4)))"),
        "worsening_signals": F.expr("size(filter(signals, s -> s.signal_direction = 'worsening'))"),
        "improving_signals": F.expr("size(filter(signals, s -> s.signal_direction = 'improving'))"),
        "top_signal_type": F.expr(f"array_max(transform({weighty}, s -> s.signal_type))"),
        "top_signal_by_score": F.expr(
            f"array_max(transform({weighty}, s -> struct(s.weighted_score, s.signal_type AS name))).name"),
        "signal_count": F.expr("size(signals)"),
    })
    return row.withColumns({
        "composite_risk_score": F.expr("CAST(round(_total, 3) AS DECIMAL(6,3))"),
        "risk_tier": F.expr(tier_sql("_total")),
        "overall_direction": F.expr(overall_sql("worsening_signals", "improving_signals")),
    }).drop("_total")


SUMMARY_COLUMNS = (
    "customer_id", "composite_risk_score", "risk_tier", "worsening_signals", "improving_signals", "top_signal_type",
    "top_signal_by_score", "overall_direction", "signal_count",
)


def risk_summary(scored: DataFrame) -> DataFrame:
    return scored.select(*SUMMARY_COLUMNS)


def summarise_signals(signals: DataFrame) -> DataFrame:
    """The same summary from a stored long-form signal table."""
    return signals.groupBy("customer_id").agg(
        F.expr("sum(weighted_score) AS _total"),
        count_where("worsening_signals", "signal_direction = 'worsening'"),
        count_where("improving_signals", "signal_direction = 'improving'"),
        F.expr("max(CASE WHEN signal_weight > 0 THEN signal_type END) AS top_signal_type"),
        F.expr("max(CASE WHEN signal_weight > 0 THEN struct(weighted_score, signal_type) END).signal_type "
               "AS top_signal_by_score"),
        F.expr("count(*) AS signal_count"),
    ).selectExpr(
        "customer_id", "CAST(round(_total, 3) AS DECIMAL(6,3)) AS composite_risk_score",
        f"{tier_sql('_total')} AS risk_tier", "worsening_signals", "improving_signals", "top_signal_type",
        "top_signal_by_score", f"{overall_sql('worsening_signals', 'improving_signals')} AS overall_direction",
        "signal_count",
    )


def risk_distribution(summary: DataFrame) -> DataFrame:
    return summary.groupBy("risk_tier").agg(F.count("*").alias("customer_count")).orderBy(
        ordinal(F.col("risk_tier"), TIER_ORDER)
    )


def signal_contributions(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """The weight table next to what each signal contributes across all customers."""
    totals = signals.groupBy("signal_type").agg(
        F.count("*").alias("customers"),
        count_if(F.col("signal_score") > 0).alias("active_customers"),
        F.sum("weighted_score").alias("total_weighted"),
    )
    return weights.join(totals, "signal_type", "left").orderBy(F.desc("signal_weight"), "signal_type")


def scenario_labels(wide: DataFrame) -> DataFrame:
    """Coarse labels used by the acceptance scenarios."""
    return wide.selectExpr(
        "customer_id",
        "CASE WHEN days_to_renewal <= 14 THEN 'very_high' WHEN days_to_renewal <= 30 THEN 'high' "
        "WHEN days_to_renewal IS NOT NULL THEN 'low' ELSE 'none' END AS renewal_proximity",
        f"CASE {_BAD_PAYMENTS} WHEN 0 THEN 'good' WHEN 1 THEN 'minor_risk' ELSE 'poor' END AS payment_behavior",
        "active_policies >= 2 AS multi_policy_flag",
        "negative_count_90d AS negative_sentiment_count_90d",
        "complaint_count_90d AS open_complaints",
        direction("avg_sentiment_90d", "avg_sentiment_prior_90d", "not_computable") + " AS sentiment_direction",
    )
