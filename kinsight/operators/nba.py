"""Next-best-action: eligibility gates, scoring, ranking, confidence, evidence.

The catalogue is a handful of entries known when the plan is built, so each
customer row carries its own candidate array: no cross join with a catalogue
table, and ranking is a sort of at most that many entries inside the row
instead of a shuffle and a window.
"""

from __future__ import annotations

from functools import reduce

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.config import (
    ACTIONS, CONFIDENCE_ORDER, PRODUCT_ACTION_EXCLUSIONS, SIGNALS, Action,
)
from kinsight.functions.numeric import count_if, ordinal, ratio

PRODUCTS = ("auto", "home", "umbrella", "renters")
# a trend only counts as active above its resting score
ACTIVE_ABOVE = {"sentiment_trend": Decimal("0.1")}

FLAG_NAMES = {
    "renewal_proximity": "has_renewal", "sentiment_negative": "has_negative_sentiment",
    "sentiment_trend": "has_sentiment_trend", "payment_risk": "has_payment_risk",
    "complaint_activity": "has_complaint", "claim_activity": "has_claim",
    "engagement_drop": "has_engagement_drop", "cross_sell_opportunity": "has_cross_sell",
}


def action_frame(spark: SparkSession, actions: tuple[Action, ...] = ACTIONS) -> DataFrame:
    """The catalogue as a table."""
    rows = [
        (a.action_id, a.action_type, a.action_name, a.action_description, a.action_category, a.safety_score,
         a.priority_rank, a.eligible_products, a.excluded_products, a.requires_risk_tier, a.requires_signal)
        for a in actions
    ]
    return spark.createDataFrame(rows, (
        "action_id string, action_type string, action_name string, action_description string, "
        "action_category string, safety_score decimal(4,2), priority_rank int, eligible_products string, "
        "excluded_products string, requires_risk_tier string, requires_signal string"))


def weight_frame(spark: SparkSession, signals=SIGNALS) -> DataFrame:
    """The signal weights as a table."""
    return spark.createDataFrame(
        [(s.signal_type, s.signal_name, s.weight, s.description, s.is_risk) for s in signals],
        "signal_type string, signal_name string, signal_weight decimal(5,4), signal_description string, "
        "is_risk_signal boolean")


# --- evidence and context --------------------------------------------------------------------------------------


EVIDENCE = (
    "transform(sort_array(transform(signals, s -> struct(-s.weighted_score AS k, s.signal_type AS t, s AS s))), e -> "
    "named_struct('signal_type', e.s.signal_type, 'signal_score', CAST(e.s.signal_score AS DOUBLE), "
    "'signal_weight', CAST(e.s.signal_weight AS DOUBLE), 'weighted_score', CAST(e.s.weighted_score AS DOUBLE), "
    "'direction', e.s.signal_direction, 'evidence', e.s.evidence_text))"
)


def _flag_sql(signal_type: str) -> str:
    floor = ACTIVE_ABOVE.get(signal_type, Decimal("0.0"))
    return f"exists(signals, s -> s.signal_type = '{signal_type}' AND s.signal_score > {floor})"


def customer_context(scored: DataFrame, *carry: str) -> DataFrame:
    """Risk row plus activity flags, evidence and enrichment coverage: everything a recommendation looks at.

    Evidence lists the signals heaviest contribution first, ties by name.
    """
    return scored.selectExpr(
        "customer_id", "composite_risk_score", "risk_tier", "overall_direction", "product_holdings",
        "CASE WHEN has_policies THEN active_policies END AS active_policies",
        f"{EVIDENCE} AS evidence_signals",
        *[f"{_flag_sql(signal)} AS {name}" for signal, name in FLAG_NAMES.items()],
        "CAST(coalesce(round(try_divide(CAST(transcripts_enriched AS DECIMAL(18,0)), "
        "CAST(transcripts_total AS DECIMAL(18,0))), 2), 0) AS DECIMAL(5,2)) AS enrichment_coverage_pct",
        "transcripts_enriched AS enriched_count",
        "transcripts_failed AS failed_count",
        *carry,
    )


def enrichment_coverage(enriched: DataFrame) -> DataFrame:
    """Contacts, enriched and failed texts per customer, and the enriched share of transcripts."""
    done = F.col("enrichment_status") == "completed"
    return enriched.groupBy("customer_id").agg(
        F.count("*").alias("total_interactions"),
        count_if(done).alias("enriched_count"),
        count_if(F.col("enrichment_status") == "failed").alias("failed_count"),
        F.count("transcript_id").alias("_texts"),
    ).select(
        "customer_id", "total_interactions", "enriched_count", "failed_count",
        ratio(F.col("enriched_count"), F.col("_texts"), 2).alias("enrichment_coverage_pct"),
    )


def evidence_rows(context: DataFrame) -> DataFrame:
    """Evidence in long form with its position, next to the activity flags."""
    return context.select("customer_id", *FLAG_NAMES.values(), F.posexplode("evidence_signals").alias("position", "e")) \
        .select("customer_id", "position", "e.*", *[F.col(f).cast("int").alias(f) for f in FLAG_NAMES.values()])


# --- candidates ------------------------------------------------------------------------------------------------


# Named conditions the catalogue's relevance points refer to, as SQL text over the customer context.
CONDITIONS = {
    **FLAG_NAMES,
    "always": "true",
    "tier_low": "risk_tier = 'low'",
    "tier_low_or_medium": "risk_tier IN ('low', 'medium')",
    "multi_policy": "coalesce(active_policies >= 2, false)",
}


def _holds_any(listed: str) -> str:
    """Does the customer hold one of the listed products? Unknown holdings count as none."""
    hits = " OR ".join(f"product_holdings LIKE '%{p}%'" for p in PRODUCTS if p in listed)
    return f"coalesce({hits or 'false'}, false)"


def gates(action: Action) -> dict[str, str]:
    tiers = ", ".join(f"'{t}'" for t in (action.requires_risk_tier or "").split(","))
    return {
        "product_eligible": "true" if action.eligible_products == "ALL" else _holds_any(action.eligible_products),
        "not_excluded": f"NOT {_holds_any(action.excluded_products)}" if action.excluded_products else "true",
        "risk_tier_eligible": f"risk_tier IN ({tiers})" if action.requires_risk_tier else "true",
        "signal_eligible": CONDITIONS[action.requires_signal] if action.requires_signal else "true",
    }


def relevance(action: Action) -> str:
    points = " + ".join(f"CASE WHEN {CONDITIONS[c]} THEN {p} ELSE 0.0 END" for c, p in action.relevance)
    return f"CAST({points} AS DECIMAL(6,3))"


def _candidate(position: int, action: Action) -> str:
    """Sort key first: final score descending, then catalogue priority ascending."""
    fit = relevance(action)
    checks = ", ".join(f"'{name}', {gate}" for name, gate in gates(action).items())
    return (
        f"named_struct('final_score', CAST({fit} * {action.safety_score} AS DECIMAL(8,5)), "
        f"'_order', {-action.priority_rank}, '_action', {position}, 'relevance_score', {fit}, {checks})"
    )


def _attributes(actions: tuple[Action, ...], *names: str) -> list[Column]:
    """Catalogue attributes by position: a lookup in a constant array, not a join."""
    return [
        F.element_at(F.lit([getattr(a, n) for a in actions]), F.col("_action") + 1).alias(n) for n in names
    ]


def candidates(context: DataFrame, actions: tuple[Action, ...] = ACTIONS) -> DataFrame:
    """Every customer with every catalogue action, its four gates and its scores."""
    matrix = ", ".join(_candidate(i, a) for i, a in enumerate(actions))
    return context.withColumn("c", F.expr(f"explode(array({matrix}))")).select(
        *context.columns, "c.final_score", "c.relevance_score", "c.product_eligible", "c.not_excluded",
        "c.risk_tier_eligible", "c.signal_eligible", F.col("c._action").alias("_action"),
    ).select(
        "*", *_attributes(actions, "action_id", "action_type", "priority_rank", "safety_score")
    ).drop("_action")


CONFIDENCE_LEVEL = (
    "CASE WHEN enrichment_coverage_pct >= 0.8 AND enriched_count >= 2 THEN 'high' "
    "WHEN enrichment_coverage_pct >= 0.5 AND enriched_count >= 1 THEN 'medium_high' "
    "WHEN enriched_count >= 1 THEN 'medium' ELSE 'low' END"
)
CONFIDENCE_SCORE = (
    "CAST(round(least(1.0, 0.4 * enrichment_coverage_pct "
    "+ 0.3 * least(1.0, CAST(enriched_count AS DECIMAL(18,0)) / CAST(3 AS DECIMAL(18,0))) "
    "+ CASE WHEN composite_risk_score > 0 THEN 0.30 ELSE 0.15 END), 2) AS DECIMAL(4,2))"
)


def ranked_actions(actions: tuple[Action, ...], exclusions: tuple[tuple[str, str, str], ...] = ()) -> str:
    """SQL text: the customer's eligible actions, best first; ineligible entries are NULL and sort last."""
    barred: dict[str, list[str]] = {}
    for product, action_type, _ in exclusions:
        barred.setdefault(action_type, []).append(product)

    def offered(position: int, action: Action) -> str:
        passed = list(gates(action).values())
        if action.action_type in barred:
            passed.append(f"NOT {_holds_any(','.join(barred[action.action_type]))}")
        return f"CASE WHEN {' AND '.join(passed)} THEN {_candidate(position, action)} END"

    return f"sort_array(array({', '.join(offered(i, a) for i, a in enumerate(actions))}), false)"


def _recommendation(actions: tuple[Action, ...]) -> list[Column]:
    return [
        *_attributes(actions, "action_id", "action_type", "action_name", "action_description", "action_category"),
        F.round("c.relevance_score", 3).alias("relevance_score"),
        *_attributes(actions, "safety_score"),
        F.round("c.final_score", 3).cast("decimal(6,3)").alias("final_score"),
        "risk_tier", "composite_risk_score", "overall_direction", "confidence_level", "confidence_score",
        "evidence_signals",
        F.expr(
            "named_struct('enrichment_coverage_pct', CAST(enrichment_coverage_pct AS DOUBLE), "
            "'enriched_interactions', enriched_count, 'risk_signals_computed', size(evidence_signals), "
            "'has_sentiment_data', has_negative_sentiment OR enriched_count > 0) AS data_completeness"),
        "product_holdings", "active_policies",
        F.struct("c.product_eligible", "c.not_excluded", "c.risk_tier_eligible", "c.signal_eligible")
        .alias("eligibility_check"),
    ]


def _with_confidence(context: DataFrame) -> DataFrame:
    return context.withColumns(
        {"confidence_level": F.expr(CONFIDENCE_LEVEL), "confidence_score": F.expr(CONFIDENCE_SCORE)})


def recommend(
    context: DataFrame, actions: tuple[Action, ...] = ACTIONS, keep: int = 4, withhold_low_confidence: bool = False,
    exclusions: tuple[tuple[str, str, str], ...] = (),
) -> DataFrame:
    """Ranked recommendations, at most ``keep`` per customer, with score, confidence, evidence and audit trail.

    ``withhold_low_confidence`` drops customers without any enriched contact;
    ``exclusions`` adds (product, action type) pairs that are never offered.
    Both are off by default.
    """
    chosen = _with_confidence(context)
    if withhold_low_confidence:
        chosen = chosen.filter(F.col("confidence_level") != "low")
    best = F.expr(f"slice({ranked_actions(actions, exclusions)}, 1, {keep})")
    flat = chosen.select("*", F.posexplode(best).alias("_pos", "c")).filter("c is not null") \
        .withColumn("_action", F.col("c._action"))
    return flat.select(
        "customer_id",
        (F.col("_pos") + 1).alias("action_rank"),
        *_recommendation(actions),
        F.lit(False).alias("is_approved"),
        *[F.lit(None).cast("string").alias(c) for c in ("approved_by", "approved_at", "approval_notes")],
    )


def attach_primary(context: DataFrame, actions: tuple[Action, ...], carry: tuple[str, ...]) -> DataFrame:
    """One row per customer with the best action's columns, NULL where nothing is eligible."""
    first = F.expr(f"element_at({ranked_actions(actions)}, 1)")
    return _with_confidence(context).withColumn("c", first).withColumn("_action", F.col("c._action")).select(
        "customer_id", *carry, *_recommendation(actions)
    )


def primary(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter(F.col("action_rank") == 1)


def alternatives(recommendations: DataFrame) -> DataFrame:
    """Every kept action but the first; how many are kept is decided where they are ranked."""
    return recommendations.filter(F.col("action_rank") >= 2)


def rank_candidates(scored: DataFrame, keep: int = 4) -> DataFrame:
    """Ranking of a stored candidate table: top ``keep`` eligible actions per customer."""
    best = Window.partitionBy("customer_id").orderBy(F.desc("final_score"), "priority_rank")
    eligible = scored.filter("product_eligible and not_excluded and risk_tier_eligible and signal_eligible")
    return eligible.withColumn("action_rank", F.row_number().over(best)).filter(F.col("action_rank") <= keep)


# --- reports ---------------------------------------------------------------------------------------------------


def action_distribution(primary_recommendations: DataFrame) -> DataFrame:
    return primary_recommendations.groupBy("action_type").agg(F.count("*").alias("customer_count")).orderBy(
        F.desc("customer_count"), "action_type"
    )


def confidence_distribution(primary_recommendations: DataFrame) -> DataFrame:
    return primary_recommendations.groupBy("confidence_level").agg(F.count("*").alias("cnt")).orderBy(
        ordinal(F.col("confidence_level"), CONFIDENCE_ORDER)
    )


def catalogue_listing(actions: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Catalogue in priority order with how often each action is recommended and how often it comes first."""
    use = recommendations.groupBy("action_id").agg(
        F.count("*").alias("recommended"), count_if(F.col("action_rank") == 1).alias("primary_count")
    )
    return actions.select(
        "action_id", "action_type", "action_category", "safety_score", "priority_rank", "eligible_products",
        "requires_risk_tier", "requires_signal",
    ).join(use, "action_id", "left").fillna(0, ["recommended", "primary_count"]).orderBy("priority_rank")


def rule_exclusions(recommendations: DataFrame, rules: DataFrame) -> DataFrame:
    """Recommendations left after removing (product, action) pairs a rule table forbids."""
    held = recommendations.withColumn("product_type", F.explode(F.split(F.coalesce("product_holdings", F.lit("")), ", ")))
    forbidden = held.join(rules.select("product_type", "action_type"), ["product_type", "action_type"], "left_semi") \
        .select("customer_id", "action_type").distinct()
    return recommendations.join(forbidden, ["customer_id", "action_type"], "left_anti")


def exclusion_frame(spark: SparkSession, rules=PRODUCT_ACTION_EXCLUSIONS) -> DataFrame:
    return spark.createDataFrame(list(rules), "product_type string, action_type string, rule_description string")


def evidence_lineage(
    enriched: DataFrame, payments: DataFrame, claims: DataFrame, policies: DataFrame, agg_policy: DataFrame, clock
) -> DataFrame:
    """Which source rows stand behind each signal: one row per (customer, signal, source row), for all eight signals.

    Long form on purpose: a customer with many contacts must not become one huge array. Contacts are read once.
    """
    done, now = F.col("enrichment_status") == "completed", clock.in_current(F.col("interaction_date"))

    def rows(df: DataFrame, signal: str, kind: str, key: str) -> DataFrame:
        return df.select("customer_id", F.lit(signal).alias("signal_type"), F.lit(kind).alias("source_type"),
                         F.col(key).cast("string").alias("source_id"))

    signals = F.array_compact(F.array(
        F.when(done & now & (F.col("sentiment_label") == "negative"), F.lit("sentiment_negative")),
        F.when(done & now & (F.col("is_complaint") | F.col("is_escalation")), F.lit("complaint_activity")),
        F.when(done, F.lit("sentiment_trend")),
        F.lit("engagement_drop"),
    ))
    sources = F.array_compact(F.array(
        F.struct(F.lit("interaction").alias("source_type"), F.col("interaction_id").cast("string").alias("source_id")),
        F.when(F.col("transcript_id").isNotNull(), F.struct(
            F.lit("transcript").alias("source_type"), F.col("transcript_id").cast("string").alias("source_id"))),
    ))
    recent = enriched.filter(clock.in_recent(F.col("interaction_date")))
    from_contacts = recent.withColumn("signal_type", F.explode(signals)).select(
        "customer_id", "signal_type", F.explode(sources).alias("s")
    ).select("customer_id", "signal_type", "s.source_type", "s.source_id")
    from_payments = rows(payments.filter(F.col("status").isin("late", "missed")), "payment_risk", "payment", "payment_id")
    from_claims = rows(claims.filter(F.col("status").isin("filed", "under_review")), "claim_activity", "claim", "claim_id")
    active = policies.filter(F.col("status") == "active")
    nearest = agg_policy.select("customer_id", F.col("nearest_renewal_date").alias("expiration_date"))
    from_renewals = rows(active.join(nearest, ["customer_id", "expiration_date"]), "renewal_proximity", "policy", "policy_id")
    from_holdings = rows(active, "cross_sell_opportunity", "policy", "policy_id")
    parts = (from_payments, from_claims, from_renewals, from_holdings)
    return reduce(DataFrame.unionByName, parts, from_contacts)
