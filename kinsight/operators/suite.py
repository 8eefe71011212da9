"""The pipeline validation suite: forty PASS/FAIL rows over enrichment, signals, recommendations and profile.

Each product is scanned once: its checks are conditional aggregates of the same
row, unpivoted afterwards. The acceptance checks that vouch for particular
customers take a cohort; without one they cover every customer.

The names of the checks that mean the same as the published ones are theirs
(fixed values); checks on one named customer are about a cohort here and named
for that.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.config import ACTIONS, INTENTS, SIGNAL_WEIGHTS, TOPICS, URGENCIES
from kinsight.functions.numeric import count_if
from kinsight.operators.quality import union

RETENTION_ACTIONS = ("retention_outreach", "complaint_followup")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def _rows(one_row: DataFrame, checks: list[tuple[str, Column, str, Column]]) -> DataFrame:
    """(name, passes, label, counted) per check over a one-row aggregate."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("check_name"),
            F.when(F.coalesce(passes, F.lit(False)), "PASS").otherwise("FAIL").alias("status"),
            F.concat(F.lit(f"{label}: "), _text(counted)).alias("detail"),
        )
        for name, passes, label, counted in checks
    ])
    return one_row.select(F.explode(rows).alias("r")).select("r.check_name", "r.status", "r.detail")


def _zero(metrics: dict[str, tuple[str, str]]) -> list[tuple[str, Column, str, Column]]:
    return [(name, F.col(c) == 0, label, F.col(c)) for name, (c, label) in metrics.items()]


def enrichment_checks(enriched: DataFrame, expected_rows: int | None, expected_completed: int | None) -> DataFrame:
    done = F.col("enrichment_status") == "completed"
    score, label = F.col("sentiment_score"), F.col("sentiment_label")
    low, high = F.lit(Decimal("-0.2")), F.lit(Decimal("0.2"))
    agrees = (
        ((score < low) & (label == "negative")) | ((score > high) & (label == "positive"))
        | (score.between(low, high) & (label == "neutral"))
    )
    leaked = score.isNotNull() | F.col("summary").isNotNull() | F.col("primary_topic").isNotNull() \
        | F.col("primary_intent").isNotNull()
    m = enriched.agg(
        F.count("*").alias("rows"),
        count_if(done).alias("completed"),
        count_if(F.col("enrichment_status") == "failed").alias("failed"),
        count_if(done & score.isNull()).alias("null_score"),
        count_if(done & ~score.between(-1, 1)).alias("out_of_range"),
        count_if(done & ~agrees).alias("mislabelled"),
        count_if(done & F.col("summary").isNull()).alias("null_summary"),
        count_if(done & ~F.col("primary_topic").isin(*TOPICS)).alias("bad_topic"),
        count_if(done & ~F.col("primary_intent").isin(*INTENTS)).alias("bad_intent"),
        count_if(~F.col("urgency_level").isin(*URGENCIES)).alias("bad_urgency"),
        count_if((F.col("enrichment_status") == "consent_withheld") & leaked).alias("leaked"),
    )
    right_rows = F.col("rows") > 0 if expected_rows is None else F.col("rows") == expected_rows
    right_done = F.col("failed") == 0
    if expected_completed is not None:
        right_done = right_done & (F.col("completed") == expected_completed)
    repeated = enriched.groupBy("interaction_id").agg(F.count("*").alias("n")).filter("n > 1").agg(
        F.count("*").alias("n"))
    return _rows(m, [
        ("T01_ENRICHED_TABLE_EXISTS", right_rows, "rows", F.col("rows")),
        ("T02_CONSENTED_TRANSCRIPTS_ENRICHED", right_done, "failed", F.col("failed")),
        *_zero({
            "T03_SENTIMENT_SCORE_NOT_NULL": ("null_score", "completed rows without score"),
            "T04_SENTIMENT_SCORE_RANGE": ("out_of_range", "scores out of range"),
            "T05_SENTIMENT_LABEL_CONSISTENT": ("mislabelled", "label/score mismatches"),
            "T06_SUMMARY_POPULATED": ("null_summary", "completed rows without summary"),
            "T07_TOPIC_ENUM_VALID": ("bad_topic", "invalid topics"),
            "T08_INTENT_ENUM_VALID": ("bad_intent", "invalid intents"),
            "T09_URGENCY_ENUM_VALID": ("bad_urgency", "invalid urgencies"),
            "T11_CONSENT_WITHHELD_NO_AI": ("leaked", "withheld rows with derived values"),
        }),
    ]).unionByName(_rows(repeated, [("T10_ENRICHED_NO_DUPLICATES", F.col("n") == 0, "repeated interaction ids", F.col("n"))]))


def cohort_checks(profile: DataFrame, enriched: DataFrame, scored: DataFrame, recommendations: DataFrame,
                  cohort: DataFrame | None) -> DataFrame:
    """Acceptance checks per customer, counted over the cohort: how many customers fall short."""
    members = cohort if cohort is not None else profile.select("customer_id")
    contacts = enriched.groupBy("customer_id").agg(
        F.count("transcript_id").alias("texts"),
        count_if(F.col("enrichment_status") == "completed").alias("texts_done"),
        count_if((F.col("enrichment_status") == "completed") & F.col("summary").isNull()).alias("no_summary"),
        count_if(F.col("is_complaint")).alias("complaints"),
    )
    signals = F.col("signals")

    def score_of(name: str) -> Column:
        return F.exists(signals, lambda s: (s["signal_type"] == name) & (s["signal_score"] > 0))

    risk = scored.select(
        "customer_id", F.size(signals).alias("signal_types"), score_of("renewal_proximity").alias("renewal_on"),
        score_of("sentiment_negative").alias("negative_on"), F.col("risk_tier").alias("summary_tier"),
    )
    offers = recommendations.groupBy("customer_id").agg(
        F.count("*").alias("offers"),
        count_if(F.col("action_rank") == 1).alias("firsts"),
        F.max(F.when(F.col("action_rank") == 1, F.size("evidence_signals"))).alias("evidence"),
        F.max(F.when(F.col("action_rank") == 1, F.col("final_score"))).alias("best_score"),
        count_if((F.col("action_rank") == 1) & F.col("data_completeness.enrichment_coverage_pct").isNotNull())
        .alias("complete"),
    )
    row = members.join(profile.withColumn("_in_profile", F.lit(True)), "customer_id", "left") \
        .join(contacts, "customer_id", "left").join(risk, "customer_id", "left").join(offers, "customer_id", "left")
    texts = F.coalesce("texts", F.lit(0))
    good = {
        "T12_CUSTOMER_EXISTS": F.col("_in_profile").isNotNull(),
        "T13_TEXTS_ENRICHED": texts == F.coalesce("texts_done", F.lit(0)),
        "T14_NEGATIVE_SENTIMENT": F.col("negative_count_90d") >= 2,
        "T15_HAS_COMPLAINT": F.col("complaints") >= 1,
        "T16_SUMMARIES_POPULATED": F.coalesce("no_summary", F.lit(0)) == 0,
        "T18_ALL_SIGNAL_TYPES": F.col("signal_types") == len(SIGNAL_WEIGHTS),
        "T19_RENEWAL_ACTIVE": F.col("renewal_on"),
        "T20_NEGATIVE_ACTIVE": F.col("negative_on"),
        "T21_TIER_ELEVATED": F.col("summary_tier").isin("high", "critical"),
        "T26_PRIMARY_EXISTS": F.col("firsts") == 1,
        "T27_PRIMARY_IS_RETENTION": F.col("nba_action_type").isin(*RETENTION_ACTIONS),
        "T28_HAS_ALTERNATIVES": F.col("offers") >= 2,
        "T29_CONFIDENCE_NOT_LOW": F.col("nba_confidence_level") != "low",
        "T30_EVIDENCE_POPULATED": F.col("evidence") > 0,
        "T31_COMPLETENESS_POPULATED": F.col("complete") == 1,
        "T32_SCORE_POSITIVE": F.col("best_score") > 0,
        "T33_PROFILE_COMPLETE": F.col("has_enrichment") & F.col("has_risk_signals") & F.col("has_recommendation"),
        "T34_SYSTEM_FULL": F.col("system_status") == "full",
        "T35_PROFILE_NEGATIVE": F.col("negative_count_90d") >= 2,
        "T36_RENEWAL_IN_WINDOW": (F.col("days_to_renewal") <= 30) & (F.col("days_to_renewal") > 0),
        "T37_PROFILE_ACTION": F.col("nba_action_type").isNotNull(),
    }
    short = row.agg(*[count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in good.items()])
    return _rows(short, [(name, F.col(name) == 0, "customers falling short", F.col(name)) for name in good])


def product_checks(signals: DataFrame, weights: DataFrame, actions: DataFrame, recommendations: DataFrame) -> DataFrame:
    spread = signals.agg(
        F.count("*").alias("rows"), count_if(~F.col("signal_score").between(0, 1)).alias("out_of_range"))
    total = weights.agg(F.sum("signal_weight").cast("decimal(6,2)").alias("total"))
    library = actions.agg(F.count("*").alias("n"))
    offered = recommendations.agg(F.count("*").alias("n"))
    firsts = recommendations.filter(F.col("action_rank") == 1).groupBy("customer_id").agg(F.count("*").alias("n")) \
        .filter("n > 1").agg(F.count("*").alias("n"))
    return union([
        _rows(spread, [
            ("T17_RISK_SIGNALS_POPULATED", F.col("rows") > 0, "signal rows", F.col("rows")),
            ("T22_SIGNAL_SCORES_IN_RANGE", F.col("out_of_range") == 0, "scores outside [0,1]", F.col("out_of_range")),
        ]),
        _rows(total, [("T23_SIGNAL_WEIGHTS_SUM_TO_ONE", F.abs(F.col("total") - 1) < F.lit(Decimal("0.001")),
                       "sum of weights", F.col("total"))]),
        _rows(library, [("T24_ACTION_LIBRARY_LOADED", F.col("n") == len(ACTIONS), "actions", F.col("n"))]),
        _rows(offered, [("T25_NBA_RECOMMENDATIONS_POPULATED", F.col("n") > 0, "recommendations", F.col("n"))]),
        _rows(firsts, [("T40_UNIQUE_PRIMARY_NBA_PER_CUSTOMER", F.col("n") == 0, "customers with several primaries", F.col("n"))]),
    ])


def cross_layer_checks(enriched: DataFrame, base: DataFrame, signals: DataFrame) -> DataFrame:
    contacted = enriched.groupBy("customer_id").agg(F.count("*").alias("n")).select("customer_id")
    orphans = contacted.join(base.select("customer_id"), "customer_id", "left_anti").agg(F.count("*").alias("n"))
    claimed = signals.filter(
        F.col("signal_type").isin("sentiment_negative", "complaint_activity") & (F.col("signal_score") > 0)
    ).select("customer_id").distinct()
    unbacked = claimed.join(contacted, "customer_id", "left_anti").agg(F.count("*").alias("n"))
    return _rows(orphans, [("T38_NO_ORPHAN_ENRICHED_CUSTOMERS", F.col("n") == 0, "enriched customers not in the base", F.col("n"))]) \
        .unionByName(_rows(unbacked, [("T39_RISK_SIGNALS_HAVE_INTERACTIONS", F.col("n") == 0,
                                       "contact signals without contacts", F.col("n"))]))


def pipeline_suite(
    enriched, base, profile, scored, signals, recommendations, weights, actions,
    cohort: DataFrame | None = None, expected_rows: int | None = None, expected_completed: int | None = None,
) -> DataFrame:
    return union([
        enrichment_checks(enriched, expected_rows, expected_completed),
        cohort_checks(profile, enriched, scored, recommendations, cohort),
        product_checks(signals, weights, actions, recommendations),
        cross_layer_checks(enriched, base, signals),
    ]).orderBy("check_name")
