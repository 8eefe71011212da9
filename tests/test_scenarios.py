from functools import reduce

import pytest
from pyspark.sql import functions as F

from kinsight.operators import aggregates, enrichment, nba, profile, risk
from kinsight.plans.pipeline import Build
from scenarios import NOW, RULES, SETTINGS, Scenarios


@pytest.fixture(scope="module")
def build(spark, tmp_path_factory):
    return Build(Scenarios(spark), SETTINGS, workspace=str(tmp_path_factory.mktemp("build")))


@pytest.fixture(scope="module")
def people(build):
    return {r.customer_id: r for r in build.profile.collect()}


@pytest.fixture(scope="module")
def signals(build):
    return {(r.customer_id, r.signal_type): r for r in build.signals.collect()}


def test_one_row_per_customer(people):
    assert len(people) == 12


def test_worsening_multi_policy_customer(people, signals):
    p = people["C1"]
    assert (p.negative_count_90d, p.sentiment_direction, p.active_policies) == (2, "worsening", 2)
    assert p.risk_tier in ("high", "critical") and p.nba_action_type in ("retention_outreach", "complaint_followup")
    assert p.system_status == "full" and float(signals["C1", "payment_risk"].signal_score) == 0
    assert signals["C1", "renewal_proximity"].evidence_text == "Nearest renewal in 16 days — approaching"


def test_claim_and_late_payment(people, signals):
    assert people["C2"].negative_count_90d == 2
    assert float(signals["C2", "claim_activity"].signal_score) == 0.4
    assert float(signals["C2", "payment_risk"].signal_score) == 0.625


def test_positive_only_gets_no_retention(build, people):
    offers = build.recommendations.filter("customer_id = 'C3'").collect()
    assert people["C3"].negative_count_90d == 0
    assert "retention_outreach" not in {o.action_type for o in offers}


def test_distant_renewal_many_negatives(signals):
    assert float(signals["C4", "renewal_proximity"].signal_score) == 0
    assert float(signals["C4", "sentiment_negative"].signal_score) == 1.0


def test_no_recent_contact_is_degraded(people):
    assert people["C5"].sentiment_direction == "insufficient_data"
    assert people["C5"].system_status == "degraded_no_enrichment"


def test_contact_without_text(build):
    kinds = [r.enrichment_status for r in build.enriched.filter("customer_id = 'C6'").collect()]
    assert sorted(kinds) == ["completed", "not_applicable"]


def test_refused_text_leaves_no_trace(build, people):
    refused = build.enriched.filter("enrichment_status = 'consent_withheld'").collect()
    assert len(refused) == 1 and people["C7"].negative_count_90d == 1
    assert all(refused[0][c] is None for c in ("sentiment_score", "summary", "primary_topic", "extraction_raw"))


def test_grace_is_not_late(signals):
    assert float(signals["C8", "payment_risk"].signal_score) == 1.0  # min(1, 3/4 * 2.5)
    assert float(signals["C8", "payment_risk"].signal_value) == 3


def test_complaint_signal(signals):
    assert float(signals["C9", "complaint_activity"].signal_score) == 0.5


def test_single_renters_policy_has_gaps(build):
    row = build.wide.filter("customer_id = 'C10'").first()
    assert row.missing_home and row.missing_umbrella


def test_household_total(build):
    rolled = {r.household_id: r for r in aggregates.household_policies(build.customers, build.policies).collect()}
    assert rolled["H11"].household_policy_count == 4 and rolled["H11"].household_member_count == 2


def test_improving_mixed_signals(people, build):
    assert people["C12"].sentiment_direction == "improving"
    labels = risk.scenario_labels(build.wide).filter("customer_id = 'C12'").first()
    assert (labels.renewal_proximity, labels.payment_behavior) == ("very_high", "poor")


def test_scores_and_ranks_stay_in_bounds(build):
    assert build.signals.filter("signal_score < 0 or signal_score > 1").count() == 0
    assert build.recommendations.filter("action_rank not between 1 and 4").count() == 0
    assert sum(SETTINGS.weights.values()) == 1


def test_row_ranking_equals_window_ranking(build):
    def key(df):
        return sorted((r.customer_id, r.action_rank, r.action_type) for r in df.collect())

    assert key(nba.rank_candidates(nba.candidates(build.context))) == key(build.recommendations)


def test_fused_windows_equal_single_definitions(build):
    one = {r.customer_id: r for r in risk.sentiment_windows(build.enriched, SETTINGS.clock).collect()}
    for r in build.windows.collect():
        if r.customer_id in one:
            assert r.risk_negative_90d == one[r.customer_id].negative_count_90d
            assert r.avg_current == one[r.customer_id].avg_sentiment_90d


def test_timeline_is_newest_first(build):
    entries = profile.timeline_entries(build.enriched, SETTINGS.clock)
    want = {}
    for r in sorted(entries.collect(), key=lambda r: (-r.interaction_date.timestamp(), r.interaction_id)):
        want.setdefault(r.customer_id, []).append(r.interaction_id)
    assert {r.customer_id: [d.interaction_id for d in r.details] for r in profile.timeline(entries).collect()} == want


def test_scorer_never_sees_refused_text(spark, build):
    def spy(df):
        assert "raw_text" not in df.columns
        return df.withColumn("sentiment_raw", F.when(F.col("scorable_text").isNotNull(), F.lit(0.5))).withColumn(
            "extraction_raw", F.concat(F.lit('{"summary":"'), F.col("scorable_text"), F.lit('"}')))

    out = enrichment.enrich(build.interactions, build.transcripts, RULES, spy)
    assert out.filter("enrichment_status = 'consent_withheld' and summary is not null").count() == 0
    done = out.filter("enrichment_status = 'completed'").select("primary_topic", "primary_intent").distinct().collect()
    assert [tuple(r) for r in done] == [("general", "inquiry")]


@pytest.mark.parametrize("score, raw, status", [
    (0.3, "not json", "failed"), (1.7, '{"topic":"claims"}', "failed"), (float("nan"), '{"topic":"claims"}', "failed"),
    (None, '{"topic":"claims"}', "failed"), (0.3, None, "failed"), (0.3, '{"topic":"DROP TABLE","intent":7}', "completed"),
])
def test_scorer_output_is_validated(spark, build, score, raw, status):
    def scorer(df):
        return df.withColumn("sentiment_raw", F.lit(score).cast("double")).withColumn(
            "extraction_raw", F.lit(raw).cast("string"))

    out = enrichment.enrich(build.interactions, build.transcripts, RULES, scorer).filter(
        "transcript_id is not null and enrichment_status != 'consent_withheld'")
    row = out.first()
    assert row.enrichment_status == status
    assert row.primary_topic in (None, "general", "claims") and row.urgency_level in ("critical", "high", "medium", "low")
    assert (row.enrichment_error is None) == (status == "completed")


def test_optional_rules(build):
    withheld = nba.recommend(build.context, withhold_low_confidence=True)
    assert withheld.filter("confidence_level = 'low'").count() == 0
    barred = nba.recommend(build.context, exclusions=(("auto", "renewal_reminder", ""),))
    held = barred.filter("action_type = 'renewal_reminder'")
    assert held.filter("product_holdings like '%auto%'").count() == 0


def test_clock_bounds():
    assert str(NOW.year) in SETTINGS.clock.now_sql()
    assert reduce(lambda a, b: a and b, ["2025-04-01" in SETTINGS.clock.current_sql(),
                                         "2025-01-01" in SETTINGS.clock.recent_sql()])
