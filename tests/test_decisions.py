"""Joins of the decision products: whole results, and no side is broadcast, for files say little about the size of its rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kinsight.operators import decisions
from kinsight.session import run_folder

DAY = datetime(2000, 1, 1)
MADE = [  # customer 4 has no recommendation, customer 1 decides twice
    (1, datetime(2000, 1, 1), "approved", None), (1, datetime(2000, 2, 1), "modified", "own plan"), (2, DAY, "rejected", None),
    (3, DAY, "timeout", None), (4, DAY, "approved", None), (None, DAY, "approved", None)]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(k, at, at, what, text, "", f"rep-{k}", "s") for k, at, what, text in MADE]
    return spark.createDataFrame(rows, "customer_id long, presented_at timestamp_ntz, decided_at timestamp_ntz, decision string, "
                                 "action_text string, notes string, representative_id string, session_id string")


@pytest.fixture(scope="module")
def primary(spark):
    return spark.range(1, 4).selectExpr(
        "if(id = 3, null, id) AS customer_id", "concat('type-', id) AS action_type", "'name' AS action_name", "concat('do ', id) AS action_description",
        "'low' AS confidence_level", "0.5 AS confidence_score", "0.4 AS composite_risk_score", "if(id = 1, 'high', 'medium') AS risk_tier",
        "0.3 AS final_score", "array(named_struct('s', id)) AS evidence_signals", "named_struct('c', id) AS data_completeness",
        "named_struct('e', true) AS eligibility_check")


def stored(df):
    folder = run_folder(df.sparkSession, "decisions")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@pytest.fixture(scope="module")
def log(made, primary):
    return stored(decisions.recommendation_log(made, primary))


@pytest.fixture(scope="module")
def events(made, log):
    return stored(decisions.decision_events(made, log))


@pytest.fixture(scope="module")
def follow_ups(made, log):
    return stored(decisions.follow_ups(made, log))


def whole(df, joins):
    """The rows of a frame that is planned and run with so many joins, all of them merges."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == joins, plan
    return rows


def test_every_decision_with_a_recommendation_is_logged(made, primary):
    rows = whole(decisions.recommendation_log(made, primary), 1)
    assert sorted((r.customer_id, r.created_at.month, r.action_type) for r in rows) == [(1, 1, "type-1"), (1, 2, "type-1"), (2, 1, "type-2")]
    assert len({r.recommendation_log_id for r in rows}) == 3 and all("eligibility_check" in r.recommendation_payload for r in rows)


def test_events_and_follow_ups_of_logged_decisions(made, log):
    rows = whole(decisions.decision_events(made, log), 1)
    assert sorted((r.customer_id, r.event_type) for r in rows) == [
        (1, "approved"), (1, "modified"), (1, "presented"), (1, "presented"), (2, "presented"), (2, "rejected")]
    rows = whole(decisions.follow_ups(made, log), 1)
    assert sorted((r.customer_id, r.action_taken) for r in rows) == [(1, "do 1"), (1, "own plan")]


def test_snapshots_of_logged_recommendations(spark, log):
    people = spark.range(1, 9).selectExpr("id AS customer_id", "repeat('x', 100) AS city", "true AS has_email")
    rows = whole(decisions.context_snapshot(log, people, ["customer_id", "city"]), 1)
    assert sorted(r.customer_id for r in rows) == [1, 1, 2] and all("xxx" in r.snapshot_data for r in rows)


def outcomes_of(follow_ups):
    return follow_ups.select("follow_up_id", "customer_id", F.when(F.col("follow_up_status") == "approved", "renewed").otherwise(
        "lapsed").alias("outcome_type"), F.lit(date(2000, 3, 1)).alias("observed_date"))


def test_history_has_a_row_for_each_event(log, events, follow_ups):
    snapshots = log.select("recommendation_log_id", F.lit("c").alias("context_snapshot_id"))
    rows = whole(decisions.decision_history(log, snapshots, follow_ups, outcomes_of(follow_ups), events), 4)
    assert sorted((r.customer_id, r.event_type, r.outcome_type or "") for r in rows) == [
        (1, "approved", "renewed"), (1, "modified", "lapsed"), (1, "presented", "lapsed"), (1, "presented", "renewed"),
        (2, "presented", ""), (2, "rejected", "")]


def test_rates_by_active_signals(spark, log, follow_ups):
    signals = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.1), (1, "c", 0.0), (2, "a", 1.0)], "customer_id long, signal_type string, weighted_score double")
    rows = whole(decisions.outcome_rates(outcomes_of(follow_ups), follow_ups, log, signals), 3)
    assert [(r.signal_combination, r.action_type, r.follow_ups, r.renewed) for r in rows] == [("a + b", "type-1", 2, 1)]


def test_orphans_are_counted(log, events, follow_ups):
    known = log.filter("risk_tier != 'medium'")
    rows = whole(decisions.decision_integrity(known, events, follow_ups, outcomes_of(follow_ups).unionByName(
        outcomes_of(follow_ups).limit(1).withColumn("follow_up_id", F.lit(None).cast("string")))), 4)
    found = {r.check_name: r.violations for r in rows}
    assert found["event_without_recommendation"] == 2 and found["outcome_without_follow_up"] == 1
    assert sum(found.values()) == 3 and len(found) == 8


def test_metrics_of_guided_customers(spark, log, events, follow_ups):
    contacts = spark.createDataFrame([(1, 60), (2, 30), (7, 90), (7, None)], "customer_id long, duration_seconds long")
    policies = spark.createDataFrame([(1, "active"), (2, "lapsed"), (8, "renewed")], "customer_id long, status string")
    rows = whole(decisions.programme_metrics(log, events, follow_ups, outcomes_of(follow_ups), contacts, policies), 3)
    found = {r.metric: r.value for r in rows}
    assert found["handle_time_change"] == 0.0 and found["retention_delta"] == 0.5
    assert found["acceptance_rate"] == pytest.approx(1 / 3, abs=1e-4) and found["approval_renewal_correlation"] == 1.0
