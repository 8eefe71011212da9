"""Windows from day tiles equal the windows over all contacts."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinsight.config import Clock
from kinsight.operators import profile, risk
from kinsight.operators.tiles import DayTiles


@pytest.fixture(scope="module")
def contacts(spark):
    # forty days, customers of many and few contacts, some without a time
    when = "IF(id % 53 = 0, NULL, CAST(timestamp_seconds(1700000000 + (id * 7919) % 3456000) AS TIMESTAMP_NTZ))"
    return spark.range(6000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('c', id % 211)) AS customer_id", "CAST(id AS STRING) AS interaction_id", f"{when} AS interaction_date",
        "IF(id % 4 = 0, NULL, CAST(id AS STRING)) AS transcript_id",
        "CASE id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'consent_withheld' ELSE 'completed' END AS enrichment_status",
        "CASE id % 7 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN NULL ELSE 'neutral' END AS sentiment_label",
        "CAST(IF(id % 11 = 0, NULL, (id % 2001 - 1000) / 1000) AS DECIMAL(5,4)) AS sentiment_score",
        "id % 6 = 0 AS is_complaint", "IF(id % 13 = 0, NULL, id % 10 = 0) AS is_escalation").cache()


@pytest.fixture(scope="module")
def store(spark, contacts, tmp_path_factory):
    tiles = DayTiles(spark, str(tmp_path_factory.mktemp("tiles")))
    # two batches with contacts of the same days, one of them repeated
    tiles.add(contacts.filter("interaction_id % 2 = 0"), 0)
    tiles.add(contacts.filter("interaction_id % 2 = 1"), 1)
    tiles.add(contacts.filter("interaction_id % 2 = 1"), 1)
    return tiles


def rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect()))


CLOCKS = [Clock(date(2023, 12, 20), now, days) for now, days in (
    (datetime(2023, 12, 20, 12, 34, 56), 10), (datetime(2023, 12, 10), 7), (datetime(2023, 11, 30, 23, 59, 59, 999999), 3), (datetime(2030, 1, 1), 5))]


@pytest.mark.parametrize("clock", CLOCKS, ids=lambda c: f"{c.now:%m%d}")
def test_windows_of_any_clock(contacts, store, clock):
    assert rows(store.engagement_windows(clock)) == rows(profile.engagement_windows(contacts, clock))
    assert rows(store.sentiment_windows(clock)) == rows(risk.sentiment_windows(contacts, clock))
    assert rows(store.interaction_frequency(clock)) == rows(risk.interaction_frequency(contacts, clock))
    want = contacts.filter(F.col("interaction_date") >= F.lit(clock.now.isoformat()).cast("timestamp_ntz")).groupBy("customer_id").agg(F.count("*").alias("n"))
    assert rows(store.contacts_since(clock.now, "n")) == rows(want)


def test_only_the_days_of_the_edges_are_read_by_contact(store):
    edges = store.contacts_of(datetime(2023, 12, 5, 3), datetime(2023, 11, 25, 9))
    opened = {Path(r[0]).parent.name for r in edges.select("_metadata.file_path").distinct().collect()}
    assert opened == {"day=2023-12-05", "day=2023-11-25"}
    assert len(list(Path(store.root, "contacts", "batch=0").glob("day=*"))) > 30
