import datetime as dt
import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinsight.functions.gather import gather
from kinsight.operators import aggregates, corpus, decisions, privacy, profile, quality, search, semantic
from kinsight.session import run_folder
from kinsight.sources import tables
from kinsight.streaming import incremental
from scenarios import SETTINGS, Scenarios

DOCS = [(1, "Red fox, red dog."), (2, "blue dog"), (3, "123 ..."), (4, "the red, the blue and the rest"), (5, "fox fox fox!")]


def brute_bm25(query):
    docs = {k: re.findall(r"[^\W\d_]+", t.lower()) for k, t in DOCS}
    docs = {k: w for k, w in docs.items() if w}
    mean, out = sum(map(len, docs.values())) / len(docs), {}
    for term in dict.fromkeys(query.lower().split()):
        df = sum(term in w for w in docs.values())
        for k, w in docs.items():
            if term in w:
                tf = w.count(term)
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                out[k] = out.get(k, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


def test_bm25_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, content string")
    want = brute_bm25("red fox the")
    index = search.write_index(docs, run_folder(spark, "index"))
    for got in (search.search(index, "red fox the"), search.search_postings(index.postings, index.statistics, "red fox the")):
        rows = got.collect()
        assert [r.doc_id for r in rows] == sorted(want, key=lambda k: (-want[k], k))[:5]
        assert all(abs(float(r.score) - want[r.doc_id]) < 1e-6 for r in rows)


def test_vector_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])]
    out = search.search_vector(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), [1.0, 0.0]).collect()
    assert [r.doc_id for r in out] == [1, 2] and abs(float(out[1].score) - 0.6) < 1e-6


def test_gathering_is_whole_and_ordered(spark):
    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id")
    out = gather(rows, "k", F.floor(F.col("id") / 50), [F.col("id")], F.col("id"))
    items = out.filter("k = 1").first()["items"]
    assert len(items) == 3001 and items == sorted(items)
    assert out.select(F.sum(F.size("items"))).first()[0] == 9000 and out.count() == out.select("k").distinct().count()


def test_timeline_of_a_busy_customer_is_complete(spark):
    entries = spark.range(2500).selectExpr(
        "1L AS customer_id", "CAST(TIMESTAMP_NTZ '2024-01-20 00:00:00' + make_dt_interval(0, 0, id % 1200) AS TIMESTAMP_NTZ) AS interaction_date",
        "id AS interaction_id", "named_struct('interaction_id', id) AS detail")
    (row,) = profile.timeline(entries).collect()
    assert [d.interaction_id for d in row.details] == sorted(range(2500), key=lambda i: (-(i % 1200), i))


def test_policy_document_keeps_every_line(spark):
    s = Scenarios(spark)
    lines = spark.range(2500).selectExpr("concat('V', id) AS coverage_id", "'P1' AS policy_id", "'fire' AS coverage_type",
                                         "CAST(id % 50 * 100 AS DECIMAL(12,2)) AS limit_amount", "CAST(1 AS DECIMAL(12,2)) AS deductible_amount")
    docs = corpus.policy_summaries(s.table("policies"), s.table("customers"), lines)
    (mine,) = docs.filter("policy_id = 'P1'").collect()
    assert mine.content.count("  - Fire") == 2500


def test_search_opens_only_its_buckets_and_no_text(spark):
    docs = spark.createDataFrame([(i, f"w{i} common" + (" rare" if i == 7 else ""), i % 2) for i in range(50)], "doc_id long, content string, side int")
    index = search.write_index(docs, run_folder(spark, "index"), ("side",))
    found = search.search(index, "rare common", k=3)
    assert [r.doc_id for r in found.orderBy(F.desc("score"), "doc_id").collect()][0] == 7
    plan = search.scored(index, "rare common")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan or "PartitionFilters: [term_bucket" in plan
    assert "content" not in plan
    assert {r.side for r in search.search(index, "common", filters={"side": 1}).collect()} == {1}
    empty = search.write_index(docs.filter("false"), run_folder(spark, "index"), ("side",))
    assert search.search(empty, "rare").collect() == []


def test_fusion_counts_true_ranks(spark):
    """A document at text rank 45 and vector rank 101 counts with both ranks."""
    texts = spark.createDataFrame([(i, 1000.0 - i) for i in range(300)], "doc_id long, score double")
    order = [1000 + i for i in range(100)] + [44] + [2000 + i for i in range(300)]
    vectors = spark.createDataFrame([(d, [1.0, n / 100]) for n, d in enumerate(order)], "vec_id long, embedding array<double>")
    got = search.search_hybrid(texts.withColumn("score", F.col("score").cast(search.SCORE)), vectors, [1.0, 0.0], k=7)
    rank = {i: (i + 1, None) for i in range(300)}
    for n, d in enumerate(order):
        rank[d] = (rank.get(d, (None, None))[0], n + 1)
    score = {d: round(sum(1 / (60 + r) for r in both if r), 8) for d, both in rank.items()}
    want = sorted(score, key=lambda d: (-score[d], d))[:7]
    rows = got.collect()
    assert [r.doc_id for r in rows] == want and 44 in want
    assert [(r.text_rank, r.vector_rank) for r in rows] == [rank[d] for d in want]


def test_outcomes_of_a_customer_with_many_terms_and_follow_ups(spark):
    follow = spark.range(10_000).selectExpr("concat('F', id) AS follow_up_id", "1L AS customer_id", "CAST(date_add(DATE '1990-01-01', CAST(id * 2 AS INT)) AS TIMESTAMP_NTZ) AS created_at")
    terms = spark.range(10_000).selectExpr("1L AS customer_id", "date_add(DATE '1990-01-01', CAST(id * 2 AS INT)) AS effective_date", "'renewed' AS status")
    out = decisions.action_outcomes(follow, terms, F.lit(dt.date(2100, 1, 1)), 30)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.follow_up_id: r for r in out.collect()}
    assert len(rows) == 10_000
    assert all(rows[f"F{i}"].observed_date == dt.date(1990, 1, 1) + dt.timedelta(2 * i + 2) for i in range(0, 9_999, 500))
    assert rows["F9999"].outcome_type == "no_change"


def test_escalations_count_only_within_the_horizon(spark):
    follow = spark.createDataFrame([("a", 1, dt.datetime(2000, 1, 1)), ("b", 2, dt.datetime(2000, 1, 1))], "follow_up_id string, customer_id long, created_at timestamp_ntz")
    terms = spark.createDataFrame([], "customer_id long, effective_date date, status string")
    raised = spark.createDataFrame([(1, dt.date(2000, 1, 5)), (2, dt.date(2000, 3, 5)), (2, dt.date(2000, 1, 1))], "customer_id long, escalated_on date")
    out = decisions.action_outcomes(follow, terms, F.lit(dt.date(2001, 1, 1)), 30, raised).collect()
    assert {r.follow_up_id: r.outcome_type for r in out} == {"a": "escalated", "b": "no_change"}


def test_serving_table_reads_and_refreshes_single_buckets(spark):
    path = run_folder(spark, "serving")
    tables.write_serving(spark.range(1000).selectExpr("id AS k", "0 AS v"), path, "k", buckets=16)
    tables.refresh_serving(spark.createDataFrame([(5, 1), (2000, 1)], "k long, v int"), path, "k", buckets=16)
    got = tables.read_serving(spark, path, "k", [5, 6, 2000, 3000], buckets=16)
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.v) for r in got.collect()) == [(5, 1), (6, 0), (2000, 1)]
    assert spark.read.parquet(path).count() == 1001 and spark.read.parquet(path).filter("v = 1").count() == 2


def test_word_counts_of_awkward_texts(spark):
    texts = [(1, "b a b"), (2, ""), (3, None), (4, "12 !"), (5, "Ärger ärger x")]
    got = {r.doc_id: sorted((w.term, w.tf) for w in r.words or []) for r in search.word_counts(spark.createDataFrame(texts, "doc_id long, content string")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [], 4: [], 5: [("x", 1), ("ärger", 2)]}


def test_model_is_complete_and_resolves_terms():
    model = semantic.MODEL
    assert (len(model.facts), len(model.dimensions), len(model.metrics)) == (11, 47, 17)
    assert model.resolve("churn risk") == "risk_tier" and model.resolve("Book of Business") == "total_premium_sum"
    with pytest.raises(KeyError):
        model.resolve("shoe size")


def test_option_parsing(spark):
    rows = spark.createDataFrame([("Ann (x) Lee (C1)",), ("C2",)], "label string")
    assert [r[0] for r in rows.select(semantic.parse_option(F.col("label"))).collect()] == ["C1", "C2"]


def test_masking_and_access(spark):
    row = privacy.mask_for_role(Scenarios(spark).table("customers"), "auditor").filter("customer_id = 'C4'").first()
    assert (row.first_name, row.email, row.phone, row.date_of_birth) == ("A.", "c***@***.com", None, None)
    with pytest.raises(PermissionError):
        privacy.project_for_role(spark.range(1), "service_app", "raw")
    bad = privacy.policy_violations(spark, {"raw": ("raw", ["a"]), "dim": ("analytics", ["b", "_row_hash"])}, "auditor")
    assert {(r.table_name, r.column_name) for r in bad.collect()} == {("raw", "a"), ("dim", "_row_hash")}


def test_quality_checks_find_planted_errors(spark):
    s = Scenarios(spark)
    tables = {n: s.table(n) for n in ("customers", "policies", "payments", "interactions", "transcripts")}
    tables["policies"] = tables["policies"].withColumn("status", F.when(F.col("policy_id") == "P1", "odd").otherwise(F.col("status")))
    found = {r.column_name: r.violations for r in quality.enums(tables).collect()}
    assert found["policies.status"] == 1 and found["customers.status"] == 0
    stamped = tables["customers"].selectExpr("*", "CAST(NULL AS STRING) AS _row_hash", "'b' AS _batch_id",
                                             "'f' AS _source_file", "current_date() AS _loaded_at")
    assert quality.audit_columns({"customers": stamped}).first().null_rows == 12
    checked = quality.quarantine(tables["payments"], tables["customers"].filter("customer_id != 'C8'"), tables["policies"])
    assert checked.filter("_quarantined").select("customer_id").distinct().collect()[0][0] == "C8"
    assert quality.forbidden_columns(spark.range(1).withColumn("Risk_Score", F.lit(1))) == {"risk_score"}


def test_stream_maintenance_equals_rebuild(spark, tmp_path):
    contacts = Scenarios(spark).table("interactions")
    inbox, seen = str(tmp_path / "in"), []
    sinks = {
        "fold": incremental.fold_sink(spark, str(tmp_path / "fold")),
        "recompute": incremental.recompute_sink(spark, lambda: spark.read.parquet(inbox), str(tmp_path / "recompute"),
                                                refresh=lambda t: seen.append(t.count())),
    }
    want = sorted(map(tuple, aggregates.agg_customer_interaction(contacts).collect()))
    for rows in (contacts.filter("channel = 'phone' AND interaction_id < 'I4'"), contacts.filter("interaction_id >= 'I4'")):
        rows.write.mode("append").parquet(inbox)
        for name, sink in sinks.items():
            query = incremental.run_available(
                incremental.change_stream(spark, inbox, contacts.schema), str(tmp_path / f"cp-{name}"), sink)
    from kinsight.sources.tables import latest_snapshot

    for name in sinks:
        assert sorted(map(tuple, latest_snapshot(spark, str(tmp_path / name)).collect())) == want
    # a replayed batch replaces its own version and changes nothing
    sinks["fold"](spark.read.parquet(inbox).filter("interaction_id >= 'I4'"), 1)
    assert sorted(map(tuple, latest_snapshot(spark, str(tmp_path / "fold")).collect())) == want
    assert seen and incremental.latency_record(query, datetime.now())["rows"] > 0


def test_clock_is_explicit(spark):
    assert "current_timestamp" not in Scenarios(spark).table("interactions")._jdf.queryExecution().toString()
    assert SETTINGS.clock.window_days == 90


def test_postings_are_not_shuffled(spark):
    docs = spark.range(90).selectExpr("id AS doc_id", "concat('alpha beta ', id % 7) AS content").repartition(3)
    folder = run_folder(spark, "index")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    index = search.write_index(docs, folder)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == before
    files = index.postings.filter("term = 'alpha'").select("_metadata.file_path").distinct()
    assert files.count() == spark.read.parquet(f"{folder}/words").rdd.getNumPartitions() > 1
    assert index.postings.count() == 180 and search.scored(index, "alpha").count() == 90


def test_scores_are_computed_once_whatever_the_candidates(spark):
    vectors = spark.range(40).selectExpr("id AS vec_id", "array(cast(id AS float), cast(1 AS float)) AS embedding")
    scored = search.scored_vectors(vectors, [1.0, 0.5])
    ranks = search._true_ranks(scored, scored.select("doc_id").limit(5), "rank")
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    compared = re.findall(r"lambdafunction\(\(lambda \S+ < (.{0,12})", plan)
    assert compared and all(right.startswith("lambda ") for right in compared)
