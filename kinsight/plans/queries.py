"""Registered queries over the test tables: name -> callable(spark, sf_dir) -> DataFrame.

Each one runs an operator over whole tables. ``present`` shapes the result for
comparison: decimals as doubles, integers as bigint, timestamps and nested
values as text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsight.config import Clock
from kinsight.functions.hashing import row_hash, table_checksum, with_missing_hashes
from kinsight.operators import (
    aggregates, corpus, curated, decisions, enrichment, erasure, nba, privacy, profile, quality, risk, search, semantic, suite,
)
from kinsight.plans.pipeline import Build
from kinsight.schemas import SCHEMAS
from kinsight.session import run_folder
from kinsight.operators.tiles import DayTiles
from kinsight.operators.vectors import VectorIndex
from kinsight.sources import landing, loads, tables
from kinsight.sources.buckets import Buckets, KeyedLog
from kinsight.sources.checksums import HashedTable, changes
from kinsight.sources.loads import LandedTable
from kinsight.sources.testbed import CLOCK, RULES, SETTINGS, Testbed
from kinsight.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EARLIER = Clock(today=date(2000, 8, 1), now=CLOCK.now, window_days=CLOCK.window_days)
LOADED_AT = datetime(2024, 2, 1, 6, 0, 0)
BATCH = "BATCH-2024-02-01"
# contacts up to here count as the stored past of the incremental queries
CUTOFF = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
SEARCH_TEXT = "thble erin thor and"
SEARCH_VECTOR = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]


def present(df: DataFrame) -> DataFrame:
    def shape(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        return c.alias(f.name)

    return df.select(*[shape(f) for f in df.schema.fields])


def query(name: str):
    def register(fn: Callable[[Build], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Build(Testbed(spark, sf_dir), SETTINGS)))

        run.__name__ = name
        QUERIES[name] = run
        return fn

    return register


def simple(**entries: Callable[[Build], DataFrame]) -> None:
    for name, fn in entries.items():
        query(name)(fn)


def stored(b: Build) -> Build:
    """The same build with its shared products written once to the shared folder."""
    return Build(b.tables, b.settings, workspace=run_folder(b.tables.spark, "build"))


# --- 2.1 sources, load, merge ------------------------------------------------------------------------------------


def as_declared(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


@query("load_csv_roundtrip")
def load_csv_roundtrip(b: Build) -> DataFrame:
    folder = run_folder(b.tables.spark, "csv")
    landing.write_csv(as_declared(b.customers, "customers"), folder)
    return landing.read_strict(b.tables.spark, folder, SCHEMAS["customers"])


def damaged_interactions(b: Build) -> DataFrame:
    """Contacts as CSV lines in which complaints lost their tail and very long calls carry a bad duration."""
    i = b.interactions
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("interaction_id", "customer_id", "channel",
                                                                     "direction", "disposition")]
    moment = F.date_format("interaction_date", "yyyy-MM-dd'T'HH:mm:ss")
    long_call = F.col("duration_seconds") > 300
    duration = F.when(long_call, "n/a").otherwise(F.coalesce(F.col("duration_seconds").cast("string"), F.lit("")))
    line = F.when(F.col("disposition") == "complaint", F.concat_ws(",", *text)).otherwise(
        F.concat_ws(",", *text, moment, duration, F.coalesce(F.col("representative_id").cast("string"), F.lit(""))))
    folder = run_folder(b.tables.spark, "damaged")
    i.select(line.alias("value")).write.text(f"{folder}/lines")
    return landing.land_lenient(
        b.tables.spark, f"{folder}/lines", SCHEMAS["interactions"], f"{folder}/landed", multi_line=False, header=False)


@query("manifest_rows")
def manifest_rows(b: Build) -> DataFrame:
    """Rows of every logical table, counted from the bytes of its CSV files while they are hashed."""
    folder = run_folder(b.tables.spark, "manifest")
    for name in ALL_TABLES:
        landing.write_csv(as_declared(b.tables.table(name), name), f"{folder}/csv/table_name={name}")
    found = landing.block_manifest(b.tables.spark, f"{folder}/csv", f"{folder}/manifest", block_bytes=1 << 20)
    return found.groupBy(F.regexp_extract("path", "/table_name=([^/]+)/", 1).alias("table_name")).agg(
        F.sum("rows").alias("rows"), (F.min(F.length("sha256")) == 64).alias("hashed"))


@query("load_rejects")
def load_rejects(b: Build) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull()
    key = F.when(bad, F.split_part("_corrupt_record", F.lit(","), F.lit(1))).otherwise(F.col("interaction_id"))
    return damaged_interactions(b).select(F.when(bad, "rejected").otherwise("loaded").alias("outcome"),
                                          key.cast("bigint").alias("k"), "channel").groupBy("outcome").agg(
        F.count("*").alias("row_count"), F.sum("k").alias("id_sum"))


@query("raw_audit_stamp")
def raw_audit_stamp(b: Build) -> DataFrame:
    stamped = landing.stamp_audit(b.tables.raw("customer"), BATCH, LOADED_AT, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return stamped.select("c_custkey", "_loaded_at", "_source_file", "_batch_id", "_row_hash")


def hashed(df: DataFrame) -> DataFrame:
    columns = df.columns
    return with_missing_hashes(df.withColumn("_row_hash", F.lit(None).cast("string")), columns)


def landed(b: Build, name: str) -> DataFrame:
    """Logical table with its audit columns, as after a load."""
    return hashed(b.tables.table(name)).withColumn("_batch_id", F.lit(BATCH)).withColumn(
        "_loaded_at", F.lit(LOADED_AT.isoformat()).cast("timestamp_ntz")).withColumn(
        "_source_file", F.lit(f"{name}.csv"))


@query("row_hash")
def row_hash_query(b: Build) -> DataFrame:
    """Row hashes of all landed tables, by table and primary key."""
    return quality.union([
        hashed(b.tables.table(name)).select(
            F.lit(name).alias("table_name"), F.col(quality.PRIMARY_KEYS[name]).cast("string").alias("key"), "_row_hash")
        for name in ALL_TABLES
    ])


ALL_TABLES = ("customers", "policies", "coverages", "claims", "payments", "interactions", "transcripts",
              "service_representatives")


def source_counts(b: Build) -> DataFrame:
    """(table_name, expected_rows): the rows of the files behind each logical table, counted there, each file once."""
    whole = {"customers": "customer", "policies": "orders", "interactions": "events", "transcripts": "documents",
             "service_representatives": "supplier"}
    counted = [
        b.tables.raw(raw).agg(F.count("*").alias("expected_rows")).select(F.lit(name).alias("table_name"), "expected_rows")
        for name, raw in whole.items()
    ]
    lines = {"coverages": "true", "claims": "l_returnflag IN ('R', 'A')", "payments": "l_returnflag = 'N'"}
    each = [F.struct(F.lit(name).alias("table_name"), F.count_if(F.expr(kept)).alias("expected_rows")) for name, kept in lines.items()]
    split = b.tables.raw("lineitem").agg(F.array(*each).alias("each")).select(F.explode("each").alias("e")).select("e.*")
    return quality.union([*counted, split])


def loaded(b: Build) -> DataFrame:
    """The figures of a full load of all landed tables, one row a table."""
    folder = run_folder(b.tables.spark, "landed")
    for name in ALL_TABLES:
        LandedTable(b.tables.spark, f"{folder}/{name}").load(landed(b, name), 1, full=True)
    return quality.union([LandedTable(b.tables.spark, f"{folder}/{name}").figures(name) for name in ALL_TABLES])


simple(
    load_figures=lambda b: loaded(b).select("table_name", "rows", "null_hashes", "min_hash_length", "audit_nulls", "rejected", "loads"),
)


@query("full_reload")
def full_reload(b: Build) -> DataFrame:
    """A full load, one more batch, then a full load that is repeated: its rows stand once."""
    table = LandedTable(b.tables.spark, run_folder(b.tables.spark, "reload"))
    rows = landed(b, "customers")
    table.load(rows.filter("status = 'active'"), 1, full=True)
    table.load(rows.filter("status <> 'active'"), 2)
    for _ in range(2):
        table.load(rows, 3, full=True)
    return table.read().select("customer_id", "status", "_batch_id", "_source_file")


@query("load_check")
def load_check(b: Build) -> DataFrame:
    return loads.check(loaded(b), source_counts(b))


def now_literal():
    return F.lit(LOADED_AT.isoformat()).cast("timestamp_ntz")


@query("upsert_merge")
def upsert_merge(b: Build) -> DataFrame:
    columns = ["customer_id", "household_id", "last_name", "state", "status"]
    first = F.expr("TIMESTAMP_NTZ '2023-01-01 00:00:00'")
    target = b.customers.filter(F.col("status") == "active").select(*columns).withColumn("_loaded_at", first) \
        .withColumn("_processed_at", first)
    moved = b.customers.filter(F.col("state") != "BUILDING").select(*columns).withColumn(
        "state", F.concat(F.lit("NEW "), F.col("state")))
    return tables.upsert(target, moved, ["customer_id"], now_literal())


def past(df: DataFrame, moment: str = "interaction_date") -> DataFrame:
    return df.filter(F.col(moment) < F.expr(CUTOFF))


def later(df: DataFrame, moment: str = "interaction_date") -> DataFrame:
    return df.filter(F.col(moment) >= F.expr(CUTOFF))


@query("insert_only_merge")
def insert_only_merge(b: Build) -> DataFrame:
    return tables.insert_only(past(b.interactions), b.interactions, "interaction_id").select(
        "interaction_id", "customer_id", "channel")


@query("surrogate_key")
def surrogate_key(b: Build) -> DataFrame:
    active = b.customers.filter(F.col("status") == "active").select("customer_id")
    existing = tables.dense_keys(active, "customer_id", "customer_sk")
    return tables.next_keys(existing, b.customers.select("customer_id"), "customer_id", "customer_sk")


def policy_documents(b: Build) -> DataFrame:
    return corpus.policy_summaries(b.policies, b.customers, b.coverages)


def transcript_documents(b: Build) -> DataFrame:
    return corpus.transcript_documents(b.transcripts, b.interactions, b.customers)


def email_documents(b: Build) -> DataFrame:
    return corpus.email_documents(b.interactions, b.transcripts, b.customers)


simple(
    docs_policy_summary=policy_documents,
    docs_transcript=transcript_documents,
    docs_email=email_documents,
    docs_corpus_counts=lambda b: corpus.corpus_counts(
        corpus.corpus(policy_documents(b), email_documents(b), transcript_documents(b))),
)


# --- 2.2 curated -------------------------------------------------------------------------------------------------


def policy_versions(b: Build) -> tuple[DataFrame, DataFrame]:
    """Policies as known a year earlier, and now (quotes from before 1996 have been purged)."""
    earlier = Testbed(b.tables.spark, b.tables.sf_dir, EARLIER).policies().filter(
        F.col("effective_date") <= EARLIER.today_col())
    stale_quote = (F.col("status") == "quoted") & (F.col("effective_date") < F.lit(date(1996, 1, 1)))
    columns = ["policy_id", "customer_id", "product_type", "status", "premium_amount"]
    return tuple(
        df.select(*columns).withColumn("_row_hash", row_hash(df, columns))
        for df in (earlier, b.policies.filter(~stale_quote))
    )


#: Snapshots of customers: date, and the rows and status that it has.
CUSTOMER_SNAPSHOTS = {
    date(2000, 1, 1): ("customer_id % 5 <> 0", "'active'"),
    date(2000, 6, 1): ("customer_id % 7 <> 0", "status"),
    date(2001, 8, 1): ("true", "status"),
}


@query("scd2_customer")
def scd2_customer(b: Build) -> DataFrame:
    """History of customers; the snapshot in the middle arrives last."""
    first, middle, last = CUSTOMER_SNAPSHOTS
    history, known = None, []
    for day in (first, last, middle):
        kept, status = CUSTOMER_SNAPSHOTS[day]
        rows = b.customers.filter(kept).select("customer_id", "household_id", F.expr(status).alias("status"))
        rows = rows.withColumn("_row_hash", row_hash(rows, ["customer_id", "household_id", "status"]))
        if history is None:
            history = rows.limit(0).selectExpr("*", "CAST(NULL AS DATE) AS valid_from", "CAST(NULL AS DATE) AS valid_to", "true AS is_current")
        history = curated.scd2_insert(history, rows, "customer_id", day, known)
        known.append(day)
    return history.select("customer_id", "status", "valid_from", "valid_to", "is_current")


@query("change_feed_pruned")
def change_feed_pruned(b: Build) -> DataFrame:
    """The changes between two stored versions, from the buckets whose checksums differ."""
    folder, stored_versions = run_folder(b.tables.spark, "hashed"), []
    for name, rows in zip(("old", "new"), policy_versions(b), strict=True):
        table = HashedTable(b.tables.spark, f"{folder}/{name}", "policy_id", leaves=64)
        table.write(rows)
        stored_versions.append(table)
    return changes(*stored_versions)


@query("scd2_policy")
def scd2_policy(b: Build) -> DataFrame:
    old, new = policy_versions(b)
    history = old.withColumn("valid_from", EARLIER.today_col()).withColumn(
        "valid_to", F.lit(None).cast("date")).withColumn("is_current", F.lit(True))
    return curated.scd2_apply(history, new, "policy_id", CLOCK.today_col()).select(
        "policy_id", "status", "valid_from", "valid_to", "is_current")


#: Curated table: landed source, builder, business key, surrogate key.
CURATED = {
    "dim_household": ("customers", curated.dim_household, "household_id", "household_sk"),
    "dim_customer": ("customers", curated.dim_customer, "customer_id", "customer_sk"),
    "dim_product": ("policies", curated.dim_product, "product_type", "product_sk"),
    "dim_policy": ("policies", curated.dim_policy, "policy_id", "policy_sk"),
    "dim_coverage": ("coverages", curated.dim_coverage, "coverage_id", "coverage_sk"),
    "dim_channel": ("interactions", curated.dim_channel, "channel_code", "channel_sk"),
    "dim_service_rep": ("service_representatives", curated.dim_service_representative, "representative_id", "service_rep_sk"),
    "fact_claim": ("claims", curated.fact_claim, "claim_id", "claim_sk"),
    "fact_payment": ("payments", curated.fact_payment, "payment_id", "payment_sk"),
    "fact_interaction": ("interactions", curated.fact_interaction, "interaction_id", "interaction_sk"),
    "transcript_content": ("transcripts", curated.transcript_content, "transcript_id", "transcript_sk"),
}


def curated_load(b: Build, name: str) -> DataFrame:
    """A curated table after two loads of its landed source: the second keeps keys and load times and renews
    ``_processed_at``."""
    source, build, key, surrogate = CURATED[name]
    rows = tables.one_per_key(tables.hash_keys(build(landed(b, source)), key, surrogate), key, "_source_hash")
    first = F.expr("TIMESTAMP_NTZ '2023-01-01 00:00:00'")
    return tables.upsert(rows.withColumn("_loaded_at", first).withColumn("_processed_at", first), rows, [key], now_literal())


for _name in CURATED:
    query(_name)(lambda b, n=_name: curated_load(b, n))


@query("fact_measures")
def fact_measures(b: Build) -> DataFrame:
    opened = curated.claim_days_open(b.claims, CLOCK.today_col()).select(
        F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), "status", F.col("days_open").alias("days"))
    late = curated.payment_days_late(b.payments).select(
        F.lit("payment").alias("kind"), F.col("payment_id").alias("id"), "status", F.col("days_late").alias("days"))
    return opened.unionByName(late)


simple(
    dim_date=lambda b: curated.dim_date(b.customers, b.policies, b.claims, b.payments, b.interactions),
    change_feed=lambda b: curated.change_feed(*policy_versions(b), "policy_id"),
)

# --- 2.3 / 2.4 aggregates and profile ------------------------------------------------------------------------------

simple(
    agg_customer_policy=lambda b: b.agg_policy,
    agg_customer_claim=lambda b: b.agg_claim,
    agg_customer_payment=lambda b: b.agg_payment,
    agg_customer_interaction=lambda b: b.agg_interaction,
    household_policies=lambda b: aggregates.household_policies(b.customers, b.policies),
    trailing_12m_summary=lambda b: aggregates.trailing_12m(
        b.customers, b.payments, b.claims, b.interactions, CLOCK.today_col(), CLOCK.now_col()),
    customer_360_base=lambda b: b.base,
    sentiment_summary=lambda b: profile.sentiment_summary(b.windows),
    interaction_timeline_array=lambda b: b.timeline,
    customer_360_enriched=lambda b: stored(b).profile_with_timeline,
    customer_360_with_timeline=lambda b: stored(b).profile_with_timeline.select(
        "customer_id", "recent_interaction_details", "system_status"),
    status_distribution=lambda b: profile.status_distribution(b.profile),
    risk_action_matrix=lambda b: profile.risk_action_matrix(b.profile),
    coverage_kpis=lambda b: profile.coverage_kpis(b.profile),
)

# --- 2.5 enrichment ------------------------------------------------------------------------------------------------


def written(b: Build, name: str, frame: DataFrame) -> DataFrame:
    """The frame, stored once in the shared folder."""
    folder = run_folder(b.tables.spark, name)
    frame.write.parquet(folder)
    return b.tables.spark.read.parquet(folder)


def scored_texts(b: Build) -> DataFrame:
    return enrichment.score_transcripts(b.transcripts, RULES)


def re_enriched(b: Build) -> DataFrame:
    """Enrich the past, then deliver everything twice: the row set must be the full one, once."""
    folder = run_folder(b.tables.spark, "enriched")
    first = enrichment.enrich(past(b.interactions), b.transcripts, RULES)
    first.write.parquet(f"{folder}/run=1")
    existing = b.tables.spark.read.parquet(f"{folder}/run=1")
    delivered = b.interactions.unionByName(past(b.interactions))
    fresh = enrichment.enrich_new(existing, delivered, b.transcripts, RULES)
    return existing.unionByName(fresh).select("interaction_id", "enrichment_status", "sentiment_score", "urgency_level")


simple(
    enrich_eligibility=lambda b: enrichment.enrichment_eligibility(b.interactions, b.transcripts),
    sentiment_score=lambda b: enrichment.validated(scored_texts(b)).select(
        "transcript_id", "sentiment_score", "sentiment_label"),
    extract_json=lambda b: scored_texts(b).select("transcript_id", "extraction_raw"),
    validate_extraction=lambda b: enrichment.validated(scored_texts(b)).select(
        "transcript_id", "summary", "primary_topic", "primary_intent", "extracted_urgency", "json_ok"),
    urgency=lambda b: b.enriched.select("interaction_id", "disposition", "urgency_level"),
    complaint_escalation_flags=lambda b: b.enriched.select("interaction_id", "is_complaint", "is_escalation"),
    enrichment_status=lambda b: b.enriched.select(
        "interaction_id", "enrichment_status", "enrichment_model", "enrichment_error"),
    interactions_enriched=lambda b: b.enriched,
    enrichment_reports_status=lambda b: enrichment.report_status(b.enriched),
    enrichment_reports_sentiment=lambda b: enrichment.report_sentiment(b.enriched),
    enrichment_reports_topic_intent=lambda b: enrichment.report_topic_intent(b.enriched),
    enrichment_reports_urgency=lambda b: enrichment.report_urgency(b.enriched),
    enrichment_reports_most_negative=lambda b: enrichment.report_most_negative(b.enriched),
    key_phrases=lambda b: enrichment.key_phrases(written(b, "words", enrichment.transcript_words(b.transcripts, RULES))),
    enrichment_failure_rate=lambda b: enrichment.failure_rate(b.enriched),
    enrich_idempotent=re_enriched,
)

# --- 2.6 risk ------------------------------------------------------------------------------------------------------

for _key, _signal in (
    ("signal_renewal", "renewal_proximity"), ("signal_sentiment_negative", "sentiment_negative"),
    ("signal_sentiment_trend", "sentiment_trend"), ("signal_payment", "payment_risk"),
    ("signal_complaint", "complaint_activity"), ("signal_claim", "claim_activity"),
    ("signal_engagement", "engagement_drop"), ("signal_cross_sell", "cross_sell_opportunity"),
):
    query(_key)(lambda b, s=_signal: risk.one_signal(b.wide, s))

def day_tiles(b: Build) -> DayTiles:
    """Contacts and tiles in two deliveries."""
    tiles, enriched = DayTiles(b.tables.spark, run_folder(b.tables.spark, "tiles")), stored(b).enriched
    tiles.add(past(enriched), 0)
    tiles.add(later(enriched), 1)
    return tiles


simple(
    risk_sentiment_windows=lambda b: risk.sentiment_windows(b.enriched, CLOCK),
    interaction_frequency=lambda b: risk.interaction_frequency(b.interactions, CLOCK),
    tiled_sentiment_summary=lambda b: profile.sentiment_summary(day_tiles(b).engagement_windows(CLOCK)),
    tiled_risk_windows=lambda b: day_tiles(b).sentiment_windows(CLOCK),
    tiled_interaction_frequency=lambda b: day_tiles(b).interaction_frequency(CLOCK),
    product_gaps=lambda b: risk.product_gaps(b.agg_policy),
    risk_wide=lambda b: b.wide,
    risk_signals=lambda b: b.signals,
    risk_summary=lambda b: b.summary,
    risk_summary_from_signals=lambda b: risk.summarise_signals(b.signals),
    risk_distribution=lambda b: risk.risk_distribution(b.summary),
    risk_signals_configured=lambda b: risk.risk_signals_configured(b.scored, nba.weight_frame(b.tables.spark)),
    signal_weights=lambda b: risk.signal_contributions(b.signals, nba.weight_frame(b.tables.spark)),
    scenario_labels=lambda b: risk.scenario_labels(b.wide),
)

# --- 2.7 next best action ------------------------------------------------------------------------------------------

CANDIDATE_KEYS = ("customer_id", "action_id", "action_type")

simple(
    nba_evidence=lambda b: nba.evidence_rows(b.context),
    enrichment_coverage=lambda b: nba.enrichment_coverage(b.enriched),
    nba_candidates=lambda b: nba.candidates(b.context).select(
        *CANDIDATE_KEYS, "risk_tier", "composite_risk_score", "product_holdings", "active_policies",
        "enrichment_coverage_pct", "enriched_count", "priority_rank", "safety_score"),
    nba_eligibility=lambda b: nba.candidates(b.context).select(
        *CANDIDATE_KEYS, "product_eligible", "not_excluded", "risk_tier_eligible", "signal_eligible"),
    nba_scores=lambda b: nba.candidates(b.context).select(*CANDIDATE_KEYS, "relevance_score", "final_score"),
    nba_ranked=lambda b: nba.rank_candidates(nba.candidates(b.context)).select(
        "customer_id", "action_rank", "action_type", "final_score"),
    nba_confidence=lambda b: b.primary.select("customer_id", "confidence_level", "confidence_score"),
    nba_explain=lambda b: b.recommendations.select(
        "customer_id", "action_rank", "data_completeness", "eligibility_check"),
    nba_recommendations=lambda b: b.recommendations,
    nba_primary=lambda b: b.primary.select(
        "customer_id", "action_rank", "action_id", "action_type", "action_name", "final_score", "risk_tier"),
    nba_alternatives=lambda b: nba.alternatives(b.recommendations).select(
        "customer_id", "action_rank", "action_id", "action_type", "final_score"),
    nba_distribution=lambda b: nba.action_distribution(b.primary),
    nba_confidence_distribution=lambda b: nba.confidence_distribution(b.primary),
    action_catalog=lambda b: nba.catalogue_listing(nba.action_frame(b.tables.spark), b.recommendations),
    nba_rule_exclusions=lambda b: nba.rule_exclusions(
        b.recommendations, nba.exclusion_frame(b.tables.spark)).select("customer_id", "action_rank", "action_type"),
    nba_withheld=lambda b: nba.recommend(b.context, withhold_low_confidence=True).select(
        "customer_id", "action_rank", "action_type", "confidence_level"),
    evidence_lineage=lambda b: nba.evidence_lineage(
        b.enriched, b.payments, b.claims, b.policies, b.agg_policy, CLOCK),
)

# --- 2.8 decisions -------------------------------------------------------------------------------------------------


def rep_decisions(b: Build) -> DataFrame:
    """Two sessions per customer, thirty days apart; what the representative did follows from the ids."""
    key, session = F.col("customer_id"), F.col("session")
    day = F.date_add(F.lit(date(2000, 1, 1)), ((key * 3) % 300).cast("int") + session.cast("int") * 30)
    turn = (key + session) % 5
    decision = F.when(turn == 1, "modified").when(turn == 2, "rejected").when(turn == 3, "timeout").otherwise("approved")
    sessions = b.customers.select("customer_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("session"))
    return sessions.select(
        "customer_id", day.cast("timestamp_ntz").alias("presented_at"),
        (day.cast("timestamp_ntz") + F.expr("INTERVAL 5 MINUTES")).alias("decided_at"),
        decision.alias("decision"),
        F.when(decision == "modified", F.concat(F.lit("custom plan "), key.cast("string"))).alias("action_text"),
        F.when(decision == "modified", "adjusted terms").when(decision == "rejected", "not suitable").otherwise("")
        .alias("notes"),
        F.concat(F.lit("rep-"), (key % 10).cast("string")).alias("representative_id"),
        F.concat(F.lit("s-"), session.cast("string")).alias("session_id"),
    )


class Decisions:
    """Decision products of one build. The logs are append-only tables: each session adds its own rows."""

    def __init__(self, b: Build):
        self.b, self.made = stored(b), rep_decisions(b)

    def _stored(self, name: str, frame: DataFrame) -> DataFrame:
        return self.b._kept(f"decision_{name}", frame)

    def _appended(self, name: str, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
        path = f"{self.b.workspace}/decision_{name}"
        for session in ("s-0", "s-1"):
            tables.append_log(rows(self.made.filter(F.col("session_id") == session)), path, session)
        return tables.read_log(self.b.tables.spark, path)

    @cached_property
    def primary(self) -> DataFrame:
        """Ranked once for all sessions."""
        return self._stored("primary", self.b.primary)

    @cached_property
    def log(self) -> DataFrame:
        return self._appended("log", lambda made: decisions.recommendation_log(made, self.primary))

    @cached_property
    def events(self) -> DataFrame:
        return self._appended("events", lambda made: decisions.decision_events(made, self.log))

    @cached_property
    def follow_ups(self) -> DataFrame:
        return self._appended("follow_ups", lambda made: decisions.follow_ups(made, self.log))

    @cached_property
    def outcomes(self) -> DataFrame:
        return self._stored("outcomes", decisions.action_outcomes(
            self.follow_ups, self.b.policies, CLOCK.today_col(), 180))

    @cached_property
    def snapshots(self) -> DataFrame:
        return decisions.context_snapshot(
            self.log, self.b.base, ["customer_id", "household_id", "total_policies", "product_holdings", "open_claims",
                                    "payments_late", "total_interactions"])


@query("decision_history")
def decision_history(b: Build) -> DataFrame:
    d = Decisions(b)
    return decisions.decision_history(d.log, d.snapshots, d.follow_ups, d.outcomes, d.events)


@query("outcome_rates")
def outcome_rates(b: Build) -> DataFrame:
    d = Decisions(b)
    return decisions.outcome_rates(d.outcomes, d.follow_ups, d.log, d.b.signals)


@query("decision_integrity")
def decision_integrity(b: Build) -> DataFrame:
    d = Decisions(b)
    # an incomplete extract of the log, so that orphans exist
    known = d.log.filter(F.col("risk_tier") != "medium")
    return decisions.decision_integrity(known, d.events, d.follow_ups, d.outcomes)


@query("programme_metrics")
def programme_metrics(b: Build) -> DataFrame:
    d = Decisions(b)
    return decisions.programme_metrics(d.log, d.events, d.follow_ups, d.outcomes, b.interactions, b.policies)


simple(
    recommendation_log=lambda b: Decisions(b).log.drop("recommendation_payload"),
    decision_events=lambda b: Decisions(b).events,
    follow_ups=lambda b: Decisions(b).follow_ups,
    latest_recommendation=lambda b: decisions.latest_recommendation(Decisions(b).log),
    context_snapshot=lambda b: Decisions(b).snapshots,
    action_outcomes=lambda b: Decisions(b).outcomes,
    evidence_rate=lambda b: decisions.evidence_rate(b.recommendations),
)

# --- 2.9 quality ---------------------------------------------------------------------------------------------------

def logical(b: Build, *names: str) -> dict[str, DataFrame]:
    return {n: b.tables.table(n) for n in (names or ALL_TABLES)}


@query("dq_row_counts")
def dq_row_counts(b: Build) -> DataFrame:
    """What the load counted, against the size of the files it came from: no table is scanned again."""
    return quality.counted(loaded(b).select("table_name", F.col("rows").alias("actual_rows")), source_counts(b))


@query("dq_batch")
def dq_batch(b: Build) -> DataFrame:
    daily = b.interactions.withColumn("_batch_id", F.date_format("interaction_date", "yyyyMMdd"))
    return quality.batch_consistency({**{n: landed(b, n) for n in ALL_TABLES}, "interactions": daily})


@query("dq_rejects")
def dq_rejects(b: Build) -> DataFrame:
    folder = run_folder(b.tables.spark, "clean")
    landing.write_csv(as_declared(b.customers, "customers"), f"{folder}/csv")
    clean = landing.land_lenient(b.tables.spark, f"{folder}/csv", SCHEMAS["customers"], f"{folder}/landed")
    return quality.rejects({"customers": clean, "interactions": damaged_interactions(b)})


@query("table_checksum")
def checksum(b: Build) -> DataFrame:
    """Two builds of the same table, laid out differently, must have one checksum."""
    columns = ["policy_id", "customer_id", "product_type", "status", "premium_amount"]
    first = table_checksum(b.policies, columns).withColumn("build", F.lit("first"))
    again = table_checksum(b.policies.repartition("product_type"), columns).withColumn("build", F.lit("again"))
    return first.unionByName(again)


@query("pipeline_suite")
def pipeline_suite(b: Build) -> DataFrame:
    s = stored(b)
    # the customers that the acceptance scenarios describe: unhappy, and soon to renew or decide
    cohort = risk.scenario_labels(s.wide).filter(
        "renewal_proximity in ('very_high', 'high') and negative_sentiment_count_90d >= 2").select("customer_id")
    return suite.pipeline_suite(
        s.enriched, s.base, s.profile, s.scored, s.signals, s.recommendations, nba.weight_frame(b.tables.spark),
        nba.action_frame(b.tables.spark), cohort)


@query("dq_freshness")
def dq_freshness(b: Build) -> DataFrame:
    loaded = F.date_trunc("DAY", F.col("interaction_date")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    timed = b.interactions.withColumn("_loaded_at", loaded).withColumn(
        "_processed_at", F.col("_loaded_at") + F.make_dt_interval(secs=F.col("duration_seconds")))
    return quality.freshness(timed, "interaction_date", "_loaded_at", "_processed_at", 43200)


@query("scenario_check")
def scenario_check(b: Build) -> DataFrame:
    """Labels against expectations counted straight from the source tables."""
    multi = b.policies.groupBy("customer_id").agg(
        (quality.count_if(F.col("status") == "active") >= 2).cast("string").alias("expected_value")
    ).withColumn("signal_name", F.lit("multi_policy_flag"))
    complaints = b.interactions.filter(
        (F.col("disposition") == "complaint") & CLOCK.in_current(F.col("interaction_date"))
    ).groupBy("customer_id").agg(F.count("*").cast("string").alias("expected_value")).withColumn(
        "signal_name", F.lit("open_complaints"))
    actual = quality.labels_to_long(risk.scenario_labels(b.wide))
    return quality.compare_expectations(multi.unionByName(complaints), actual)


def kept_tables(b: Build) -> dict[str, DataFrame]:
    """A damaged extract: only active customers and no quoted policies."""
    return {
        **logical(b),
        "customers": b.customers.filter(F.col("status") == "active"),
        "policies": b.policies.filter(F.col("status") != "quoted"),
    }


simple(
    dq_pk_unique=lambda b: quality.primary_keys(logical(b)),
    dq_fk_orphans=lambda b: quality.foreign_keys(kept_tables(b)),
    dq_ownership=lambda b: quality.ownership({
        **logical(b, "claims", "payments"),
        # policies moved to the next customer where they lapsed
        "policies": b.policies.withColumn("customer_id", F.col("customer_id") + (F.col("status") == "lapsed").cast("int")),
    }),
    dq_one_to_one=lambda b: quality.one_to_one(b.transcripts, "interaction_id", "one_transcript_per_interaction")
    .unionByName(quality.one_to_one(b.interactions, "customer_id", "one_interaction_per_customer")),
    dq_required_child=lambda b: quality.required_child(
        b.policies.filter(F.col("status") == "active"), b.coverages, "policy_id", "active_policies_have_coverage"),
    dq_date_order=lambda b: quality.date_order(b.policies),
    dq_positive=lambda b: quality.positive_amount(b.payments),
    dq_enums=lambda b: quality.enums(logical(b)),
    dq_consent=lambda b: quality.consent(b.transcripts),
    dq_audit_columns=lambda b: quality.audit_columns({n: landed(b, n) for n in ALL_TABLES}),
    dq_golden_graph=lambda b: quality.golden_graph(logical(b)),
    dq_required_ids=lambda b: quality.required_ids(
        b.customers.filter(F.col("status") == "active"), b.interactions, "customer_id", "contacted_customers_present"),
    dq_word_count=lambda b: quality.word_counts(b.transcripts),
    dq_secrets=lambda b: quality.secrets(b.transcripts, "raw_text"),
    dq_pii=lambda b: quality.pii(b.customers, b.transcripts, "raw_text"),
    dq_tone=lambda b: quality.negative_tone(b.transcripts, RULES.negative),
    dq_quarantine=lambda b: quality.quarantine(
        b.payments, kept_tables(b)["customers"], kept_tables(b)["policies"]
    ).select("payment_id", "_violations", "_warnings", "_quarantined"),
    dq_conditional_rules=lambda b: quality.check_conditional_rules(logical(b), CLOCK.now_col(3)),
    dq_channel_content=lambda b: quality.channel_content(b.transcripts, b.interactions),
    dq_min_one=lambda b: quality.at_least_one(
        b.service_representatives, (F.col("role") == "service_rep") & (F.col("active") == "TRUE"),
        "active_service_representative"),
)

# --- 2.10 semantic layer and application queries -------------------------------------------------------------------

for _name in semantic.VERIFIED_QUERIES:
    query(f"vq_{_name}")(lambda b, n=_name: semantic.verified_query(b.profile, n))

simple(
    metric_query=lambda b: semantic.MODEL.query(b.profile, [
        "household number", "risk level", "number of customers", "book of business", "open claims total",
        "customers at risk"]),
    metrics_all=lambda b: semantic.MODEL.query(b.profile, ["customer_status", *semantic.MODEL.metrics]),
    semantic_enum_check=lambda b: semantic.enum_violations(b.profile),
    customer_options=lambda b: semantic.customer_options(b.customers),
    top_high_risk=lambda b: semantic.top_high_risk(b.profile),
    home_kpis=lambda b: semantic.home_kpis(b.profile),
    interaction_timeline=lambda b: semantic.interaction_timeline(b.enriched),
    renewal_banner=lambda b: semantic.renewal_banner(b.base),
    risk_explanation=lambda b: semantic.risk_explanation(b.signals),
    evidence_top5=lambda b: semantic.evidence_top(b.primary),
)

#: The customers that the point read asks for.
LOOKUP_IDS = [1, 42, 113]
#: A point read opens one bucket of about so many profiles.
PROFILES_PER_BUCKET = 20_000


@query("profile_lookup")
def profile_lookup(b: Build) -> DataFrame:
    """The header cards of single customers, read from the stored serving table."""
    folder = run_folder(b.tables.spark, "serving-profile")
    serving = Buckets(b.tables.spark, folder, "customer_id", per_bucket=PROFILES_PER_BUCKET)
    serving.replace(stored(b).profile_with_timeline, 1)
    return semantic.summary_card(serving.lookup(LOOKUP_IDS))


# --- 2.11 search ---------------------------------------------------------------------------------------------------


def documents(b: Build) -> DataFrame:
    return b.tables.raw("documents").select("doc_id", "lang", "source", F.col("text").alias("content"))


def indexed(b: Build, documents: DataFrame, *attributes: str) -> search.Index:
    """A stored index of the documents."""
    return search.write_index(documents, run_folder(b.tables.spark, "index"), attributes)


def text_hits(b: Build, text: str) -> DataFrame:
    return search.scored(indexed(b, documents(b)), text)


@query("entity_linked_search")
def entity_linked_search(b: Build) -> DataFrame:
    texts = b.transcripts.selectExpr("transcript_id AS doc_id", "content_type AS doc_type", "raw_text AS content",
                                     "concat('text ', transcript_id) AS title")
    owners = b.transcripts.selectExpr("transcript_id AS doc_id", "interaction_id").join(
        b.interactions.select("interaction_id", "customer_id"), "interaction_id").select("doc_id", "customer_id")
    return search.entity_linked_search(b.profile, indexed(b, texts, "doc_type", "title"), owners, SEARCH_TEXT)


@query("search_postings")
def search_postings(b: Build) -> DataFrame:
    index = indexed(b, documents(b))
    return search.search_postings(index.postings, index.statistics, SEARCH_TEXT)


@query("search_corpus")
def search_corpus(b: Build) -> DataFrame:
    """The assembled corpus, restricted by a key attribute."""
    whole = corpus.corpus(policy_documents(b), email_documents(b), transcript_documents(b))
    index = indexed(b, whole, "customer_id", "policy_id", "doc_type", "title")
    return search.search(index, SEARCH_TEXT, filters={"doc_type": "transcript"}).select(
        "doc_id", "customer_id", "doc_type", "title", "score")


simple(
    search_index=lambda b: search.search_index(documents(b), ("lang",)),
    search_bm25=lambda b: search.search(indexed(b, documents(b), "lang"), SEARCH_TEXT).select("doc_id", "lang", "score"),
    search_filtered=lambda b: search.search(
        indexed(b, documents(b), "lang", "source"), SEARCH_TEXT, filters={"lang": "en"}
    ).select("doc_id", "source", "score"),
    search_vector=lambda b: search.search_vector(b.tables.raw("embeddings"), SEARCH_VECTOR),
    search_hybrid=lambda b: search.search_hybrid(
        text_hits(b, SEARCH_TEXT), b.tables.raw("embeddings"), SEARCH_VECTOR),
)

# --- 2.12 incremental and streaming --------------------------------------------------------------------------------


class Feed:
    """A folder that contacts arrive in, and a place for what is made of them."""

    def __init__(self, b: Build, name: str):
        self.spark, self.root = b.tables.spark, run_folder(b.tables.spark, name)
        self.inbox, self.table, self.checkpoint = f"{self.root}/in", f"{self.root}/out", f"{self.root}/checkpoint"

    def arrive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.inbox)

    def stream(self) -> DataFrame:
        return incremental.change_stream(self.spark, self.inbox, self.spark.read.parquet(self.inbox).schema)


@query("stream_new_rows")
def stream_new_rows(b: Build) -> DataFrame:
    feed = Feed(b, "new-rows")
    feed.arrive(past(b.interactions))
    incremental.skip_existing(feed.stream(), feed.checkpoint)
    feed.arrive(later(b.interactions))
    incremental.run_available(
        feed.stream(), feed.checkpoint, incremental.insert_only_sink(feed.spark, feed.table, "interaction_id"))
    return incremental.stored_batches(feed.spark, feed.table).select(
        "interaction_id", "customer_id", "channel", "interaction_date")


def maintained(b: Build, sink) -> tuple[DataFrame, DataFrame]:
    """Aggregate after the past has streamed in, and after the rest has."""
    feed = Feed(b, "maintained")
    feed.arrive(past(b.interactions))
    on_batch = sink(feed)
    incremental.run_available(feed.stream(), feed.checkpoint, on_batch)
    kept = Buckets(feed.spark, feed.table, "customer_id")
    before = kept.read()
    feed.arrive(later(b.interactions))
    incremental.run_available(feed.stream(), feed.checkpoint, on_batch)
    return before, kept.read()


def recompute(feed: Feed):
    return incremental.recompute_sink(feed.spark, KeyedLog(feed.spark, f"{feed.root}/log", "customer_id"), feed.table)


def fold(feed: Feed):
    return incremental.fold_sink(feed.spark, feed.table)


@query("stream_dedup")
def stream_dedup(b: Build) -> DataFrame:
    """Ten days of contacts are delivered twice."""
    feed = Feed(b, "dedup")
    sink = incremental.insert_only_sink(feed.spark, feed.table, "interaction_id")
    overlap = F.col("interaction_date") >= F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    for rows in (past(b.interactions), b.interactions.filter(overlap)):
        feed.arrive(rows)
        incremental.run_available(feed.stream(), feed.checkpoint, sink)
    return incremental.stored_batches(feed.spark, feed.table).select("interaction_id", "customer_id", "interaction_date")


@query("stream_enrich")
def stream_enrich(b: Build) -> DataFrame:
    feed = Feed(b, "enrich")

    def enrich_fresh(fresh: DataFrame) -> DataFrame:
        texts = b.transcripts.join(fresh.select("interaction_id"), "interaction_id", "left_semi")
        return enrichment.enrich(fresh, texts, RULES)

    sink = incremental.insert_only_sink(feed.spark, feed.table, "interaction_id", enrich_fresh)
    for rows in (past(b.interactions), later(b.interactions)):
        feed.arrive(rows)
        incremental.run_available(feed.stream(), feed.checkpoint, sink)
    return incremental.stored_batches(feed.spark, feed.table).select(
        "interaction_id", "enrichment_status", "sentiment_score", "primary_topic", "urgency_level", "is_escalation")


simple(
    incremental_agg=lambda b: maintained(b, recompute)[1],
    incremental_fold=lambda b: maintained(b, fold)[1],
    incremental_verify=lambda b: incremental.before_after(*maintained(b, fold), "customer_id", "total_interactions"),
)

# --- 2.13 access ---------------------------------------------------------------------------------------------------

simple(
    masked_profile=lambda b: privacy.mask_for_role(b.customers, "auditor"),
    role_projection=lambda b: privacy.project_for_role(landed(b, "customers"), "auditor", "analytics"),
    retention_filter=lambda b: privacy.retention_filter(
        b.interactions, "interaction_date", CLOCK.now.date(), 20, b.customers.filter(F.col("status") == "inactive")
    ).select("interaction_id", "customer_id", "interaction_date"),
)


@query("search_vector_pruned")
def search_vector_pruned(b: Build) -> DataFrame:
    """The five nearest vectors from a stored index, of which only the cells that can hold one are opened."""
    index = VectorIndex(b.tables.spark, run_folder(b.tables.spark, "vectors"))
    index.add(b.tables.raw("embeddings"), len(SEARCH_VECTOR))
    return index.search(SEARCH_VECTOR)


#: What an erased customer takes along, and by which key.
CUSTOMER_PRODUCTS = [
    erasure.Product("customers", "customer_id"),
    erasure.Product("policies", "customer_id"),
    erasure.Product("coverages", "policy_id", "policies", "policy_id"),
    erasure.Product("interactions", "customer_id"),
    erasure.Product("transcripts", "interaction_id", "interactions", "interaction_id"),
    erasure.Product("words", "doc_id", "transcripts", "transcript_id"),
    erasure.Product("recommendations", "customer_id"),
]


@query("erasure_report")
def erasure_report(b: Build) -> DataFrame:
    """Inactive customers erased from stored tables and all that hangs on them; what is left is counted on the disk.

    Recommendations are stored first, so that what they were made from is given back before the large tables come."""
    spark, folder = b.tables.spark, run_folder(b.tables.spark, "erasure")
    s = stored(b)
    words = enrichment.transcript_words(b.transcripts, RULES).select("doc_id", "words")
    before = {**{n: b.tables.table(n) for n in ("customers", "policies", "coverages", "interactions", "transcripts")},
              "words": words, "recommendations": s.recommendations}
    stores = {p.name: Buckets(spark, f"{folder}/{p.name}", p.key) for p in CUSTOMER_PRODUCTS}
    stores["recommendations"].replace(before.pop("recommendations"), 0)
    s.release()
    for name, frame in before.items():
        stores[name].replace(frame, 0)
    listed = b.customers.filter(F.col("status") == "inactive").select("customer_id")
    rows = {name: sum(store.pointer().rows.values()) for name, store in stores.items()}
    found = erasure.keys_to_erase(CUSTOMER_PRODUCTS, {name: store.read() for name, store in stores.items()}, listed)
    keys = {name: written(b, f"erased-{name}", k) for name, k in found.items()}
    erasure.erase_stored(CUSTOMER_PRODUCTS, stores, keys, 1)
    return erasure.report(CUSTOMER_PRODUCTS, rows, keys, {name: store.read() for name, store in stores.items()})
