"""Landing tables to dimensions and facts (Type 1), plus history-keeping variants."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lineage(df: DataFrame, source: str, *columns) -> DataFrame:
    """Projection of business columns that carries the landing audit columns along when present."""
    carried = []
    if "_row_hash" in df.columns:
        carried.append(F.col("_row_hash").alias("_source_hash"))
    if "_batch_id" in df.columns:
        carried.append(F.col("_batch_id"))
    return df.select(*columns, *carried, F.lit(source).alias("_source_table"))


def dim_customer(customers: DataFrame) -> DataFrame:
    return lineage(
        customers, "RAW.RAW_CUSTOMERS", "customer_id", "household_id", "first_name", "last_name", "date_of_birth",
        "email", "phone", "address_line_1", "city", "state", "postal_code", "customer_since", "status",
    )


def _max_audit(df: DataFrame) -> list[Column]:
    pairs = (("_row_hash", "_source_hash"), ("_batch_id", "_batch_id"))
    return [F.max(src).alias(dst) for src, dst in pairs if src in df.columns]


def dim_household(customers: DataFrame) -> DataFrame:
    """One row per household; ties for the most common state go to the alphabetically first.

    The state is counted first, per (household, state): that pre-aggregation is
    a hash aggregate with map-side combine, so one household holding a large
    share of all customers never lands in one task.
    """
    per_state = customers.groupBy("household_id", "state").agg(
        F.count("*").alias("_n"),
        F.min("city").alias("_city"),
        F.max((F.col("status") == "active").cast("int")).alias("_active"),
        F.min("customer_since").alias("_since"),
        *_max_audit(customers),
    )
    # a NULL state counts as a member but never wins the mode
    vote = F.when(F.col("state").isNotNull(), F.struct(-F.col("_n"), F.col("state")))
    return per_state.groupBy("household_id").agg(
        F.sum("_n").alias("member_count"),
        F.min_by("state", vote).alias("primary_state"),
        F.min("_city").alias("primary_city"),
        F.when(F.max("_active") > 0, "active").otherwise("inactive").alias("household_status"),
        F.min("_since").alias("earliest_since"),
        *[F.max(c).alias(c) for c in ("_source_hash", "_batch_id") if c in per_state.columns],
    )


def dim_product(policies: DataFrame) -> DataFrame:
    kind = F.col("product_type")
    return policies.groupBy("product_type").agg(*(_max_audit(policies) or [F.count("*").alias("_rows")])).select(
        "product_type",
        F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))).alias("product_name"),
        F.when(kind == "auto", "Vehicle").when(kind.isin("home", "renters"), "Property")
        .when(kind == "umbrella", "Liability").otherwise("Other").alias("product_category"),
        *[c for c in ("_source_hash", "_batch_id") if _max_audit(policies)],
    )


def dim_policy(policies: DataFrame) -> DataFrame:
    return lineage(
        policies, "RAW.RAW_POLICIES", "policy_id", "customer_id", "product_type", "status", "effective_date",
        "expiration_date", "premium_amount", "payment_frequency", "bound_date",
    )


def dim_coverage(coverages: DataFrame) -> DataFrame:
    return lineage(
        coverages, "RAW.RAW_COVERAGES", "coverage_id", "policy_id", "coverage_type", "limit_amount",
        "deductible_amount",
    )


def dim_channel(interactions: DataFrame) -> DataFrame:
    code = F.col("channel")
    return interactions.groupBy("channel").agg(*(_max_audit(interactions) or [F.count("*").alias("_rows")])).select(
        code.alias("channel_code"),
        F.initcap(code).alias("channel_name"),
        F.when(code.isin("email", "chat"), "Digital").when(code == "phone", "Traditional").otherwise("Other")
        .alias("channel_category"),
        *[c for c in ("_source_hash", "_batch_id") if _max_audit(interactions)],
    )


def dim_service_representative(representatives: DataFrame) -> DataFrame:
    return lineage(
        representatives, "RAW.RAW_SERVICE_REPRESENTATIVES", "representative_id", "name", "role",
        F.coalesce(F.upper("active") == "TRUE", F.lit(False)).alias("active"), "team",
    )


def date_span(columns: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Earliest and latest date over many columns: one partial min/max per table, never a distinct."""
    spans = [
        df.agg(*[agg(F.to_date(c)).alias(f"{tag}_{c}") for c in cols for tag, agg in (("lo", F.min), ("hi", F.max))])
        .select(
            F.least(*[F.col(f"lo_{c}") for c in cols], F.lit(None).cast("date")).alias("lo"),
            F.greatest(*[F.col(f"hi_{c}") for c in cols], F.lit(None).cast("date")).alias("hi"),
        )
        for df, cols in columns
    ]
    return reduce(DataFrame.unionByName, spans).agg(F.min("lo").alias("min_dt"), F.max("hi").alias("max_dt"))


def dim_date(customers, policies, claims, payments, interactions) -> DataFrame:
    """One row per calendar day between the first and last date in the source tables (no length limit)."""
    span = date_span([
        (customers, ["customer_since"]),
        (policies, ["effective_date", "expiration_date", "bound_date"]),
        (claims, ["filed_date", "loss_date", "closed_date"]),
        (payments, ["due_date", "paid_date"]),
        (interactions, ["interaction_date"]),
    ])
    day = F.col("calendar_date")
    return span.select(F.explode(F.sequence("min_dt", "max_dt")).alias("calendar_date")).select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_sk"),
        day,
        F.weekday(day).alias("day_of_week"),
        F.date_format(day, "EEE").alias("day_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month_number"),
        F.date_format(day, "MMM").alias("month_name"),
        F.quarter(day).alias("quarter_number"),
        F.year(day).alias("year_number"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        F.quarter(day).alias("fiscal_quarter"),
        F.year(day).alias("fiscal_year"),
    )


def fact_claim(claims: DataFrame) -> DataFrame:
    return lineage(
        claims, "RAW.RAW_CLAIMS", "claim_id", "policy_id", "customer_id", "filed_date", "loss_date", "closed_date",
        "status", "loss_type", "reserve_amount", "paid_amount",
    )


def fact_payment(payments: DataFrame) -> DataFrame:
    return lineage(
        payments, "RAW.RAW_PAYMENTS", "payment_id", "customer_id", "policy_id", "due_date", "paid_date", "amount",
        "amount_paid", "status",
    )


def fact_interaction(interactions: DataFrame) -> DataFrame:
    return lineage(
        interactions, "RAW.RAW_INTERACTIONS", "interaction_id", "customer_id", "channel", "representative_id",
        "interaction_date", F.to_date("interaction_date").alias("interaction_date_key"), "direction", "disposition",
        "duration_seconds",
    )


def transcript_content(transcripts: DataFrame) -> DataFrame:
    return lineage(
        transcripts, "RAW.RAW_TRANSCRIPTS", "transcript_id", "interaction_id", "content_type", "raw_text",
        "word_count", "recording_consent_flag",
    )


def claim_days_open(claims: DataFrame, today: Column) -> DataFrame:
    return claims.select(
        "claim_id", "status", F.datediff(F.coalesce("closed_date", today), "filed_date").alias("days_open")
    )


def payment_days_late(payments: DataFrame) -> DataFrame:
    return payments.select("payment_id", "status", F.datediff("paid_date", "due_date").alias("days_late"))


# --- history -------------------------------------------------------------------------------------------------


def change_feed(old: DataFrame, new: DataFrame, key: str, hash_col: str = "_row_hash") -> DataFrame:
    """Classify every key as insert / update / delete / unchanged by comparing row hashes.

    ``_action``/``_is_update`` follow change-stream metadata: an update counts as
    an INSERT with the update flag set.
    """
    before = old.select(key, F.col(hash_col).alias("old_hash"))
    after = new.select(key, F.col(hash_col).alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete")
        .when(F.col("old_hash") != F.col("new_hash"), "update").otherwise("unchanged")
    )
    return before.join(after, key, "full_outer").select(
        key, change.alias("change_type"),
        F.when(change == "delete", "DELETE").when(change != "unchanged", "INSERT").alias("_action"),
        (change == "update").alias("_is_update"),
    )


def scd2_apply(history: DataFrame, snapshot: DataFrame, key: str, as_of: Column, hash_col: str = "_row_hash") -> DataFrame:
    """Merge a new snapshot into a versioned dimension.

    Closed versions pass through untouched; only current rows meet the snapshot,
    in one full-outer join on the key. Changed or vanished keys get ``valid_to``;
    changed or new keys get a new current version.
    """
    business = [c for c in history.columns if c not in ("valid_from", "valid_to", "is_current")]
    closed = history.filter(~F.col("is_current"))
    current = history.filter("is_current").select(key, F.struct(*history.columns).alias("old"))
    incoming = snapshot.select(key, F.struct(*business).alias("new"))
    both = current.join(incoming, key, "full_outer")
    same = F.col("old").isNotNull() & F.col("new").isNotNull() & (
        F.col(f"old.{hash_col}").eqNullSafe(F.col(f"new.{hash_col}"))
    )
    ends = F.when(same, F.lit(None).cast(history.schema["valid_to"].dataType)).otherwise(as_of)
    old_row = F.when(F.col("old").isNotNull(), F.struct(
        *[F.col(f"old.{c}").alias(c) for c in business], F.col("old.valid_from").alias("valid_from"),
        ends.alias("valid_to"), same.alias("is_current"),
    ))
    new_row = F.when(F.col("new").isNotNull() & ~same, F.struct(
        *[F.col(f"new.{c}").alias(c) for c in business], as_of.alias("valid_from"),
        F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("is_current"),
    ))
    rows = both.select(F.explode(F.array(old_row, new_row)).alias("r")).filter("r is not null").select("r.*")
    return closed.unionByName(rows)


def scd2_insert(
    history: DataFrame, snapshot: DataFrame, key: str, as_of: date, known: list[date], hash_col: str = "_row_hash"
) -> DataFrame:
    """Merge a snapshot of any date into a versioned dimension, so that snapshots give one history in any order.

    ``known`` are the dates of the snapshots that the history was made of; a snapshot says what holds from its date to
    the next of them. Versions that cover this stretch are split around it, the snapshot's rows fill it, and versions
    that touch and are the same become one. Only versions that touch the stretch are worked on; the others pass
    through. A date that is known already is replaced. Keys are unique in the snapshot.
    """
    later = [d for d in known if d > as_of]
    end = F.lit(min(later)) if later else F.lit(None).cast("date")
    start, forever = F.lit(as_of), F.lit(date.max)
    business = [c for c in history.columns if c not in ("valid_from", "valid_to", "is_current")]
    ends = F.coalesce("valid_to", forever)
    near = (ends >= start) & (F.col("valid_from") <= F.coalesce(end, forever))
    row = [F.col(c) for c in business]
    touching = history.filter(near).select(*row, "valid_from", ends.alias("until"))
    before = touching.filter(F.col("valid_from") < start).select(*row, "valid_from", F.least("until", start).alias("until"))
    inside = snapshot.select(*row, start.alias("valid_from"), F.coalesce(end, forever).alias("until"))
    parts = before.unionByName(inside)
    if later:
        parts = parts.unionByName(touching.filter(F.col("until") > end).select(*row, F.greatest("valid_from", end).alias("valid_from"), "until"))
    # at most the versions around the stretch meet for a key: one before, one inside, one after
    pieces = F.array_sort(F.collect_list(F.struct("valid_from", "until", F.struct(*business).alias("row"))))
    joined = F.aggregate(
        "pieces", F.slice("pieces", 1, 0),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["until"] == x["valid_from"])
            & F.element_at(done, -1)["row"][hash_col].eqNullSafe(x["row"][hash_col]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(
                F.struct(F.element_at(done, -1)["valid_from"].alias("valid_from"), x["until"].alias("until"), x["row"].alias("row")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    fresh = parts.groupBy(key).agg(pieces.alias("pieces")).select(F.explode(joined).alias("p")).select(
        *[F.col(f"p.row.{c}").alias(c) for c in business], F.col("p.valid_from").alias("valid_from"),
        F.when(F.col("p.until") != forever, F.col("p.until")).alias("valid_to"),
        (F.col("p.until") == forever).alias("is_current"),
    )
    return history.filter(~near).unionByName(fresh.select(*history.columns))
