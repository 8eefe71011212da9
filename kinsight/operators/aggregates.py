"""Per-customer aggregates, one per domain so that no domain fans out another.

All of them aggregate on fixed-width buffers (hash aggregation with map-side
combine): a customer holding a third of all rows is reduced to one partial row
per input task before anything is shuffled. Where a string must survive the
aggregation (product list, latest channel) a first grouping by the small domain
(customer, product) or (customer, channel) does the heavy reduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.functions.numeric import count_if, count_where

TOTAL = "decimal(14,2)"


def total(name: str, expression: str) -> Column:
    return F.expr(f"CAST(sum({expression}) AS {TOTAL}) AS {name}")


def agg_customer_policy(policies: DataFrame, coverages: DataFrame) -> DataFrame:
    per_product = policies.groupBy("customer_id", "product_type").agg(
        F.expr("count(*) AS _n"),
        count_where("_active", "status = 'active'"),
        F.expr("min(CASE WHEN status = 'active' THEN expiration_date END) AS _renewal"),
        F.expr("sum(premium_amount) AS _premium"),
        F.expr("sum(CASE WHEN status = 'active' THEN premium_amount ELSE 0.00 END) AS _active_premium"),
    )
    policy = per_product.groupBy("customer_id").agg(
        F.expr("sum(_n) AS total_policies"),
        F.expr("sum(_active) AS active_policies"),
        F.expr("count(product_type) AS distinct_product_count"),
        F.expr("nullif(array_join(sort_array(collect_list(product_type)), ', '), '') AS product_holdings"),
        F.expr("min(_renewal) AS nearest_renewal_date"),
        total("total_annual_premium", "_premium"),
        total("active_annual_premium", "_active_premium"),
    )
    # coverages shrink to one row per policy before they meet their owner
    per_policy = coverages.groupBy("policy_id").agg(
        F.expr("sum(limit_amount) AS _limit"), F.expr("sum(deductible_amount) AS _deductible")
    )
    coverage = per_policy.join(policies.select("policy_id", "customer_id"), "policy_id").groupBy("customer_id").agg(
        total("total_coverage_limit", "_limit"), total("total_deductible", "_deductible")
    )
    return policy.join(coverage, "customer_id", "left")


def agg_customer_claim(claims: DataFrame) -> DataFrame:
    return claims.groupBy("customer_id").agg(
        F.expr("count(*) AS total_claims"),
        count_where("open_claims", "status IN ('filed', 'under_review')"),
        count_where("settled_claims", "status = 'settled'"),
        count_where("denied_claims", "status = 'denied'"),
        total("total_reserve_amount", "reserve_amount"),
        total("total_paid_amount", "paid_amount"),
        F.expr("min(filed_date) AS earliest_filed_date"),
        F.expr("max(filed_date) AS latest_filed_date"),
    )


def agg_customer_payment(payments: DataFrame) -> DataFrame:
    return payments.groupBy("customer_id").agg(
        F.expr("count(*) AS total_payments"),
        *[
            count_where(f"{value}_count", f"status = '{value}'")
            for value in ("on_time", "late", "missed", "grace_period", "pending")
        ],
        F.expr("max(paid_date) AS latest_paid_date"),
        total("total_amount_due", "amount"),
        total("total_amount_paid", "amount_paid"),
    )


def agg_customer_interaction(interactions: DataFrame) -> DataFrame:
    """Ties for the latest contact go to the alphabetically last channel."""
    per_channel = interactions.groupBy("customer_id", "channel").agg(
        F.expr("count(*) AS total_interactions"),
        F.expr("max(interaction_date) AS _latest"),
        count_where("inbound_count", "direction = 'inbound'"),
        count_where("outbound_count", "direction = 'outbound'"),
        count_where("complaint_count", "disposition = 'complaint'"),
        count_where("inquiry_count", "disposition = 'inquiry'"),
        count_where("request_count", "disposition = 'request'"),
    )
    return per_channel.groupBy("customer_id").agg(
        F.expr("sum(total_interactions) AS total_interactions"),
        F.expr("sum(inbound_count) AS inbound_count"),
        F.expr("sum(outbound_count) AS outbound_count"),
        F.expr("max(_latest) AS latest_interaction_date"),
        F.expr("max_by(channel, struct(_latest, channel)) AS latest_channel"),
        *[F.expr(f"sum({n}) AS {n}") for n in ("complaint_count", "inquiry_count", "request_count")],
    )


def fold_interaction_delta(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge aggregates of new interactions into existing ones without touching the history.

    Every column is a count or a maximum, so the union of the two partial
    results aggregates to exactly what a rebuild over all rows would give.
    """
    counts = ("total_interactions", "inbound_count", "outbound_count", "complaint_count", "inquiry_count",
              "request_count")
    both = current.unionByName(delta.select(*current.columns))
    return both.groupBy("customer_id").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.max("latest_interaction_date").alias("latest_interaction_date"),
        F.max_by("latest_channel", F.struct("latest_interaction_date", "latest_channel")).alias("latest_channel"),
    ).select(*current.columns)


def household_policies(customers: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies rolled up to the household: per customer first, then per household."""
    per_customer = policies.groupBy("customer_id").agg(
        F.count("*").alias("_n"), count_if(F.col("status") == "active").alias("_active")
    )
    return customers.select("customer_id", "household_id").join(per_customer, "customer_id", "left") \
        .groupBy("household_id").agg(
            F.count("*").alias("household_member_count"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_household_policies"),
            F.coalesce(F.sum("_active"), F.lit(0)).alias("household_policy_count"),
        )


def trailing_12m(customers, payments, claims, interactions, today: Column, now: Column) -> DataFrame:
    """Late/missed payments, claims and contacts of the last 365 days, one row per customer."""
    start, start_ts = F.date_sub(today, 365), now - F.expr("INTERVAL 365 DAY")
    pay = payments.filter(F.col("due_date") >= start).groupBy("customer_id").agg(
        count_if(F.col("status") == "missed").alias("missed_payment_count_12m"),
        count_if(F.col("status") == "late").alias("late_payment_count_12m"),
    )
    claim = claims.filter(F.col("filed_date") >= start).groupBy("customer_id").agg(
        F.count("*").alias("claims_filed_12m"), total("total_paid_12m", "paid_amount")
    )
    contact = interactions.filter(F.col("interaction_date") >= start_ts).groupBy("customer_id").agg(
        F.count("*").alias("total_interactions_12m")
    )
    zero = {c: 0 for c in ("missed_payment_count_12m", "late_payment_count_12m", "claims_filed_12m",
                           "total_interactions_12m")}
    return customers.select("customer_id").join(pay, "customer_id", "left").join(claim, "customer_id", "left") \
        .join(contact, "customer_id", "left").fillna(zero)
