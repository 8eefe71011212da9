"""Declarative metric layer over the enriched profile, and the application's named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.config import TIER_ORDER
from kinsight.functions.numeric import count_if, ordinal, ratio


@dataclass(frozen=True)
class Field:
    """A dimension, fact or metric: how it is computed and what people call it."""

    name: str
    expr: Callable[[], Column] | None = None
    synonyms: tuple[str, ...] = ()
    values: tuple[str, ...] = ()

    def column(self) -> Column:
        return (self.expr() if self.expr else F.col(self.name)).alias(self.name)


def _renewing(days: int) -> Column:
    return (F.col("days_to_renewal") <= days) & (F.col("days_to_renewal") > 0)


def _full_name() -> Column:
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


ELEVATED = ("critical", "high")

FACTS = (
    "total_annual_premium", "active_annual_premium", "total_reserve_amount", "claims_total_paid",
    "avg_sentiment_90d", "worst_sentiment_90d", "avg_sentiment_prior_90d", "enrichment_coverage_pct",
    "composite_risk_score", "nba_final_score", "nba_confidence_score",
)

# Dimensions, business terms and closed value sets of the published model.
DIMENSIONS = (
    Field("customer_id", synonyms=("customer number", "customer identifier", "cust id")),
    Field("customer_name", _full_name, ("customer name", "name", "policyholder name", "full name")),
    Field("first_name"),
    Field("last_name"),
    Field("customer_since", synonyms=("relationship start date", "tenure start", "member since")),
    Field("customer_status", synonyms=("status", "account status"), values=("active", "inactive", "prospect")),
    Field("state", synonyms=("customer state", "location", "us state")),
    Field("city"),
    Field("household_id", synonyms=("household", "household number")),
    Field("active_policies", synonyms=("policy count", "number of policies", "active policy count")),
    Field("total_policies"),
    Field("distinct_product_count", synonyms=("product count", "number of products")),
    Field("product_holdings", synonyms=("products", "product types", "lines of business", "policy types")),
    Field("nearest_renewal_date", synonyms=("renewal date", "next renewal", "expiration date")),
    Field("days_to_renewal", synonyms=("days until renewal", "days to expiration", "renewal proximity")),
    Field("total_claims", synonyms=("claim count", "number of claims")),
    Field("open_claims", synonyms=("open claim count", "pending claims", "active claims")),
    Field("settled_claims"),
    Field("denied_claims"),
    Field("total_payments"),
    Field("payments_on_time", synonyms=("on time payments", "timely payments")),
    Field("payments_late", synonyms=("late payments", "overdue payments")),
    Field("payments_missed", synonyms=("missed payments", "unpaid payments")),
    Field("latest_paid_date", synonyms=("last payment date", "most recent payment")),
    Field("total_interactions", synonyms=("interaction count", "contact count", "number of interactions")),
    Field("interactions_inbound", synonyms=("inbound calls", "inbound interactions")),
    Field("interactions_complaints", synonyms=("complaint count", "number of complaints")),
    Field("latest_interaction_date", synonyms=("last contact", "last interaction", "most recent interaction")),
    Field("latest_channel", synonyms=("last channel", "contact channel"), values=("phone", "email", "chat")),
    Field("negative_count_90d",
          synonyms=("negative interactions", "negative sentiment count", "unhappy interactions")),
    Field("positive_count_90d",
          synonyms=("positive interactions", "positive sentiment count", "happy interactions")),
    Field("enriched_interactions_90d"),
    Field("sentiment_direction", synonyms=("sentiment trend", "sentiment change", "mood trend"),
          values=("worsening", "stable", "improving", "insufficient_data")),
    Field("risk_tier", synonyms=("risk level", "risk category", "risk rating", "churn risk"), values=TIER_ORDER),
    Field("risk_direction", synonyms=("risk trend", "risk change"), values=("worsening", "stable", "improving")),
    Field("worsening_signals"),
    Field("improving_signals"),
    Field("nba_action_type",
          synonyms=("recommended action", "next best action", "nba", "action type", "recommendation"),
          values=("retention_outreach", "renewal_reminder", "complaint_followup", "claim_escalation",
                  "billing_assistance", "cross_sell_home", "cross_sell_umbrella", "no_action")),
    Field("nba_action_name", synonyms=("action name", "recommendation name")),
    Field("nba_action_category", synonyms=("action category",),
          values=("retention", "service", "sales", "administrative")),
    Field("nba_confidence_level", synonyms=("confidence", "recommendation confidence"),
          values=("high", "medium_high", "medium", "low")),
    Field("system_status", synonyms=("data status", "system health"),
          values=("full", "degraded_no_enrichment", "degraded_no_recommendation", "low_confidence")),
    Field("has_enrichment"),
    Field("has_recommendation"),
    Field("has_policies"),
    Field("has_claims"),
    Field("has_interactions"),
)


def _bad_payment_share() -> Column:
    share = ratio(F.col("payments_late") + F.col("payments_missed"), F.col("total_payments"), 8)
    return F.round(F.avg(F.coalesce(share, F.lit(0)).cast("decimal(12,8)")), 6)


def _mean(name: str, kind: str = "decimal(18,4)") -> Column:
    return F.round(F.avg(F.col(name).cast(kind)), 4)


METRICS = (
    Field("customer_count", lambda: F.count("customer_id"),
          ("number of customers", "how many customers", "customer total")),
    Field("avg_active_policies", lambda: _mean("active_policies")),
    Field("total_premium_sum", lambda: F.sum("total_annual_premium"),
          ("total premium", "premium total", "book of business")),
    Field("avg_premium", lambda: _mean("total_annual_premium"), ("average premium",)),
    Field("total_open_claims", lambda: F.sum("open_claims"), ("open claims total",)),
    Field("total_claims_paid_sum", lambda: F.sum("claims_total_paid"), ("total claims paid", "claims payout")),
    Field("total_late_payments", lambda: F.sum("payments_late")),
    Field("total_missed_payments", lambda: F.sum("payments_missed")),
    Field("avg_payment_risk_ratio", _bad_payment_share),
    Field("avg_sentiment", lambda: _mean("avg_sentiment_90d"), ("average sentiment", "mean sentiment")),
    Field("total_negative_interactions", lambda: F.sum("negative_count_90d"), ("negative interaction total",)),
    Field("avg_risk_score", lambda: _mean("composite_risk_score"), ("average risk", "mean risk score")),
    Field("high_risk_customer_count", lambda: count_if(F.col("risk_tier").isin(*ELEVATED)),
          ("high risk customers", "at-risk customers", "customers at risk")),
    Field("customers_with_recommendation", lambda: F.count("nba_action_type"),
          ("customers with nba", "recommended customers")),
    Field("avg_nba_confidence", lambda: _mean("nba_confidence_score")),
    Field("customers_renewing_30d", lambda: count_if(_renewing(30)),
          ("renewals in 30 days", "upcoming renewals", "customers renewing soon")),
    Field("customers_renewing_14d", lambda: count_if(_renewing(14)), ("urgent renewals", "renewals in 2 weeks")),
)


@dataclass(frozen=True)
class SemanticModel:
    facts: tuple[str, ...] = FACTS
    dimensions: dict[str, Field] = field(default_factory=lambda: {d.name: d for d in DIMENSIONS})
    metrics: dict[str, Field] = field(default_factory=lambda: {m.name: m for m in METRICS})

    def resolve(self, term: str) -> str:
        """Business term or name to the field it stands for."""
        wanted = term.strip().lower()
        fields = {**{f: Field(f) for f in self.facts}, **self.dimensions, **self.metrics}
        if wanted in fields:
            return wanted
        for name, entry in fields.items():
            if wanted in (s.lower() for s in entry.synonyms):
                return name
        raise KeyError(f"no field is called {term!r}")

    def _column(self, name: str) -> Column:
        return self.dimensions[name].column() if name in self.dimensions else F.col(name)

    def query(
        self, profile: DataFrame, select: list[str], where: Column | None = None, order_by: list | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """Fields by name or business term. With a metric among them, the others become the grouping."""
        names = [self.resolve(s) for s in select]
        rows = profile.filter(where) if where is not None else profile
        measures = [n for n in names if n in self.metrics]
        keys = [self._column(n) for n in names if n not in self.metrics]
        if measures:
            out = rows.groupBy(*keys).agg(*[self.metrics[m].column() for m in measures]).select(*names)
        else:
            # keep the sort keys available, they need not be among the output fields
            out = rows.withColumns({n: self.dimensions[n].expr() for n in names
                                    if n in self.dimensions and self.dimensions[n].expr})
            if order_by:
                out = out.orderBy(*order_by)
            out = out.select(*names)
            return out.limit(limit) if limit else out
        if order_by:
            out = out.orderBy(*order_by)
        return out.limit(limit) if limit else out


MODEL = SemanticModel()


def enum_violations(profile: DataFrame, model: SemanticModel = MODEL) -> DataFrame:
    """Values of closed dimensions outside their declared set, all dimensions in one scan."""
    closed = [d for d in model.dimensions.values() if d.values]
    counted = profile.agg(*[count_if(~F.col(d.name).isin(*d.values)).alias(d.name) for d in closed])
    rows = F.array(*[F.struct(F.lit(d.name).alias("dimension"), F.col(d.name).alias("violations")) for d in closed])
    return counted.select(F.explode(rows).alias("r")).select("r.dimension", "r.violations")


def _who(customer_id) -> Column | None:
    return None if customer_id is None else F.col("customer_id") == F.lit(customer_id)


def verified_query(profile: DataFrame, name: str, customer_id=None, model: SemanticModel = MODEL) -> DataFrame:
    """The named questions with their known-correct answers.

    Questions about one customer take ``customer_id``; without it they answer for every customer.
    """
    q, score = model.query, F.desc("composite_risk_score")
    return {
        "renewals_30d": lambda: q(profile, [
            "customer_name", "customer_id", "days_to_renewal", "nearest_renewal_date", "active_policies",
            "product_holdings", "risk_tier", "nba_action_name"], _renewing(30), ["days_to_renewal", "customer_id"]),
        "negative_sentiment": lambda: q(profile, [
            "customer_name", "customer_id", "avg_sentiment_90d", "sentiment_direction", "negative_count_90d"],
            F.col("sentiment_direction") == "worsening", ["avg_sentiment_90d", "customer_id"]),
        "negative_and_renewal": lambda: q(profile, [
            "customer_name", "customer_id", "negative_count_90d", "days_to_renewal", "risk_tier", "nba_action_name"],
            (F.col("negative_count_90d") > 0) & _renewing(30), [score, "customer_id"]),
        "risk_distribution": lambda: q(profile, ["risk_tier", "customer_count"],
                                       order_by=[ordinal(F.col("risk_tier"), TIER_ORDER)]),
        "critical_risk": lambda: q(profile, [
            "customer_name", "customer_id", "composite_risk_score", "risk_tier", "risk_direction", "days_to_renewal",
            "negative_count_90d", "avg_sentiment_90d", "sentiment_direction", "payments_late", "payments_missed",
            "open_claims", "interactions_complaints", "nba_action_name", "nba_confidence_level"],
            F.col("risk_tier") == "critical", [score, "customer_id"]),
        "nba_by_risk": lambda: q(profile, ["nba_action_type", "customer_count"],
                                 F.col("risk_tier").isin(*ELEVATED), [F.desc("customer_count"), "nba_action_type"]),
        "customer_profile": lambda: q(profile, [
            "customer_name", "customer_id", "active_policies", "product_holdings", "days_to_renewal",
            "negative_count_90d", "avg_sentiment_90d", "risk_tier", "composite_risk_score", "nba_action_name",
            "nba_confidence_level"], _who(customer_id)),
        "complaint_customers": lambda: q(profile, ["customer_count"], F.col("negative_count_90d") > 0),
        "nba_distribution": lambda: q(profile, ["nba_action_type", "customer_count"],
                                      order_by=[F.desc("customer_count"), "nba_action_type"]),
        "high_confidence_actions": lambda: q(profile, [
            "customer_name", "customer_id", "nba_action_name", "nba_confidence_level", "risk_tier"],
            F.col("nba_confidence_level") == "high", [F.desc("nba_final_score"), "customer_id"]),
        "premium_by_risk": lambda: q(profile, ["risk_tier", "customer_count", "total_premium_sum"],
                                     F.col("risk_tier").isin(*ELEVATED)),
        "system_status": lambda: q(profile, ["system_status", "customer_count"],
                                   order_by=[F.desc("customer_count"), "system_status"]),
        "why_at_risk": lambda: q(profile, [
            "customer_name", "risk_tier", "composite_risk_score", "risk_direction", "days_to_renewal",
            "nearest_renewal_date", "negative_count_90d", "avg_sentiment_90d", "worst_sentiment_90d",
            "sentiment_direction", "payments_late", "payments_missed", "total_payments", "interactions_complaints",
            "open_claims", "total_claims", "worsening_signals", "improving_signals", "enrichment_coverage_pct",
            "system_status"], _who(customer_id)),
        "what_recommendation": lambda: q(profile, [
            "customer_name", "customer_id", "nba_action_name", "nba_action_type", "nba_action_category",
            "nba_final_score", "nba_confidence_level", "nba_confidence_score", "risk_tier", "composite_risk_score",
            "risk_direction", "system_status"], _who(customer_id)),
        "evidence_for_recommendation": lambda: q(profile, [
            "customer_name", "nba_action_name", "nba_confidence_level", "negative_count_90d", "avg_sentiment_90d",
            "worst_sentiment_90d", "sentiment_direction", "enriched_interactions_90d", "days_to_renewal",
            "nearest_renewal_date", "active_policies", "product_holdings", "payments_late", "payments_missed",
            "total_payments", "interactions_complaints", "open_claims", "enrichment_coverage_pct", "has_enrichment",
            "system_status"], _who(customer_id)),
    }[name]()


VERIFIED_QUERIES = (
    "renewals_30d", "negative_sentiment", "negative_and_renewal", "risk_distribution", "critical_risk", "nba_by_risk",
    "customer_profile", "complaint_customers", "nba_distribution", "high_confidence_actions", "premium_by_risk",
    "system_status", "why_at_risk", "what_recommendation", "evidence_for_recommendation",
)


# --- application queries -----------------------------------------------------------------------------------------


def customer_options(customers: DataFrame) -> DataFrame:
    """Picker labels 'Name (id)', sorted by name, with the id read back from the label."""
    label = F.concat(_full_name(), F.lit(" ("), F.col("customer_id").cast("string"), F.lit(")"))
    return customers.orderBy("last_name", "first_name", "customer_id").select(label.alias("label")).withColumn(
        "parsed_id", parse_option(F.col("label"))
    )


def parse_option(label: Column) -> Column:
    """Id between the last pair of brackets, or the text itself when there is none."""
    return F.when(label.rlike(r"\([^()]*\)$"), F.regexp_extract(label, r"\(([^()]*)\)$", 1)).otherwise(label)


def top_high_risk(profile: DataFrame, k: int = 10) -> DataFrame:
    return profile.filter(F.col("risk_tier").isin(*ELEVATED)).withColumn("customer_name", _full_name()).orderBy(
        F.desc("composite_risk_score"), "customer_id"
    ).limit(k).select(
        "customer_id", "customer_name", "risk_tier", "composite_risk_score", "days_to_renewal", "nba_action_name",
        "nba_confidence_level", "negative_count_90d",
    )


def home_kpis(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count("*").alias("total"),
        count_if(F.col("risk_tier").isin(*ELEVATED)).alias("high_risk"),
        count_if(_renewing(30)).alias("renewing_30d"),
        count_if(F.col("system_status") == "full").alias("fully_operational"),
    )


def summary_card(profile: DataFrame, customer_id=None) -> DataFrame:
    """The header card: of one customer, or of all."""
    rows = profile if customer_id is None else profile.filter(_who(customer_id))
    return rows.select(
        "customer_id", _full_name().alias("customer_name"), "risk_tier", "composite_risk_score", "days_to_renewal",
        "active_policies", "product_holdings", "nba_action_name", "nba_confidence_level", "system_status",
        F.when(F.col("days_to_renewal") > 0, F.concat(F.lit("Renewal in "), F.col("days_to_renewal").cast("string"),
                                                     F.lit("d"))).otherwise("No upcoming renewal").alias("renewal_text"),
    )


def interaction_timeline(enriched: DataFrame, customer_id=None) -> DataFrame:
    """Contacts with their enrichment, newest first; of one customer, or of all."""
    rows = enriched if customer_id is None else enriched.filter(_who(customer_id))
    return rows.select(
        "customer_id", "interaction_id", "interaction_date", "channel", "direction", "disposition", "sentiment_label",
        "sentiment_score", "summary", "primary_topic", "primary_intent", "urgency_level", "is_complaint",
        "enrichment_status",
    ).orderBy("customer_id", F.desc("interaction_date"), "interaction_id")


def renewal_banner(profile: DataFrame) -> DataFrame:
    """Renewal banner class and text, and the share of late or missed payments."""
    days, bad = F.col("days_to_renewal"), F.col("payments_late") + F.col("payments_missed")
    on = F.col("nearest_renewal_date").cast("string")
    share = F.round(ratio(bad * 100, F.greatest("total_payments", F.lit(1))), 0).cast("int")
    return profile.select(
        "customer_id",
        F.when(on.isNull(), "none").when(days <= 14, "urgent").when(days <= 30, "approaching").otherwise("info")
        .alias("banner"),
        F.when(days <= 14, F.concat(F.lit("URGENT: Renewal on "), on, F.lit(" ("), days.cast("string"), F.lit(" days)")))
        .when(days <= 30, F.concat(F.lit("Approaching: Renewal on "), on, F.lit(" ("), days.cast("string"), F.lit(" days)")))
        .when(on.isNotNull(), F.concat(F.lit("Next renewal: "), on)).alias("banner_text"),
        F.when(bad == 0, F.lit(0)).otherwise(share).alias("late_pct"),
        F.when(bad == 0, "All payments current").otherwise(
            F.concat(share.cast("string"), F.lit("% of payments late or missed"))).alias("payment_text"),
    )


def risk_explanation(signals: DataFrame, top: int = 3) -> DataFrame:
    """The evidence of the heaviest active signals as one sentence list per customer."""
    best = Window.partitionBy("customer_id").orderBy(F.desc("weighted_score"), "signal_type")
    ranked = signals.filter(F.col("weighted_score") > 0).withColumn("_r", F.row_number().over(best)).filter(
        F.col("_r") <= top)
    return ranked.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.struct("_r", "evidence_text"))).alias("_e")
    ).select("customer_id", F.concat(F.array_join("_e.evidence_text", ". "), F.lit(".")).alias("explanation"))


def evidence_top(primary: DataFrame, k: int = 5) -> DataFrame:
    """The k heaviest contributing signals behind each primary recommendation."""
    active = F.filter("evidence_signals", lambda e: e["weighted_score"] > 0)
    return primary.select("customer_id", "action_type", F.posexplode(F.slice(active, 1, k)).alias("position", "e")).select(
        "customer_id", "action_type", "position", "e.signal_type", "e.weighted_score", "e.direction", "e.evidence"
    )
