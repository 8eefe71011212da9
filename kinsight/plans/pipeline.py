"""The full build: landing tables in, every product out, each step lazy and built once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from kinsight.config import Settings
from kinsight.operators import aggregates, curated, enrichment, nba, profile, risk
from kinsight.session import emptied, spent_shuffles_dropped


def customer_360_enriched(
    base: DataFrame, windows: DataFrame, settings: Settings, details: DataFrame | None = None
) -> DataFrame:
    """The enriched profile in one pass over base ⟕ windows.

    Signals, composite score, ranking and primary recommendation are all
    computed on the customer's own row, so the profile costs one join instead of
    four, and no intermediate product is built twice.
    """
    joined = base.join(windows, "customer_id", "left")
    scored = risk.with_risk(risk.with_signals(risk.signal_inputs(joined, carry="profile"), settings.weights))
    context = nba.customer_context(scored, "profile", "worsening_signals", "improving_signals")
    best = nba.attach_primary(context, settings.actions, ("profile", "worsening_signals", "improving_signals"))

    # the context columns exist for every customer; they only count next to an action
    row = best.selectExpr(
        "profile.*", "composite_risk_score", "risk_tier", "worsening_signals", "improving_signals", "overall_direction",
        *[f"CASE WHEN action_id IS NOT NULL THEN {c} END AS nba_{c}" for c in profile.NBA_COLUMNS],
    ).selectExpr(
        *base.columns, *profile.SUMMARY, "composite_risk_score", "risk_tier", "worsening_signals", "improving_signals",
        "overall_direction", *[f"nba_{c}" for c in profile.NBA_COLUMNS],
    )
    return profile.serve(row, details)


class Build:
    """All products over one set of landing tables.

    ``tables`` offers customers(), policies(), coverages(), claims(), payments(),
    interactions(), transcripts() and service_representatives(). ``workspace``
    is a shared folder; when given, the products that several others read (profile
    base, enriched interactions, risk rows) are written there once and read back,
    so that text is scored once however many products use it.
    """

    def __init__(self, tables, settings: Settings, scorer: enrichment.Scorer | None = None,
                 workspace: str | None = None):
        self.tables, self.settings, self.scorer, self.workspace = tables, settings, scorer, workspace
        self._stored: dict[str, DataFrame] = {}

    @property
    def clock(self):
        return self.settings.clock

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("customers", "policies", "coverages", "claims", "payments", "interactions", "transcripts",
                    "service_representatives"):
            frame = self.tables.table(name)
            self.__dict__[name] = frame
            return frame
        raise AttributeError(name)

    @cached_property
    def households(self) -> DataFrame:
        return curated.dim_household(self.customers)

    @cached_property
    def agg_policy(self) -> DataFrame:
        return aggregates.agg_customer_policy(self.policies, self.coverages)

    @cached_property
    def agg_claim(self) -> DataFrame:
        return aggregates.agg_customer_claim(self.claims)

    @cached_property
    def agg_payment(self) -> DataFrame:
        return aggregates.agg_customer_payment(self.payments)

    @cached_property
    def agg_interaction(self) -> DataFrame:
        return aggregates.agg_customer_interaction(self.interactions)

    def _kept(self, name: str, frame: DataFrame) -> DataFrame:
        """Write a product that several others read to the workspace once, and read it from there."""
        if self.workspace is None:
            return frame
        path = f"{self.workspace}/{name}"
        with spent_shuffles_dropped(frame.sparkSession):
            frame.write.mode("overwrite").parquet(path)
        self._stored[path] = frame.sparkSession.read.parquet(path)
        return self._stored[path]

    def release(self) -> None:
        """Give back the space of the workspace, when nothing reads its products any more."""
        for path, frame in self._stored.items():
            emptied(frame.sparkSession, path, frame.schema)

    @cached_property
    def base(self) -> DataFrame:
        return self._kept("customer_360_base", profile.customer_360_base(
            self.customers, self.households, self.agg_policy, self.agg_claim, self.agg_payment,
            self.agg_interaction, self.clock,
        ))

    @cached_property
    def enriched(self) -> DataFrame:
        return self._kept("interactions_enriched", enrichment.enrich(
            self.interactions, self.transcripts, self.settings.rules, self.scorer))

    @cached_property
    def windows(self) -> DataFrame:
        return profile.engagement_windows(self.enriched, self.clock)

    @cached_property
    def wide(self) -> DataFrame:
        return risk.risk_wide(self.base, self.windows)

    @cached_property
    def scored(self) -> DataFrame:
        return self._kept("customer_risk", risk.with_risk(risk.with_signals(self.wide, self.settings.weights)))

    @cached_property
    def signals(self) -> DataFrame:
        return risk.risk_signals(self.scored)

    @cached_property
    def summary(self) -> DataFrame:
        return risk.risk_summary(self.scored)

    @cached_property
    def context(self) -> DataFrame:
        return nba.customer_context(self.scored)

    @cached_property
    def recommendations(self) -> DataFrame:
        return nba.recommend(self.context, self.settings.actions, self.settings.max_actions)

    @cached_property
    def primary(self) -> DataFrame:
        return nba.primary(self.recommendations)

    @cached_property
    def timeline(self) -> DataFrame:
        return profile.timeline(profile.timeline_entries(self.enriched, self.clock))

    @cached_property
    def profile(self) -> DataFrame:
        return customer_360_enriched(self.base, self.windows, self.settings)

    @cached_property
    def profile_with_timeline(self) -> DataFrame:
        return customer_360_enriched(self.base, self.windows, self.settings, self.timeline)
