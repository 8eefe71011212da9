"""Parameters of the pipeline. Operators take these as arguments; nothing reads a clock."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    """The moment a build is computed for.

    ``today`` dates renewals, ``now`` anchors the trailing interaction windows:
    current = [now - w, ...), prior = [now - 2w, now - w).
    """

    today: date
    now: datetime
    window_days: int = 90

    def today_col(self) -> Column:
        return F.lit(self.today)

    def now_sql(self, days_back: int = 0) -> str:
        moment = self.now - timedelta(days=days_back)
        return f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'"

    def current_sql(self, ts: str = "interaction_date") -> str:
        return f"({ts} >= {self.now_sql(self.window_days)})"

    def recent_sql(self, ts: str = "interaction_date") -> str:
        return f"({ts} >= {self.now_sql(2 * self.window_days)})"

    def prior_sql(self, ts: str = "interaction_date") -> str:
        return f"({self.recent_sql(ts)} AND {ts} < {self.now_sql(self.window_days)})"

    def now_col(self, days_back: int = 0) -> Column:
        return F.expr(self.now_sql(days_back))

    def in_current(self, ts: Column) -> Column:
        return ts >= self.now_col(self.window_days)

    def in_recent(self, ts: Column) -> Column:
        return ts >= self.now_col(2 * self.window_days)


# Weight and description of the eight named signals.
@dataclass(frozen=True)
class Signal:
    signal_type: str
    signal_name: str
    weight: Decimal
    description: str
    is_risk: bool = True


SIGNALS = (
    Signal("renewal_proximity", "Renewal Proximity", Decimal("0.30"),
           "Days until nearest policy renewal date"),
    Signal("sentiment_negative", "Negative Sentiment", Decimal("0.25"),
           "Count and severity of negative interactions in 90 days"),
    Signal("sentiment_trend", "Sentiment Trend", Decimal("0.10"),
           "Direction of sentiment change (current vs prior 90d)"),
    Signal("payment_risk", "Payment Risk", Decimal("0.15"),
           "Ratio of late/missed payments to total"),
    Signal("complaint_activity", "Complaint Activity", Decimal("0.10"),
           "Recent complaints and escalation requests"),
    Signal("claim_activity", "Claim Activity", Decimal("0.05"),
           "Open and recent claims indicating service load"),
    Signal("engagement_drop", "Engagement Change", Decimal("0.05"),
           "Change in interaction frequency"),
    Signal("cross_sell_opportunity", "Cross-Sell Gap", Decimal("0.00"),
           "Missing product types relative to household profile", False),
)

SIGNAL_WEIGHTS = {s.signal_type: s.weight for s in SIGNALS}

# Composite score from which a tier starts, most severe first; the rest is 'low'.
RISK_TIERS = (("critical", Decimal("0.40")), ("high", Decimal("0.25")), ("medium", Decimal("0.10")))
TIER_ORDER = ("critical", "high", "medium", "low")
CONFIDENCE_ORDER = ("high", "medium_high", "medium", "low")
URGENCY_ORDER = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Action:
    """One catalogue entry: what may be recommended, to whom, and how it is scored.

    ``relevance`` lists (condition, points); the condition names are those of
    ``operators.nba.conditions``.
    """

    action_id: str
    action_type: str
    action_name: str
    action_description: str
    action_category: str
    safety_score: Decimal
    priority_rank: int
    relevance: tuple[tuple[str, str], ...]
    eligible_products: str = "ALL"
    excluded_products: str | None = None
    requires_risk_tier: str | None = None
    requires_signal: str | None = None


# The action catalogue with its published texts, gates and points.
ACTIONS = (
    Action(
        "ACT-001", "retention_outreach", "Retention Outreach",
        "Acknowledge prior service issues, offer an eligible loyalty adjustment subject to policy rules and "
        "representative approval, and confirm that current coverage still meets the customer's needs.",
        "retention", Decimal("0.95"), 1,
        (("sentiment_negative", "0.4"), ("renewal_proximity", "0.3"),
         ("sentiment_trend", "0.2"), ("complaint_activity", "0.1")),
        requires_risk_tier="critical,high", requires_signal="sentiment_negative",
    ),
    Action(
        "ACT-002", "renewal_reminder", "Proactive Renewal Reminder",
        "Proactively discuss the upcoming renewal, review current coverage, confirm pricing, and address any "
        "concerns before the renewal date.",
        "retention", Decimal("0.90"), 2,
        (("renewal_proximity", "0.6"), ("sentiment_negative", "0.2"), ("tier_low_or_medium", "0.2")),
        requires_signal="renewal_proximity",
    ),
    Action(
        "ACT-003", "complaint_followup", "Complaint Follow-Up",
        "Acknowledge the specific complaint, provide a status update, outline next steps with a clear timeline, "
        "and confirm a named point of contact for resolution.",
        "service", Decimal("0.85"), 3,
        (("complaint_activity", "0.5"), ("sentiment_negative", "0.3"), ("engagement_drop", "0.2")),
        requires_risk_tier="critical,high,medium", requires_signal="complaint_activity",
    ),
    Action(
        "ACT-004", "claim_escalation", "Claim Process Escalation",
        "Escalate the open claim to a senior adjuster, provide the customer with a direct reference number, and "
        "set expectations for the next update within 2 business days.",
        "service", Decimal("0.70"), 4,
        (("claim_activity", "0.6"), ("complaint_activity", "0.2"), ("sentiment_negative", "0.2")),
        requires_risk_tier="critical,high", requires_signal="claim_activity",
    ),
    Action(
        "ACT-005", "billing_assistance", "Billing Assistance",
        "Review current payment status, explain any outstanding balance or recent changes, and offer available "
        "payment arrangement options if the customer is experiencing difficulty.",
        "service", Decimal("0.80"), 5,
        (("payment_risk", "0.7"), ("sentiment_negative", "0.2"), ("complaint_activity", "0.1")),
        requires_signal="payment_risk",
    ),
    Action(
        "ACT-006", "cross_sell_home", "Cross-Sell: Home Insurance",
        "Based on the customer's existing auto policy and property ownership indicators, discuss available "
        "homeowners insurance options and potential multi-policy discount.",
        "sales", Decimal("0.60"), 6,
        (("cross_sell_opportunity", "0.5"), ("tier_low", "0.3"), ("renewal_proximity", "0.2")),
        eligible_products="auto", requires_risk_tier="low,medium", requires_signal="cross_sell_opportunity",
    ),
    Action(
        "ACT-007", "cross_sell_umbrella", "Cross-Sell: Umbrella Policy",
        "Given the customer's multi-policy relationship, discuss umbrella liability coverage that extends "
        "protection across existing auto and home policies.",
        "sales", Decimal("0.55"), 7,
        (("cross_sell_opportunity", "0.5"), ("tier_low", "0.3"), ("multi_policy", "0.2")),
        eligible_products="auto,home", requires_risk_tier="low,medium", requires_signal="cross_sell_opportunity",
    ),
    Action(
        "ACT-008", "no_action", "No Proactive Action Required",
        "Customer profile shows no elevated risk signals. Handle the current inquiry normally. No proactive "
        "retention or sales action recommended at this time.",
        "administrative", Decimal("1.00"), 8,
        (("always", "0.1"), ("tier_low", "0.7")),
        requires_risk_tier="low",
    ),
)

# Product x action pairs that are never offered (optional rule table).
PRODUCT_ACTION_EXCLUSIONS = (
    ("renters", "retention_outreach", "Low-premium product; a loyalty adjustment is not cost-effective"),
    ("umbrella", "billing_assistance", "Always paid annually; no instalment option"),
)

# Closed output sets of text enrichment and their safe defaults.
TOPICS = ("billing", "claims", "coverage", "service", "cancellation", "general")
INTENTS = ("complaint", "inquiry", "request", "praise", "escalation")
URGENCIES = ("critical", "high", "medium", "low")
DEFAULT_TOPIC, DEFAULT_INTENT = "general", "inquiry"

# Text patterns that mark an escalation (SQL LIKE, on lower-cased text).
ESCALATION_PATTERNS = (
    "%escalat%",
    "%speak to a manager%",
    "%speak to a supervisor%",
    "%cancel%my%policy%",
    "%switch%provider%",
    "%consider other options%",
    "%have to consider%",
)


@dataclass(frozen=True)
class TextRules:
    """Lexicon and keyword rules of the built-in scorer. First matching rule wins."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    topics: tuple[tuple[str, tuple[str, ...]], ...]
    intents: tuple[tuple[str, tuple[str, ...]], ...]
    urgencies: tuple[tuple[str, tuple[str, ...]], ...]
    default_urgency: str = "low"
    escalation_patterns: tuple[str, ...] = ESCALATION_PATTERNS
    model_name: str = "lexicon-sentiment + keyword-extraction"


DEFAULT_RULES = TextRules(
    positive=("thank", "thanks", "great", "excellent", "helpful", "happy", "pleased", "appreciate", "quick",
              "resolved", "satisfied", "wonderful", "perfect", "good", "easy", "love"),
    negative=("frustrated", "frustrating", "unacceptable", "disappointed", "angry", "terrible", "horrible",
              "worst", "upset", "furious", "ridiculous", "annoyed", "dissatisfied", "unhappy", "poor",
              "delay", "delayed", "complaint", "problem", "issue", "cancel"),
    topics=(
        ("cancellation", ("cancel", "cancellation", "terminate")),
        ("claims", ("claim", "claims", "adjuster", "accident")),
        ("billing", ("bill", "billing", "payment", "premium", "charge", "invoice")),
        ("coverage", ("coverage", "covered", "deductible", "limit")),
        ("service", ("service", "representative", "agent", "wait")),
    ),
    intents=(
        ("escalation", ("escalate", "supervisor", "manager")),
        ("complaint", ("complaint", "frustrated", "unacceptable", "disappointed", "unhappy")),
        ("praise", ("thank", "thanks", "excellent", "appreciate")),
        ("request", ("please", "need", "send", "update", "change")),
    ),
    urgencies=(
        ("critical", ("cancel", "lawyer", "regulator")),
        ("high", ("frustrated", "unacceptable", "urgent", "immediately")),
        ("medium", ("soon", "request", "need", "update")),
    ),
)

# Words and phrases whose presence marks a negative tone.
NEGATIVE_TONE = (
    "frustrated", "unacceptable", "disappointed", "angry", "terrible", "horrible", "worst", "upset", "furious",
    "ridiculous", "annoyed", "dissatisfied", "nobody can explain", "went up", "not helpful", "unhappy", "poor",
    "concern", "issue", "problem",
)

# Patterns that betray a credential, and shapes of personal data.
SECRET_PATTERNS = (
    r"password\s*=",
    r"api_key\s*=",
    r"secret\s*=",
    r"token\s*=",
    r"BEGIN PRIVATE KEY",
    r"AccountKey=",
    r"AKIA[0-9A-Z]{16}",
)
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
SAFE_EMAIL_SUFFIX, SAFE_PHONE_PREFIX = "@example.com", "555-"

# Columns a raw table must not carry.
FORBIDDEN_RAW_COLUMNS = frozenset(
    {"sentiment_score", "sentiment_label", "enrichment_status", "risk_score", "recommendation", "action_type"}
)


@dataclass(frozen=True)
class Settings:
    """Everything a full build needs besides its input tables."""

    clock: Clock
    rules: TextRules = DEFAULT_RULES
    actions: tuple[Action, ...] = ACTIONS
    weights: dict = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
    max_actions: int = 4
