"""Maps the star-schema test tables onto the logical customer model.

Every mapping is a narrow projection except claims and payments, whose owner
lives on the parent order and therefore needs one join.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.config import Clock, Settings, TextRules

MONEY = "decimal(12,2)"

CLOCK = Clock(today=date(2001, 8, 1), now=datetime(2024, 1, 31), window_days=15)

# The test prose is invented, so its lexicon and keywords are words that occur in it.
RULES = TextRules(
    positive=("is", "was", "with"),
    negative=("for", "by", "on"),
    topics=(
        ("billing", ("thble",)),
        ("claims", ("erin",)),
        ("coverage", ("thor",)),
        ("service", ("anea",)),
        ("cancellation", ("thed",)),
    ),
    intents=(
        ("escalation", ("thnt",)),
        ("complaint", ("thha",)),
        ("praise", ("thhe",)),
        ("request", ("thes", "thre")),
    ),
    urgencies=(("critical", ("thon",)), ("high", ("ther",)), ("medium", ("than",))),
    default_urgency="unknown",
    escalation_patterns=("%eratsh%", "%thon%erin%thble%"),
)

SETTINGS = Settings(clock=CLOCK, rules=RULES)


class Testbed:
    """Lazy logical tables over one scale-factor directory."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str, clock: Clock = CLOCK):
        self.spark, self.sf_dir, self.clock = spark, sf_dir.rstrip("/"), clock
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """Table handle, opened once per table: opening reads the file footers."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def customers(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS customer_id",
            "CAST(c_nationkey AS BIGINT) AS household_id",
            "split_part(c_name, '#', 1) AS first_name",
            "split_part(c_name, '#', 2) AS last_name",
            "date_add(DATE '1990-01-01', CAST(c_custkey % 1800 AS INT)) AS customer_since",
            "CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status",
            "CASE WHEN c_acctbal >= 0 THEN date_add(DATE '1950-01-01', CAST(c_custkey % 18000 AS INT)) END "
            "AS date_of_birth",
            "CASE WHEN c_mktsegment != 'HOUSEHOLD' THEN concat('c', split_part(c_name, '#', 2), '@example.com') END "
            "AS email",
            "CASE WHEN c_acctbal >= 0 THEN concat('555-', split_part(c_name, '#', 2)) END AS phone",
            "c_name AS address_line_1",
            "concat('CITY ', CAST(c_nationkey AS STRING)) AS city",
            "c_mktsegment AS state",
            "split_part(c_name, '#', 2) AS postal_code",
        )

    def policies(self) -> DataFrame:
        return self.raw("orders").withColumn("_on", F.to_date("o_orderdate")).selectExpr(
            "o_orderkey AS policy_id",
            "o_custkey AS customer_id",
            "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'auto' WHEN '2' THEN 'home' WHEN '3' THEN 'umbrella' "
            "WHEN '4' THEN 'renters' ELSE 'other' END AS product_type",
            f"CASE WHEN o_orderstatus = 'O' AND _on >= date_sub(DATE '{self.clock.today}', 365) THEN 'active' "
            "WHEN o_orderstatus = 'O' THEN 'renewed' WHEN o_orderstatus = 'F' THEN 'lapsed' ELSE 'quoted' END AS status",
            "_on AS effective_date",
            "date_add(_on, 365) AS expiration_date",
            f"CAST(o_totalprice AS {MONEY}) AS premium_amount",
            "CASE o_orderkey % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'semi_annual' "
            "ELSE 'annual' END AS payment_frequency",
            "CASE WHEN o_orderstatus != 'P' THEN date_sub(_on, 7) END AS bound_date",
        )

    def coverages(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber) AS coverage_id",
            "l_orderkey AS policy_id",
            "concat(l_returnflag, l_linestatus) AS coverage_type",
            f"CAST(l_extendedprice AS {MONEY}) AS limit_amount",
            f"CAST(CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2)) AS {MONEY}) AS deductible_amount",
        )

    LINE_KEY = (
        "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyy-MM-dd'), "
        f"CAST(l_extendedprice AS {MONEY})))"
    )

    def claims(self) -> DataFrame:
        return (
            self.raw("lineitem").filter("l_returnflag IN ('R', 'A')")
            .withColumnRenamed("l_orderkey", "policy_id")
            .join(self._owners(), "policy_id")
            .withColumn("_kind", F.expr("CASE WHEN l_returnflag = 'A' THEN 'denied' WHEN l_linestatus = 'F' THEN "
                                        "'settled' ELSE 'filed' END"))
            .selectExpr(
                self.LINE_KEY.replace("l_orderkey", "policy_id") + " AS claim_id",
                "policy_id",
                "customer_id",
                "to_date(l_shipdate) AS filed_date",
                "_kind AS status",
                "date_sub(to_date(l_shipdate), 10) AS loss_date",
                "concat('loss_', lower(l_linestatus)) AS loss_type",
                f"CASE WHEN _kind != 'settled' THEN CAST(l_extendedprice AS {MONEY}) END AS reserve_amount",
                f"CASE WHEN _kind = 'settled' THEN CAST(CAST(l_extendedprice AS {MONEY}) "
                f"* (1 - CAST(l_discount AS DECIMAL(4,2))) AS {MONEY}) END AS paid_amount",
                "CASE WHEN _kind != 'filed' THEN date_add(to_date(l_shipdate), 30) END AS closed_date",
            )
        )

    def _owners(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS policy_id", "o_custkey AS customer_id", "to_date(o_orderdate) AS _ordered")

    def payments(self) -> DataFrame:
        return (
            self.raw("lineitem").filter("l_returnflag = 'N'")
            .withColumnRenamed("l_orderkey", "policy_id")
            .join(self._owners(), "policy_id")
            .withColumn("_due", F.expr("date_add(_ordered, 30)"))
            .withColumn("_late", F.expr("datediff(to_date(l_shipdate), _due)"))
            .withColumn("_kind", F.expr("CASE WHEN l_linestatus = 'O' AND _late > 365 THEN 'missed' WHEN _late <= 0 "
                                        "THEN 'on_time' WHEN _late <= 30 THEN 'grace_period' ELSE 'late' END"))
            .selectExpr(
                self.LINE_KEY.replace("l_orderkey", "policy_id") + " AS payment_id",
                "customer_id",
                "policy_id",
                "_due AS due_date",
                f"CAST(l_extendedprice AS {MONEY}) AS amount",
                "_kind AS status",
                "CASE WHEN _kind != 'missed' THEN to_date(l_shipdate) END AS paid_date",
                f"CASE WHEN _kind != 'missed' THEN CAST(l_extendedprice AS {MONEY}) END AS amount_paid",
            )
        )

    def interactions(self, events: DataFrame | None = None) -> DataFrame:
        return (self.raw("events") if events is None else events).selectExpr(
            "event_id AS interaction_id",
            "user_id AS customer_id",
            "CASE WHEN event_type IN ('click', 'view') THEN 'chat' WHEN event_type = 'signup' THEN 'email' "
            "ELSE 'phone' END AS channel",
            "CASE WHEN event_type = 'view' THEN 'outbound' ELSE 'inbound' END AS direction",
            "CASE event_type WHEN 'error' THEN 'complaint' WHEN 'click' THEN 'inquiry' WHEN 'signup' THEN 'request' "
            "WHEN 'view' THEN 'notification' ELSE 'general' END AS disposition",
            "CAST(ts AS TIMESTAMP_NTZ) AS interaction_date",
            "CAST(floor(value) AS BIGINT) AS duration_seconds",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS representative_id",
        )

    def transcripts(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS transcript_id",
            "doc_id * 10 AS interaction_id",
            "CASE lang WHEN 'en' THEN 'call_transcript' WHEN 'fr' THEN 'email_body' ELSE 'agent_note' END AS content_type",
            "text AS raw_text",
            "CAST(floor(n_chars / 6) AS BIGINT) AS word_count",
            "CASE WHEN source = 'src7' THEN 'FALSE' ELSE 'TRUE' END AS recording_consent_flag",
        )

    def service_representatives(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS representative_id",
            "s_name AS name",
            "CASE WHEN s_suppkey % 10 = 0 THEN 'supervisor' WHEN s_suppkey % 10 < 3 THEN 'retention_specialist' "
            "ELSE 'service_rep' END AS role",
            "CASE WHEN s_acctbal >= 0 THEN 'TRUE' ELSE 'FALSE' END AS active",
            "CASE WHEN s_nationkey % 5 != 0 THEN concat('team ', CAST(s_nationkey AS STRING)) END AS team",
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()
