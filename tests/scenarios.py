"""Twelve hand-made customers, each with one shape the pipeline must recognise."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from kinsight.config import Clock, Settings, TextRules
from kinsight.schemas import SCHEMAS
from kinsight.sources.landing import nullable

NOW = datetime(2025, 6, 30, 12, 0, 0)
TODAY = NOW.date()
RULES = TextRules(
    positive=("great", "thanks"), negative=("angry", "awful"),
    topics=(("billing", ("bill",)), ("claims", ("claim",))),
    intents=(("complaint", ("angry",)), ("praise", ("thanks",))),
    urgencies=(("high", ("awful",)), ("low", ("great",))),
)
SETTINGS = Settings(clock=Clock(TODAY, NOW), rules=RULES)
BAD, GOOD = "I am angry. The bill is awful.", "Great call, thanks a lot!"


class Scenarios:
    """Logical tables with the interface of the test-table adapter."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = {name: [] for name in SCHEMAS}
        self._n = 0
        self.build()

    def customer(self, n, household=None):
        self.rows["customers"].append((
            f"C{n}", household or f"H{n}", "Ann", f"Lee{n}", date(2015, 1, 1), "active", date(1980, 1, 1),
            f"c{n}@example.com", None if n == 4 else f"555-{n:04d}", "1 Road", "Town", "TX", "00001"))

    def policy(self, n, days, product="auto", status="active"):
        self._n += 1
        ends = TODAY + timedelta(days=days)
        self.rows["policies"].append((f"P{self._n}", f"C{n}", product, status, ends - timedelta(days=365), ends, 1200,
                                      "monthly", None))
        return f"P{self._n}"

    def payments(self, n, **counts):
        for status, times in counts.items():
            for _ in range(times):
                self._n += 1
                paid = None if status == "missed" else TODAY
                self.rows["payments"].append((f"Y{self._n}", f"C{n}", "P1", TODAY, 100, status, paid, 100 if paid else None))

    def claim(self, n, status="filed"):
        self._n += 1
        self.rows["claims"].append((f"K{self._n}", "P1", f"C{n}", TODAY, status, TODAY, "fire", 500, None, None))

    def contact(self, n, days_ago, text=None, consent="TRUE", disposition="inquiry"):
        self._n += 1
        key = f"I{self._n}"
        self.rows["interactions"].append((key, f"C{n}", "phone", "inbound", disposition, NOW - timedelta(days=days_ago),
                                          60, None))
        if text:
            self.rows["transcripts"].append((f"T{self._n}", key, "call_transcript", text, len(text.split()), consent))
        return key

    def build(self):
        for n in range(1, 13):
            self.customer(n, "H11" if n in (10, 11) else None)
        self.policy(1, 16), self.policy(1, 100, "home"), self.payments(1, on_time=4)
        for days, text in ((10, BAD), (20, BAD), (100, GOOD), (120, GOOD)):
            self.contact(1, days, text, disposition="complaint" if text == BAD else "inquiry")
        self.policy(2, 22), self.claim(2), self.payments(2, on_time=3, late=1)
        self.contact(2, 5, BAD), self.contact(2, 6, BAD)
        self.policy(3, 12), self.policy(3, 200, "home"), self.contact(3, 5, GOOD)
        self.policy(4, 130), [self.contact(4, d, BAD) for d in (1, 2, 3)]
        self.policy(5, 20, "home"), self.contact(5, 150, GOOD)
        self.policy(6, 80), self.contact(6, 3, BAD), self.contact(6, 4)
        self.policy(7, 80), self.contact(7, 3, BAD, consent="FALSE"), self.contact(7, 4, BAD)
        self.policy(8, 45), self.payments(8, late=3, grace_period=1)
        self.policy(9, 22, "home"), self.contact(9, 15, BAD, disposition="complaint")
        self.policy(10, 60, "renters")
        self.policy(11, 28), self.policy(11, 90, "home"), self.policy(11, 90, "umbrella")
        self.policy(12, 12), self.payments(12, on_time=3, late=2)
        self.contact(12, 100, BAD), self.contact(12, 5, GOOD)
        for p in self.rows["policies"]:
            self.rows["coverages"].append((f"V{p[0]}", p[0], "liability", 1000, 100))
        self.rows["service_representatives"].append(("R1", "Rep", "service_rep", "TRUE", None))

    def table(self, name):
        from decimal import Decimal

        schema = nullable(SCHEMAS[name])
        money = [i for i, f in enumerate(schema.fields) if f.dataType.typeName() == "decimal"]
        rows = [tuple(Decimal(v) if i in money and v is not None else v for i, v in enumerate(r)) for r in self.rows[name]]
        return self.spark.createDataFrame(rows, schema)
