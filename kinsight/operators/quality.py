"""Data-quality checks. Every check is a DataFrame of (check_name, status, detail) or a per-item report.

Counting checks reduce by key with map-side combine before any join, so a key
that dominates a table costs one row per input task, not one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.config import (
    FORBIDDEN_RAW_COLUMNS, NEGATIVE_TONE, SAFE_EMAIL_SUFFIX, SAFE_PHONE_PREFIX, SECRET_PATTERNS, SSN_PATTERN,
)
from kinsight.functions.numeric import count_if
from kinsight.functions.text import word_count
from kinsight.schemas import AUDIT_COLUMNS, ENUMS, FOREIGN_KEYS, PRIMARY_KEYS

Tables = dict[str, DataFrame]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def verdict(condition: Column) -> Column:
    return F.when(condition, "PASS").otherwise("FAIL")


def violations(name: str, df: DataFrame, what: str) -> DataFrame:
    """One row: how many rows ``df`` has, PASS when none."""
    return df.agg(F.count("*").alias("n")).select(
        F.lit(name).alias("check_name"), verdict(F.col("n") == 0).alias("status"),
        F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"),
    )


def _stack(df: DataFrame, names: dict[str, Column], label: str, value: str) -> DataFrame:
    """One-row aggregate to one row per entry of ``names``."""
    rows = F.array(*[F.struct(F.lit(k).alias(label), v.alias(value)) for k, v in names.items()])
    return df.select(F.explode(rows).alias("r")).select(f"r.{label}", f"r.{value}")


# --- counts, keys, references ----------------------------------------------------------------------------------


def row_counts(tables: Tables, expected: DataFrame) -> DataFrame:
    """Actual against manifest row counts; ``expected`` holds (table_name, expected_rows)."""
    counts = union([
        df.agg(F.count("*").alias("actual_rows")).select(F.lit(name).alias("table_name"), "actual_rows")
        for name, df in tables.items()
    ])
    return counted(counts, expected)


def counted(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(table_name, actual_rows) against (table_name, expected_rows), wherever the counts come from."""
    return counts.join(expected, "table_name", "left").select(
        "table_name", "actual_rows", "expected_rows",
        verdict(F.col("actual_rows").eqNullSafe(F.col("expected_rows"))).alias("status"),
    )


def primary_keys(tables: Tables, keys: dict[str, str] = PRIMARY_KEYS) -> DataFrame:
    """Rows, distinct keys and surplus rows per table (NULL keys count as surplus)."""
    def one(name: str, key: str) -> DataFrame:
        per_key = tables[name].groupBy(key).agg(F.count("*").alias("n"))
        return per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(key).alias("distinct_keys")
        ).select(F.lit(name).alias("table_name"), "row_count", "distinct_keys")

    return union([one(n, k) for n, k in keys.items() if n in tables]).withColumn(
        "duplicates", F.col("row_count") - F.col("distinct_keys")
    ).withColumn("status", verdict(F.col("duplicates") == 0))


def foreign_keys(tables: Tables, relations=FOREIGN_KEYS, nullable: tuple[str, ...] = ("representative_id",)) -> DataFrame:
    """Child rows without a parent, per relation. NULL is an orphan unless the column is nullable."""
    def one(child: str, column: str, parent: str, parent_key: str) -> DataFrame:
        per_key = tables[child].groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
        if column in nullable:
            per_key = per_key.filter(F.col("k").isNotNull())
        parents = tables[parent].select(F.col(parent_key).alias("k"))
        return per_key.join(parents, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(f"{child}.{column} -> {parent}").alias("relation"), "orphans"
        )

    frames = [one(*r) for r in relations if r[0] in tables and r[2] in tables]
    return union(frames).withColumn("status", verdict(F.col("orphans") == 0))


def ownership(tables: Tables, children: tuple[str, ...] = ("claims", "payments")) -> DataFrame:
    """Claims and payments whose customer is not the owner of their policy."""
    owner = tables["policies"].select("policy_id", F.col("customer_id").alias("owner_id"))

    def one(child: str) -> DataFrame:
        pairs = tables[child].groupBy("policy_id", "customer_id").agg(F.count("*").alias("n"))
        wrong = pairs.join(owner, "policy_id").filter(F.col("customer_id") != F.col("owner_id"))
        return wrong.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mismatches")).select(
            F.lit(child).alias("table_name"), "mismatches"
        )

    return union([one(c) for c in children]).withColumn("status", verdict(F.col("mismatches") == 0))


def one_to_one(df: DataFrame, key: str, name: str) -> DataFrame:
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return violations(name, repeated, f"{key} values with more than one row")


def required_child(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    return violations(name, parents.join(children.select(key), key, "left_anti"), f"{key} values without a child row")


def date_order(policies: DataFrame) -> DataFrame:
    bad = policies.filter(F.col("effective_date") >= F.col("expiration_date"))
    return violations("policy_dates", bad, "policies with effective_date >= expiration_date")


def positive_amount(payments: DataFrame) -> DataFrame:
    return violations("payment_amounts", payments.filter(F.col("amount") <= 0), "payments with amount <= 0")


def enums(tables: Tables, allowed=ENUMS) -> DataFrame:
    """Values outside their closed set, one scan per table."""
    by_table: dict[str, dict[str, tuple]] = {}
    for (table, column), values in allowed.items():
        if table in tables:
            by_table.setdefault(table, {})[column] = values
    frames = []
    for table, columns in by_table.items():
        counted = tables[table].agg(*[count_if(~F.col(c).isin(*v)).alias(c) for c, v in columns.items()])
        frames.append(_stack(counted, {f"{table}.{c}": F.col(c) for c in columns}, "column_name", "violations"))
    return union(frames).withColumn("status", verdict(F.col("violations") == 0))


def consent(transcripts: DataFrame) -> DataFrame:
    flag = F.col("recording_consent_flag")
    bad = transcripts.filter(flag.isNull() | ~flag.isin("TRUE", "FALSE"))
    return violations("consent_flag", bad, "transcripts with invalid or missing consent flag")


def audit_columns(tables: Tables) -> DataFrame:
    def one(name: str, df: DataFrame) -> DataFrame:
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in AUDIT_COLUMNS])
        return df.agg(count_if(missing).alias("null_rows")).select(F.lit(name).alias("table_name"), "null_rows")

    return union([one(n, d) for n, d in tables.items()]).withColumn("status", verdict(F.col("null_rows") == 0))


def batch_consistency(tables: Tables) -> DataFrame:
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.groupBy("_batch_id").agg(F.count("*").alias("n")).agg(
            F.count("_batch_id").alias("distinct_batches")
        ).select(F.lit(name).alias("table_name"), "distinct_batches")

    return union([one(n, d) for n, d in tables.items()]).withColumn("status", verdict(F.col("distinct_batches") == 1))


def rejects(loaded: Tables) -> DataFrame:
    """Rows and rejected rows per leniently loaded table (``_corrupt_record`` marks a reject)."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(
            F.count("*").alias("loaded_rows"), count_if(F.col("_corrupt_record").isNotNull()).alias("rejected_rows")
        ).select(F.lit(name).alias("table_name"), "loaded_rows", "rejected_rows")

    return union([one(n, d) for n, d in loaded.items()]).withColumn("status", verdict(F.col("rejected_rows") == 0))


def golden_graph(
    tables: Tables, subjects: DataFrame | None = None, policies: int = 2, contacts: int = 4, texts: int = 4
) -> DataFrame:
    """Is the record graph of a customer complete end to end?

    ``subjects`` (customer_id) are the customers to vouch for; by default all of
    them. One row per customer.
    """
    wanted = subjects if subjects is not None else tables["customers"].select("customer_id")
    known = tables["customers"].select("customer_id").withColumn("_known", F.lit(True))
    held = tables["policies"].groupBy("customer_id").agg(count_if(F.col("status") == "active").alias("policies"))
    contact = tables["interactions"].select("interaction_id", "customer_id")
    spoken = tables["transcripts"].select("interaction_id", "recording_consent_flag")
    per = contact.join(spoken, "interaction_id", "left").groupBy("customer_id").agg(
        F.count("*").alias("interactions"),
        F.count("recording_consent_flag").alias("transcripts"),
        count_if(F.col("recording_consent_flag") != "TRUE").alias("_refused"),
    )
    row = wanted.join(known, "customer_id", "left").join(held, "customer_id", "left").join(per, "customer_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("policies", "interactions", "transcripts", "_refused")}
    exists, consented = F.coalesce("_known", F.lit(False)), zero["_refused"] == 0
    return row.select(
        "customer_id", exists.alias("customer_exists"), zero["policies"].alias("active_policies"),
        zero["interactions"].alias("interactions"), zero["transcripts"].alias("transcripts"),
        consented.alias("all_consent"),
        verdict(exists & (zero["policies"] == policies) & (zero["interactions"] >= contacts)
                & (zero["transcripts"] >= texts) & consented).alias("status"),
    )


def required_ids(df: DataFrame, required: DataFrame, key: str, name: str) -> DataFrame:
    """Are all required ids present?"""
    wanted = required.select(key).distinct()
    hit = df.select(key).distinct().withColumn("_hit", F.lit(1))
    return wanted.join(hit, key, "left").agg(F.count("*").alias("n"), F.count("_hit").alias("found")).select(
        F.lit(name).alias("check_name"), verdict(F.col("n") == F.col("found")).alias("status"),
        F.concat(F.col("found").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(f" {key} values found"))
        .alias("detail"),
    )


# --- text ------------------------------------------------------------------------------------------------------


def word_counts(transcripts: DataFrame, tolerance: int = 2) -> DataFrame:
    actual = word_count(F.col("raw_text"))
    bad = transcripts.filter(F.abs(actual - F.col("word_count")) > tolerance)
    return violations("word_count", bad, f"transcripts off by more than {tolerance} words")


def secrets(df: DataFrame, text: str, patterns=SECRET_PATTERNS) -> DataFrame:
    """Texts matching each credential pattern (case-insensitive), in one scan."""
    counted = df.agg(*[count_if(F.col(text).rlike(f"(?i){p}")).alias(f"p{i}") for i, p in enumerate(patterns)])
    return _stack(counted, {p: F.col(f"p{i}") for i, p in enumerate(patterns)}, "pattern", "matches").withColumn(
        "status", verdict(F.col("matches") == 0)
    )


def pii(customers: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Contact data outside the reserved test ranges, and social-security-shaped numbers in texts."""
    contact = customers.agg(
        count_if(~F.col("email").endswith(SAFE_EMAIL_SUFFIX)).alias("email"),
        count_if(~F.col("phone").startswith(SAFE_PHONE_PREFIX)).alias("phone"),
    )
    numbers = texts.agg(count_if(F.col(text).rlike(SSN_PATTERN)).alias("ssn"))
    found = _stack(contact, {"email_domain": F.col("email"), "phone_prefix": F.col("phone")}, "check_name", "violations")
    return found.unionByName(_stack(numbers, {"ssn_pattern": F.col("ssn")}, "check_name", "violations")).withColumn(
        "status", verdict(F.col("violations") == 0)
    )


def negative_tone(transcripts: DataFrame, words=NEGATIVE_TONE) -> DataFrame:
    """How many texts carry a negative word or phrase, per content type."""
    text = F.lower("raw_text")
    hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return transcripts.groupBy("content_type").agg(
        F.count("*").alias("transcripts"), count_if(hit).alias("negative_transcripts")
    )


def forbidden_columns(df: DataFrame, forbidden=FORBIDDEN_RAW_COLUMNS) -> set[str]:
    return {c.lower().strip() for c in df.columns} & set(forbidden)


# --- rules -----------------------------------------------------------------------------------------------------


def conditional_rules(now: Column) -> dict[str, dict[str, Column]]:
    """Per table, the condition each row must satisfy. NULL (not applicable) passes."""
    paid, due, status = F.col("paid_date"), F.col("due_date"), F.col("status")
    phone = F.col("channel") == "phone"
    return {
        "policies": {
            "effective before expiration": F.col("effective_date") < F.col("expiration_date"),
            "premium positive": F.col("premium_amount") > 0,
        },
        "coverages": {
            "limit positive": F.col("limit_amount") > 0,
            "deductible not negative": F.col("deductible_amount") >= 0,
        },
        "claims": {
            "loss not after filing": F.col("loss_date") <= F.col("filed_date"),
            "closed after filing": F.col("closed_date") > F.col("filed_date"),
            "reserve positive": F.col("reserve_amount") > 0,
            "paid not negative": F.col("paid_amount") >= 0,
        },
        "payments": {
            "amount positive": F.col("amount") > 0,
            "late paid after due": (status != "late") | (paid >= due),
            "on time paid by due": (status != "on_time") | (paid <= due),
            "missed or pending has no paid date": ~status.isin("missed", "pending") | paid.isNull(),
            "no amount without paid date": paid.isNotNull() | F.col("amount_paid").isNull(),
        },
        "interactions": {
            "not in the future": F.col("interaction_date") <= now,
            "phone duration positive": ~phone | (F.col("duration_seconds") > 0),
            "duration only on phone": phone | F.col("duration_seconds").isNull(),
        },
        "transcripts": {
            "text not empty": F.trim("raw_text") != "",
            "word count positive": F.col("word_count") > 0,
        },
    }


def check_conditional_rules(tables: Tables, now: Column) -> DataFrame:
    frames = []
    for table, rules in conditional_rules(now).items():
        if table not in tables:
            continue
        counted = tables[table].agg(*[count_if(~rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])
        named = {f"{table}: {name}": F.col(f"r{i}") for i, name in enumerate(rules)}
        frames.append(_stack(counted, named, "rule", "violations"))
    return union(frames).withColumn("status", verdict(F.col("violations") == 0))


def channel_content(transcripts: DataFrame, interactions: DataFrame) -> DataFrame:
    """Content types that disagree with the channel of their interaction (agent notes fit any channel)."""
    pairs = transcripts.select("interaction_id", "content_type").join(
        interactions.select("interaction_id", "channel"), "interaction_id"
    ).groupBy("content_type", "channel").agg(F.count("*").alias("n"))
    wanted = F.when(F.col("content_type") == "call_transcript", "phone").when(
        F.col("content_type") == "email_body", "email")
    return pairs.withColumn("expected_channel", wanted).withColumn(
        "mismatches", F.when(F.col("expected_channel") != F.col("channel"), F.col("n")).otherwise(F.lit(0))
    ).withColumn("status", verdict(F.col("mismatches") == 0)).select(
        "content_type", "channel", F.col("n").alias("rows"), "mismatches", "status"
    )


def at_least_one(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.agg(count_if(condition).alias("n")).select(
        F.lit(name).alias("check_name"), verdict(F.col("n") >= 1).alias("status"),
        F.concat(F.col("n").cast("string"), F.lit(" matching rows")).alias("detail"),
    )


def quarantine(payments: DataFrame, customers: DataFrame, policies: DataFrame) -> DataFrame:
    """Payments with the rules they break: hard ones send a row aside, soft ones only flag it.

    Parents are joined as key-only sides, so a payment is tested against both in
    one pass each.
    """
    owner = customers.select("customer_id").withColumn("_customer", F.lit(True))
    policy = policies.select("policy_id").withColumn("_policy", F.lit(True))
    joined = payments.join(owner, "customer_id", "left").join(policy, "policy_id", "left")
    hard = F.array_compact(F.array(
        F.when(F.col("_customer").isNull(), "DQ1_customer_missing"),
        F.when(F.col("_policy").isNull(), "DQ2_policy_missing"),
        F.when(F.col("amount") <= 0, "DQ11_amount_not_positive"),
    ))
    soft = F.array_compact(F.array(
        F.when((F.col("status") == "on_time") & (F.col("paid_date") > F.col("due_date")), "on_time_paid_late"),
        F.when((F.col("status") == "missed") & F.col("paid_date").isNotNull(), "missed_but_paid"),
        F.when(F.datediff("paid_date", "due_date") < -180, "paid_long_before_due"),
    ))
    return joined.select(*payments.columns, hard.alias("_violations"), soft.alias("_warnings")).withColumn(
        "_quarantined", F.size("_violations") > 0
    )


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(~F.col("_quarantined")), checked.filter("_quarantined")


def freshness(df: DataFrame, event_time: str, loaded: str, processed: str, lag_seconds: int) -> DataFrame:
    """Temporal order (event <= load <= processing) and lag against the freshness objective."""
    lag = F.timestamp_diff("SECOND", F.col(event_time), F.col(processed))
    return df.agg(
        count_if(F.col(loaded) < F.col(event_time)).alias("loaded_before_event"),
        count_if(F.col(processed) < F.col(loaded)).alias("processed_before_load"),
        count_if(lag > lag_seconds).alias("stale_rows"),
        F.max(lag).alias("max_lag_seconds"),
    ).withColumn("status", F.when(
        (F.col("loaded_before_event") == 0) & (F.col("processed_before_load") == 0) & (F.col("stale_rows") == 0), "PASS"
    ).otherwise("WARN"))


def labels_to_long(labels: DataFrame, key: str = "customer_id") -> DataFrame:
    """Wide labels to (key, signal_name, actual_value)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("signal_name"), F.col(c).cast("string").alias("actual_value"))
        for c in labels.columns if c != key
    ])
    return labels.select(key, F.explode(pairs).alias("p")).select(key, "p.signal_name", "p.actual_value")


def compare_expectations(expected: DataFrame, actual: DataFrame, key: str = "customer_id") -> DataFrame:
    """Long-format expectations (key, signal_name, expected_value) against actual labels."""
    return expected.join(actual, [key, "signal_name"], "left").withColumn(
        "status", verdict(F.col("expected_value").eqNullSafe(F.col("actual_value")))
    )
