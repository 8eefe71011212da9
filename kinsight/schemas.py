"""Declared landing schemas, enumerations and key relations of the logical model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DateType(), T.LongType()
_NTZ, _MONEY = T.TimestampNTZType(), T.DecimalType(12, 2)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2) for f in fields])


_OPT = True

SCHEMAS: dict[str, T.StructType] = {
    "service_representatives": _schema(
        ("representative_id", _S), ("name", _S), ("role", _S), ("active", _S), ("team", _S, _OPT)
    ),
    "customers": _schema(
        ("customer_id", _S), ("household_id", _S), ("first_name", _S), ("last_name", _S),
        ("customer_since", _D), ("status", _S), ("date_of_birth", _D, _OPT), ("email", _S, _OPT),
        ("phone", _S, _OPT), ("address_line_1", _S), ("city", _S), ("state", _S), ("postal_code", _S),
    ),
    "policies": _schema(
        ("policy_id", _S), ("customer_id", _S), ("product_type", _S), ("status", _S),
        ("effective_date", _D), ("expiration_date", _D), ("premium_amount", _MONEY),
        ("payment_frequency", _S), ("bound_date", _D, _OPT),
    ),
    "coverages": _schema(
        ("coverage_id", _S), ("policy_id", _S), ("coverage_type", _S),
        ("limit_amount", _MONEY), ("deductible_amount", _MONEY),
    ),
    "claims": _schema(
        ("claim_id", _S), ("policy_id", _S), ("customer_id", _S), ("filed_date", _D), ("status", _S),
        ("loss_date", _D), ("loss_type", _S), ("reserve_amount", _MONEY, _OPT),
        ("paid_amount", _MONEY, _OPT), ("closed_date", _D, _OPT),
    ),
    "payments": _schema(
        ("payment_id", _S), ("customer_id", _S), ("policy_id", _S), ("due_date", _D), ("amount", _MONEY),
        ("status", _S), ("paid_date", _D, _OPT), ("amount_paid", _MONEY, _OPT),
    ),
    "interactions": _schema(
        ("interaction_id", _S), ("customer_id", _S), ("channel", _S), ("direction", _S),
        ("disposition", _S), ("interaction_date", _NTZ), ("duration_seconds", _L, _OPT),
        ("representative_id", _S, _OPT),
    ),
    "transcripts": _schema(
        ("transcript_id", _S), ("interaction_id", _S), ("content_type", _S), ("raw_text", _S),
        ("word_count", _L), ("recording_consent_flag", _S),
    ),
    "documents": _schema(
        ("doc_id", _S), ("customer_id", _S, _OPT), ("policy_id", _S, _OPT), ("interaction_id", _S, _OPT),
        ("doc_type", _S), ("title", _S), ("content", _S), ("created_at", _NTZ),
    ),
}

AUDIT_COLUMNS = ("_loaded_at", "_source_file", "_batch_id", "_row_hash")

PRIMARY_KEYS = {
    "customers": "customer_id", "policies": "policy_id", "coverages": "coverage_id",
    "claims": "claim_id", "payments": "payment_id", "interactions": "interaction_id",
    "transcripts": "transcript_id", "service_representatives": "representative_id",
}

# child table, child column, parent table, parent column
FOREIGN_KEYS = (
    ("policies", "customer_id", "customers", "customer_id"),
    ("coverages", "policy_id", "policies", "policy_id"),
    ("claims", "policy_id", "policies", "policy_id"),
    ("claims", "customer_id", "customers", "customer_id"),
    ("payments", "customer_id", "customers", "customer_id"),
    ("payments", "policy_id", "policies", "policy_id"),
    ("interactions", "customer_id", "customers", "customer_id"),
    ("interactions", "representative_id", "service_representatives", "representative_id"),
    ("transcripts", "interaction_id", "interactions", "interaction_id"),
)

# Closed enumerations of the source contract.
ENUMS = {
    ("customers", "status"): ("active", "inactive", "prospect"),
    ("policies", "product_type"): ("auto", "home", "umbrella", "renters"),
    ("policies", "status"): ("quoted", "bound", "active", "renewed", "lapsed", "cancelled"),
    ("policies", "payment_frequency"): ("monthly", "quarterly", "semi_annual", "annual"),
    ("payments", "status"): ("on_time", "late", "grace_period", "missed", "pending"),
    ("claims", "status"): ("filed", "under_review", "settled", "denied", "withdrawn"),
    ("interactions", "channel"): ("phone", "email", "chat"),
    ("interactions", "direction"): ("inbound", "outbound", "internal_note"),
    ("interactions", "disposition"): ("inquiry", "complaint", "request", "notification", "general"),
    ("transcripts", "content_type"): ("call_transcript", "email_body", "agent_note"),
    ("service_representatives", "role"): ("service_rep", "retention_specialist", "supervisor"),
}
