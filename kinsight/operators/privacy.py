"""Role-shaped views of the data: masking, column policies, retention and erasure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT_MASK = "[TRANSCRIPT MASKED — Tier 2 access required]"


def _initial(name: str) -> Column:
    return F.concat(F.left(name, F.lit(1)), F.lit("."))


# How each personal column looks to a role that must not see it.
MASKS = {
    "first_name": lambda: _initial("first_name"),
    "last_name": lambda: _initial("last_name"),
    "email": lambda: F.when(F.col("email").isNotNull(), F.concat(
        F.left("email", F.lit(1)), F.lit("***@***."), F.element_at(F.split("email", r"\."), -1))),
    "phone": lambda: F.when(F.col("phone").isNotNull(), F.concat(F.lit("***-***-"), F.right("phone", F.lit(4)))),
    "date_of_birth": lambda: F.lit(None).cast("date"),
    "raw_text": lambda: F.when(F.col("raw_text").isNotNull(), F.lit(TRANSCRIPT_MASK)),
}
MASKED_ROLES = ("auditor",)

# Which role reads which layer.
LAYER_ACCESS = {
    "data_engineer": ("raw", "analytics"),
    "service_app": ("analytics", "decision"),
    "auditor": ("analytics", "decision"),
    "admin": ("decision",),
}
# columns that never leave the landing layer, whatever the role
RAW_ONLY = ("_row_hash", "_source_file", "_batch_id", "_loaded_at")


def mask_for_role(df: DataFrame, role: str) -> DataFrame:
    if role not in MASKED_ROLES:
        return df
    return df.select(*[MASKS[c]().alias(c) if c in MASKS else F.col(c) for c in df.columns])


def project_for_role(df: DataFrame, role: str, layer: str) -> DataFrame:
    """Allowed columns for a role in a layer, masked where required. No access is an error, not an empty result."""
    if layer not in LAYER_ACCESS[role]:
        raise PermissionError(f"role {role!r} has no access to layer {layer!r}")
    hidden = () if layer == "raw" else RAW_ONLY
    return mask_for_role(df.select(*[c for c in df.columns if c not in hidden]), role)


def policy_violations(spark: SparkSession, exposed: dict[str, tuple[str, list[str]]], role: str) -> DataFrame:
    """Tables and columns exposed to ``role`` against the policy: {table: (layer, columns)} -> violating columns."""
    bad = [
        (table, column, "layer" if layer not in LAYER_ACCESS[role] else "column")
        for table, (layer, columns) in exposed.items()
        for column in columns
        if layer not in LAYER_ACCESS[role] or (layer != "raw" and column in RAW_ONLY)
    ]
    return spark.createDataFrame(bad, "table_name string, column_name string, reason string")


def retention_filter(
    df: DataFrame, moment: str, as_of: date | Column, keep_days: int, erased: DataFrame | None = None,
    subject: str = "customer_id",
) -> DataFrame:
    """Rows young enough to keep, without the subjects on the erase list."""
    start = F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of), keep_days)
    kept = df.filter(F.to_date(moment) >= start)
    return kept if erased is None else kept.join(erased.select(subject), subject, "left_anti")
