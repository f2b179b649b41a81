"""Null profiles, record status, missing fields, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a profile, and the ones that every successful one should have.
CORE_FIELDS = (
    "name", "title", "completion_rate", "ontime_delivery_rate", "rehire_rate", "communication_success_rate", "total_completed_projects", "avg_response_time_raw", "registration_date", "last_active", "skills")
EMPLOYER_FIELDS = ("employment_rate", "received_projects", "financial_deals")
OPTIONAL_FIELDS = ("active_projects", "portfolio_count", *EMPLOYER_FIELDS)
KEY_FIELDS = ("title", "location", "completion_rate", "rehire_rate", "response_time", "last_seen", "member_since")


def status(confidence: Column, name: Column) -> Column:
    """fetch_failed, blocked, parse_miss or ok; an absent confidence counts as ok."""
    known = F.coalesce(confidence, F.lit("ok"))
    return F.when(known == "no_html", "fetch_failed").when(known == "blocked", "blocked").when(F.coalesce(name, F.lit("")) == "", "parse_miss").otherwise("ok")


def is_empty(field: str, kind: str) -> Column:
    """Null; for lists also an empty one."""
    c = F.col(field)
    return c.isNull() | (F.size(c) == 0) if kind.startswith("array") else c.isNull()


def is_falsy(field: str, kind: str) -> Column:
    """Null, empty text or list, zero or false."""
    c = F.col(field)
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    if kind == "string":
        return F.coalesce(c, F.lit("")) == ""
    if kind in ("date", "timestamp"):
        return c.isNull()
    return F.coalesce(c.cast("double"), F.lit(0.0)) == 0


def status_breakdown(records: DataFrame, column: str = "status") -> DataFrame:
    counts = records.groupBy(column).agg(F.count("*").alias("n"))
    total = records.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))  # total is one row


def null_profile(records: DataFrame, fields=None, column: str = "status") -> DataFrame:
    """(scope, field, nulls, rows, percent) over all rows and over those whose status is ok."""
    kinds = dict(records.dtypes)
    fields = [f for f in (fields or CORE_FIELDS + OPTIONAL_FIELDS) if f in kinds]
    sums = [F.count_if(is_empty(f, kinds[f])).alias(f"a_{f}") for f in fields] + [F.count_if(is_empty(f, kinds[f]) & (F.col(column) == "ok")).alias(f"o_{f}") for f in fields]
    one = records.agg(F.count("*").alias("n"), F.count_if(F.col(column) == "ok").alias("ok"), *sums)
    cells = [F.struct(F.lit("all").alias("scope"), F.lit(f).alias("field"), F.col(f"a_{f}").alias("nulls"), F.col("n").alias("rows")) for f in fields]
    cells += [F.struct(F.lit("ok").alias("scope"), F.lit(f).alias("field"), F.col(f"o_{f}").alias("nulls"), F.col("ok").alias("rows")) for f in fields]
    out = one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return out.withColumn("percent", F.when(F.col("rows") > 0, F.lit(100.0) * F.col("nulls") / F.col("rows")).otherwise(0.0))


def missing_fields(profiles: DataFrame, fields=KEY_FIELDS, lists=("skills",)) -> DataFrame:
    """Adds missing: how many of the fields are falsy."""
    kinds = dict(profiles.dtypes)
    total = sum((F.when(is_falsy(f, kinds[f]), 1).otherwise(0) for f in (*fields, *lists) if f in kinds), F.lit(0))
    return profiles.withColumn("missing", total)


def issue_kinds(issues: DataFrame, column: str = "issue") -> DataFrame:
    """Counts by what stands before the first colon."""
    return issues.groupBy(F.split_part(F.col(column), F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def unmapped_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Labels of pages that no field is known for."""
    return labels.join(F.broadcast(known.select("label").distinct()), "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))
