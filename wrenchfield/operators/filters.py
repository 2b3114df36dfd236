"""Predicates and projections. "Today", the user and all limits are parameters."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "__batch_import_placeholder__"


def low_confidence(c: Column, limit: float = 0.9) -> Column:
    """NULL is not low."""
    return c.isNotNull() & (c < limit)


def needs_attention(status: Column, c: Column, statuses: list[str], limit: float = 0.9) -> Column:
    """NULL counts as low here."""
    return status.isin(statuses) | c.isNull() | (c < limit)


def ilike_any(q: str, *cs: Column) -> Column:
    """Wildcards of the query stay wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{q}%"), F.lit(False)) for c in cs])


def day_range(c: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """start <= c < end + 1 day; a missing bound is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start))
    if end is not None:
        out = out & (c < F.lit(end + dt.timedelta(days=1)))
    return out


def valid_at(day: dt.date, starts: str = "starts_at", ends: str = "ends_at") -> Column:
    """Both ends included; a missing end is open."""
    return (F.col(starts) <= F.lit(day)) & (F.col(ends).isNull() | (F.col(ends) >= F.lit(day)))


def visible_repairs(repairs: DataFrame, assignments: DataFrame, vehicles: DataFrame, user_id: int, day: dt.date, admin: bool = False, own: bool = True) -> DataFrame:
    """Administrators see all; others the repairs of vehicles assigned to them that day, and (own) those that they made on the placeholder vehicle."""
    if admin:
        return repairs
    mine = assignments.where((F.col("user_id") == user_id) & valid_at(day)).select(F.col("vehicle_id").alias("_v")).distinct().withColumn("_mine", F.lit(True))
    seen = repairs.join(mine, repairs["vehicle_id"] == mine["_v"], "left")
    if not own:
        return seen.where("_mine").drop("_v", "_mine")
    stand_in = vehicles.where(F.col("external_id") == PLACEHOLDER).select(F.col("id").alias("_p")).withColumn("_open", F.lit(True))
    seen = seen.join(F.broadcast(stand_in), seen["vehicle_id"] == stand_in["_p"], "left")  # one row at most
    return seen.where(F.col("_mine") | (F.col("_open") & (F.col("created_by_user_id") == user_id))).drop("_v", "_mine", "_p", "_open")


def filtered(df: DataFrame, *tests: Column | None) -> DataFrame:
    """All tests that are given, for the page, its count and its facets alike."""
    return df.where(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True)))


def status_or_default(c: Column, wanted: str | None, hidden: str) -> Column:
    return c == wanted if wanted else c != hidden


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def is_historical(reason: Column) -> Column:
    return F.coalesce(reason.startswith("historical_import:"), F.lit(False))


def matched_by(q: str, **fields: Column) -> Column:
    """Names of the fields that hold the query, in the order given."""
    q = q.lower()
    return F.filter(F.array(*[F.when(F.contains(F.lower(c), F.lit(q)), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())


def queue_admission(documents: DataFrame, repairs: DataFrame, checks: DataFrame, document_statuses: list[str], repair_statuses: list[str]) -> DataFrame:
    """Orders and repeat scans that aren't archived and need work: by status, by partial recognition, or by an open check."""
    open_ = checks.where(~F.col("is_resolved")).select(F.col("repair_id").alias("_c")).distinct().withColumn("_open", F.lit(True))
    r = repairs.select(F.col("id").alias("_r"), F.col("status").alias("repair_status"), "is_partially_recognized")
    both = documents.join(r, documents["repair_id"] == r["_r"]).join(open_, F.col("repair_id") == F.col("_c"), "left")
    needs = F.col("status").isin(document_statuses) | F.col("repair_status").isin(repair_statuses) | F.col("is_partially_recognized") | F.coalesce("_open", F.lit(False))
    return both.where(F.col("kind").isin("order", "repeat_scan") & (F.col("status") != "archived") & needs).drop("_r", "_c", "_open")
