"""Late events: what is done with rows that come after the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running_max

POLICIES = ("drop", "revise", "side_output")


def split_late(df: DataFrame, time: str, arrival: list[str], delay: float, lateness: float = 0.0, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a table with its arrival order.

    The watermark before a row is the latest time of the rows that came earlier, less ``delay`` seconds; a row is late
    if it is before the watermark by more than ``lateness``.  The latest time is kept for each of ``keys``; without keys
    it is that of the whole stream, worked out over ranges of the arrival order (whose first column is a whole number).
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
        marked = df.withColumn("_seen", F.max(at).over(w))
    else:
        marked = running_max(df, at, arrival, "_seen")
    marked = marked.withColumn("_late", F.coalesce(at < F.col("_seen") - round((delay + lateness) * 1_000_000), F.lit(False))).drop("_seen")
    return marked.where(~F.col("_late")).drop("_late"), marked.where("_late").drop("_late")


def apply_policy(df: DataFrame, time: str, arrival: list[str], delay: float, policy: str = "drop", lateness: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """The rows that are used: those in time under drop and side_output, all under revise."""
    if policy not in POLICIES:
        raise ValueError(f"unknown late policy {policy}")
    return df if policy == "revise" else split_late(df, time, arrival, delay, lateness, keys)[0]


def retained(df: DataFrame, time: str, over: float, now: float | None = None) -> DataFrame:
    """What a window still holds at ``now`` (seconds since 1970; else the latest row's time): rows of the last ``over`` seconds, all if that is 0."""
    if not over:
        return df
    at = F.unix_micros(F.col(time).cast("timestamp"))
    end = df.agg(F.max(at)).scalar() if now is None else F.lit(round(now * 1_000_000))
    return df.where(at >= end - round(over * 1_000_000))
