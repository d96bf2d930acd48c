"""Faults of delivery: rows that come out of order, late, twice or never."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traffic import mixed


def inject(df: DataFrame, arrival: Column, out_of_order: tuple[Column, int] | None = None, late: tuple[Column, int] | None = None, duplicate: Column | None = None, drop: Column | None = None) -> DataFrame:
    """``df`` with the place of ``arrival`` and the number of the ``copy`` (0, or 1 for a repeated row).

    Rows for which the condition of ``out_of_order`` or ``late`` holds arrive so many places later.
    """
    for fault in (out_of_order, late):
        if fault is not None:
            arrival = F.when(fault[0], arrival + fault[1]).otherwise(arrival)
    out = df if drop is None else df.where(~F.coalesce(drop, F.lit(False)))
    copies = F.array(F.lit(0)) if duplicate is None else F.when(F.coalesce(duplicate, F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("arrival", arrival).withColumn("copy", F.explode(copies))


def seeded(seq: Column, seed: int, percent: float, salt: int) -> Column:
    """True for about so many of a hundred rows."""
    return mixed(seq, seed, 1000 + salt) % 1_000_000 < round(percent * 10_000)
