"""Splitting rows by ranges of a column, so that what runs over all rows in order can run in parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def splits(df: DataFrame, column: Column, n: int) -> list[int]:
    """At most ``n`` values of a whole-number column that split the rows into parts of about equal counts; the first is the least."""
    least, points = df.agg(F.min(column), F.percentile_approx(column, [i / n for i in range(n)], 10 * n)).first()
    return [] if least is None else sorted({least, *points})


def reached(x: Column, cuts: list[int]) -> tuple[Column, Column]:
    """How many of the ascending ``cuts`` are at most ``x``, and the last of these; looked up in two steps."""
    width = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    table = F.array(*[F.lit(r).cast("array<bigint>") for r in rows])
    row = F.size(F.filter(F.lit([r[0] for r in rows]).cast("array<bigint>"), lambda c: c <= x))
    inside = F.filter(F.try_element_at(table, F.greatest(row, F.lit(1))), lambda c: c <= x)
    return (row - 1) * width + F.size(inside), F.array_max(inside)


def running_max(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with the largest ``value`` of all rows before each, in the given order (its first column a whole number).

    Ranges of the order are worked on by themselves, with the largest value of all ranges before, of which there is a row for each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    first = F.col(order[0]).cast("bigint")
    cuts = splits(df, first, n) or [0]
    df = df.withColumn("_part", F.coalesce(reached(first, cuts)[0], F.lit(0))).withColumn("_value", value)
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy("_part").agg(F.max("_value").alias("_top"))
    before = tops.select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    out = df.withColumn(name, F.max("_value").over(own)).join(F.broadcast(before), "_part")  # a row for each range
    return out.withColumn(name, F.greatest(name, "_before")).drop("_part", "_value", "_before")


def running_sum(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with the sum of ``value`` (whole numbers) of each row and all before it, in the given order (its first column a whole number).

    Ranges of the order are summed by themselves, and what all ranges before have, of which there is a row for each, is added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    df = df.withColumn("_value", value).withColumn("_first", order[0].cast("bigint"))
    cuts = splits(df, F.col("_first"), n) or [0]
    df = df.withColumn("_part", F.coalesce(reached(F.col("_first"), cuts)[0], F.lit(0)))
    own = Window.partitionBy("_part").orderBy("_first", *order[1:])
    sums = df.groupBy("_part").agg(F.sum("_value").alias("_all"))
    before = sums.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))
    out = df.withColumn(name, F.sum("_value").over(own.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "_part")  # a row for each range
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_value", "_first", "_before")
