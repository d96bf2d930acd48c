"""Joins of emissions to other windows: the first row that fits, or the latest one not after the emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import of_type, text
from ..lang.ast import Join, WindowSchema
from ..lang.tokens import RuleError
from .bind import small


def snapshot(left: DataFrame, right: DataFrame, on: list[tuple[Column, str]], prefix: str, order: str | None = None) -> DataFrame:
    """Each left row with the first right row (by ``order``) of equal keys; right columns get the prefix.  Null matches nothing."""
    keys = [r for _, r in on]
    w = Window.partitionBy(*keys).orderBy(order if order else F.lit(0))
    first = right.dropna(subset=keys).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    first = first.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in first.columns])
    cond = F.lit(True)
    for left_key, right_key in on:
        cond = cond & (left_key == F.col(f"`{prefix}{right_key}`"))
    return left.join(small(first), cond, "left")


def _texts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its keys as texts, so that whole numbers of any type are equal."""
    return df.withColumns({k: text(of_type(F.col(k), df.schema[k].dataType)) for k in keys})


def asof(left: DataFrame, right: DataFrame, on: list[tuple[Column, str]], at: str, time: str, prefix: str, within: float | None = None, order: str | None = None) -> DataFrame:
    """Each left row with the latest right row of equal keys whose ``time`` is not after ``at`` (nor more than ``within`` before); of equal times the last by ``order``.

    Both sides are put together and sorted once: the last right row seen so far is the answer, so no pairs are made.
    """
    if not on:
        raise RuleError("an as-of join needs a key")
    payload = F.struct(*[F.col(f"`{c}`").alias(c) for c in right.columns])
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns])
    keys = [f"_j{i}" for i in range(len(on))]
    place = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    right = right.dropna(subset=[r for _, r in on])
    r_side = _texts(right.select(*[F.col(f"`{r}`").alias(k) for k, (_, r) in zip(keys, on)], F.col(f"`{time}`").cast("timestamp").alias("_t"), F.lit(0).alias("_side"), place.alias("_o"), payload.alias("_r")), keys)
    l_side = _texts(left.select(*[c.alias(k) for k, (c, _) in zip(keys, on)], F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_o"), row.alias("_l")), keys)
    both = r_side.unionByName(l_side, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last(F.when(F.col("_side") == 0, F.struct("_t", "_r")), ignorenulls=True).over(w)).where("_side = 1")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    if within is not None:
        known = known & (F.unix_micros(F.col("_hit")["_t"]) >= F.unix_micros("_t") - round(within * 1_000_000))
    found = found.withColumn("_r", F.when(known, F.col("_hit")["_r"]))
    return found.select("_l.*", *[F.col("_r")[c].alias(f"{prefix}{c}") for c in right.columns])


def apply(left: DataFrame, join: Join, right: DataFrame, schema: WindowSchema | None, left_key: dict[int, Column], order: str | None = None) -> DataFrame:
    """A rule's join; ``left_key`` gives the column of each condition's left side."""
    on = [(left_key[i], r.name) for i, (_, r) in enumerate(join.on)]
    prefix = f"{join.window}."
    if join.mode == "snapshot":
        return snapshot(left, right, on, prefix, order)
    if schema is None or schema.time is None:
        raise RuleError(f"an as-of join needs a time field in {join.window}")
    return asof(left, right, on, "last", schema.time, prefix, join.within, order)
