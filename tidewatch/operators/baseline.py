"""How far a value is from those before it: against their mean, a smoothed mean, or their median.

Each row is compared with the rows before it in its group, then counts for those after it.  Groups are read in
order; the smoothed mean is folded in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.tokens import RuleError

ALPHA = 0.3
LAST = 1000


def _relative(v: Column, base: Column) -> Column:
    return F.when(F.coalesce(base, F.lit(0.0)) == 0, 0.0).otherwise((v - base) / F.abs(base))


def baseline(df: DataFrame, value: str, keys: list[str], order: list[str], method: str = "mean", name: str = "baseline") -> DataFrame:
    """``df`` with the deviation of ``value``: z-score for mean, relative for ewma and median; 0 where there is no base yet."""
    v = F.col(value).cast("double")
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if method == "mean":
        sd = F.coalesce(F.stddev_pop(v).over(before), F.lit(0.0))
        return df.withColumn(name, F.when(v.isNotNull(), F.when(sd == 0, 0.0).otherwise((v - F.avg(v).over(before)) / sd)))
    if method == "median":
        recent = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-LAST, -1)
        seen = F.array_sort(F.collect_list(v).over(recent))  # at most LAST values
        n = F.size(seen)
        middle = (F.get(seen, F.floor((n - 1) / 2).cast("int")) + F.get(seen, F.floor(n / 2).cast("int"))) / 2
        return df.withColumn(name, F.when(v.isNotNull(), _relative(v, middle)))
    if method != "ewma":
        raise RuleError(f"unknown baseline method {method}")
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else df.repartition(1).sortWithinPartitions(*order)
    schema = df.withColumn(name, F.lit(0.0)).schema

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, base = None, None
        for p in parts:
            out = []
            for own, x in zip(p[keys].itertuples(index=False, name=None) if keys else [()] * len(p), p[value].tolist()):
                if own != key:
                    key, base = own, None
                if x is None or x != x:
                    out.append(None)
                    continue
                out.append((x - base) / abs(base) if base else 0.0)
                base = x if base is None else ALPHA * x + (1 - ALPHA) * base
            yield p.assign(**{name: pd.Series(out, index=p.index, dtype="float64")})

    return dealt.mapInPandas(work, schema)
