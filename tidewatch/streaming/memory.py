"""Windows within a budget of bytes: the oldest rows go first.

A window keeps the newest rows whose bytes together are within its own budget.  A budget for all windows together takes from the
largest first, which comes to one level that no window may be over and those below it are left alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import running_sum

#: Bytes that any row takes, and a value of fixed length.
ROW, VALUE = 16, 8


def row_bytes(df: DataFrame) -> Column:
    """An estimate of a row's bytes: texts by their length, lists by their texts, other values alike."""
    total = F.lit(ROW)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            total = total + VALUE
    return total.cast("bigint")


def newest(df: DataFrame, time: str, most: int, order: str | None = None, size: Column | None = None) -> DataFrame:
    """The newest rows of ``df`` that have at most ``most`` bytes together; of rows of one time those of the larger ``order``.

    No task gets all rows: sums run over ranges of the time.  Rows without a time are the oldest.
    """
    at = -F.coalesce(F.unix_micros(F.col(f"`{time}`").cast("timestamp")), F.lit(-(1 << 62)))
    keys = [at, *([F.col(f"`{order}`").desc()] if order else [])]
    return running_sum(df, row_bytes(df) if size is None else size.cast("bigint"), keys, "_upto").where(F.col("_upto") <= most).drop("_upto")


def level(sizes: Mapping[str, int], most: int) -> int | None:
    """The bytes that no window may be over so that all have at most ``most`` together; none if they have that already."""
    if sum(sizes.values()) <= most:
        return None
    left, open_ = most, sorted(sizes.values())
    while open_ and open_[0] * len(open_) <= left:
        left -= open_.pop(0)
    return left // len(open_)


def within(windows: Mapping[str, DataFrame], times: Mapping[str, str], most: int, orders: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The windows, cut to at most ``most`` bytes together; those without a time field are counted but not cut."""
    sizes = {name: int(df.agg(F.sum(row_bytes(df))).first()[0] or 0) for name, df in windows.items()}
    fixed = sum(n for name, n in sizes.items() if name not in times)
    top = level({name: n for name, n in sizes.items() if name in times}, max(0, most - fixed))
    if top is None:
        return dict(windows)
    return {name: newest(df, times[name], top, (orders or {}).get(name)) if name in times and sizes[name] > top else df for name, df in windows.items()}
