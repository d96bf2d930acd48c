"""Columns with the rule languages' types, and their text forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type to the kind that expressions see.
KINDS = {"chars": "str", "ip": "str", "hex": "str", "digit": "num", "float": "num", "bool": "bool", "time": "time"}


@dataclass(frozen=True)
class Value:
    """A column and its kind: num (double), str, bool, time (timestamp), arr:<kind>, or null."""

    column: Column
    kind: str
    literal: str | None = None  # the text, where it is written in the rule

    @property
    def item(self) -> str:
        return self.kind.removeprefix("arr:")

    @property
    def is_array(self) -> bool:
        return self.kind.startswith("arr:")



def null() -> Value:
    return Value(F.lit(None), "null")


def of_type(column: Column, kind: T.DataType) -> Value:
    """A DataFrame's column as a value; numbers become doubles, timestamps lose their zone."""
    if isinstance(kind, T.BooleanType):
        return Value(column, "bool")
    if isinstance(kind, T.NumericType):
        return Value(column.cast("double"), "num")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Value(column.cast("timestamp"), "time")
    if isinstance(kind, T.ArrayType):
        inner = of_type(F.lit(None), kind.elementType).kind
        numeric = isinstance(kind.elementType, T.NumericType)
        return Value(column.cast("array<double>") if numeric else column, f"arr:{inner}")
    if isinstance(kind, T.NullType):
        return null()
    return Value(column.cast("string"), "str")


def number_text(x: Column) -> Column:
    """A double as the shortest plain decimal: 3 for 3.0, 3.5, never with an exponent."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
    plain = F.abs(x).between(1e-3, 1e7 - 1e-9)
    wide = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(special.isNotNull(), special).when(whole, x.try_cast("bigint").cast("string")).when(plain, x.cast("string")).otherwise(F.coalesce(wide, x.cast("string")))


def text(v: Value) -> Column:
    """A value as text, null for null."""
    if v.kind == "str":
        return v.column
    if v.kind == "num":
        return number_text(v.column)
    if v.kind == "bool":
        return F.when(v.column, "true").when(~v.column, "false")
    if v.kind == "time":
        return (F.unix_micros(v.column) * 1000).cast("string")
    if v.is_array:
        return F.when(v.column.isNotNull(), "[array]")
    return F.lit(None).cast("string")


def column_type(kind: str) -> str:
    """The Spark type of a kind."""
    if kind.startswith("arr:"):
        return f"array<{column_type(kind[4:])}>"
    return {"num": "double", "str": "string", "bool": "boolean", "time": "timestamp", "null": "string"}[kind]
