"""The functions that expressions can call.  A wrong number or kind of arguments gives null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefmt import spark_pattern
from .values import Value, column_type, null, text

Args = Sequence[Value]
FUNCTIONS: dict[str, tuple[tuple[str, ...], str | None, Callable[[Args], Value]]] = {}


def _function(name: str, kinds: str, rest: str | None = None) -> Callable[[Callable[[Args], Value]], Callable[[Args], Value]]:
    """Registers a function: kinds of its arguments (? before one that may be missing), and of any further ones."""

    def put(f: Callable[[Args], Value]) -> Callable[[Args], Value]:
        FUNCTIONS[name] = (tuple(kinds.split()), rest, f)
        return f

    return put


def fits(kind: str, wanted: str) -> bool:
    return wanted == "any" or kind == "null" or kind == wanted or (wanted == "arr" and kind.startswith("arr:")) or (wanted == "when" and kind in ("time", "num"))


def call(name: str, args: Args) -> Value:
    kinds, rest, f = FUNCTIONS[name]
    needed = [k for k in kinds if not k.startswith("?")]
    wanted = [k.removeprefix("?") for k in kinds]
    if len(args) < len(needed) or (len(args) > len(kinds) and rest is None):
        return null()
    wanted += [rest or "any"] * (len(args) - len(wanted))
    if not all(fits(a.kind, w) for a, w in zip(args, wanted)):
        return null()
    return f(args)


def _s(c: Column) -> Value:
    return Value(c, "str")


def _n(c: Column) -> Value:
    return Value(c.cast("double"), "num")


def _b(c: Column) -> Value:
    return Value(c, "bool")


def _c(v: Value, kind: str) -> Column:
    return v.column if v.kind != "null" else F.lit(None).cast(column_type(kind))


def _finite(c: Column) -> Value:
    """The number, or null if it is none or infinite."""
    return _n(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c))


# Texts.

_function("contains", "str str")(lambda a: _b(F.contains(_c(a[0], "str"), _c(a[1], "str"))))
_function("startswith", "str str")(lambda a: _b(F.startswith(_c(a[0], "str"), _c(a[1], "str"))))
_function("endswith", "str str")(lambda a: _b(F.endswith(_c(a[0], "str"), _c(a[1], "str"))))


def _any_of(test: Callable[[Column, Column], Column]) -> Callable[[Args], Value]:
    """True at the first that fits; null if a null comes before that."""

    def f(a: Args) -> Value:
        got = F.lit(False)
        for v in reversed(a[1:]):
            hit = test(_c(a[0], "str"), _c(v, "str"))
            got = F.when(hit.isNull(), F.lit(None)).when(hit, F.lit(True)).otherwise(got)
        return _b(got)

    return f


_function("startswith_any", "str str", "str")(_any_of(F.startswith))
_function("endswith_any", "str str", "str")(_any_of(F.endswith))


@_function("substr", "str num ?num")
def _substr(a: Args) -> Value:
    s, start = _c(a[0], "str"), F.floor(_c(a[1], "num")).cast("int")
    n = F.length(s)
    first = F.when(start > 0, start).when(start == 0, F.lit(1)).otherwise(F.greatest(n + start + 1, F.lit(1)))
    if len(a) == 2:
        return _s(F.substring(s, first, n))
    length = F.floor(_c(a[2], "num")).cast("int")
    return _s(F.when(length <= 0, F.when(s.isNotNull(), F.lit(""))).otherwise(F.substring(s, first, length)))


def _pattern(v: Value) -> Column:
    return F.replace(_c(v, "str"), F.lit("(?P<"), F.lit("(?<"))


_function("replace", "str str str")(lambda a: _s(F.regexp_replace(_c(a[0], "str"), _pattern(a[1]), _c(a[2], "str"))))
_function("replace_plain", "str str str")(lambda a: _s(F.when(_c(a[1], "str") == "", _c(a[0], "str")).otherwise(F.replace(_c(a[0], "str"), _c(a[1], "str"), _c(a[2], "str")))))
_function("regex_match", "str str")(lambda a: _b(F.regexp_like(_c(a[0], "str"), _pattern(a[1]))))
_function("trim", "str")(lambda a: _s(F.regexp_replace(_c(a[0], "str"), r"(?U)^\s+|\s+$", "")))
_function("ltrim", "str")(lambda a: _s(F.regexp_replace(_c(a[0], "str"), r"(?U)^\s+", "")))
_function("rtrim", "str")(lambda a: _s(F.regexp_replace(_c(a[0], "str"), r"(?U)\s+$", "")))
_function("lower", "str")(lambda a: _s(F.lower(_c(a[0], "str"))))
_function("upper", "str")(lambda a: _s(F.upper(_c(a[0], "str"))))
_function("len", "str")(lambda a: _n(F.octet_length(_c(a[0], "str"))))
_function("concat", "any", "any")(lambda a: _s(F.concat(*[text(v) for v in a])))


@_function("indexof", "str str")
def _indexof(a: Args) -> Value:
    s, sub = _c(a[0], "str"), _c(a[1], "str")
    place = F.call_function("instr", s, sub)
    return _n(F.when(place == 0, F.lit(-1)).otherwise(F.octet_length(F.left(s, place - 1))))


@_function("split", "str str")
def _split(a: Args) -> Value:
    s, sep = _c(a[0], "str"), _c(a[1], "str")
    quoted = F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))
    return Value(F.when(sep == "", F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))).otherwise(F.call_function("split", s, quoted, F.lit(-1))), "arr:str")


@_function("fmt", "str", "any")
def _fmt(a: Args) -> Value:
    """Each {} is replaced by the next argument; null if an argument is."""
    parts = F.call_function("split", _c(a[0], "str"), F.lit(r"\{\}"), F.lit(-1))
    pieces = [F.get(parts, F.lit(0))]
    for k, v in enumerate(a[1:], 1):
        pieces += [F.when(F.size(parts) > k, text(v)).otherwise(F.lit("")), F.coalesce(F.get(parts, F.lit(k)), F.lit(""))]
    rest = F.array_join(F.concat(F.array(F.lit("")), F.slice(parts, F.lit(len(a) + 1), F.size(parts))), "{}")
    return _s(F.concat(*pieces, rest))


# Lists.


def _array(v: Value, item: str = "str") -> Column:
    return _c(v, f"arr:{item}")


def _items(v: Value) -> str:
    return v.item if v.is_array else "str"


_function("mvcount", "arr")(lambda a: _n(F.when(_array(a[0]).isNotNull(), F.size(_array(a[0])))))
_function("mvdedup", "arr")(lambda a: Value(F.array_distinct(_array(a[0])), f"arr:{_items(a[0])}"))
_function("mvsort", "arr")(lambda a: Value(F.array_sort(_array(a[0])), f"arr:{_items(a[0])}"))
_function("mvreverse", "arr")(lambda a: Value(F.reverse(_array(a[0])), f"arr:{_items(a[0])}"))


@_function("mvjoin", "arr str")
def _mvjoin(a: Args) -> Value:
    kind = _items(a[0])
    return _s(F.call_function("array_join", F.transform(_array(a[0]), lambda x: text(Value(x, kind))), _c(a[1], "str")))


@_function("mvindex", "arr num ?num")
def _mvindex(a: Args) -> Value:
    xs, kind = _array(a[0]), _items(a[0])
    n = F.size(xs)
    at = lambda v: F.floor(_c(v, "num")).cast("int")
    if len(a) == 2:
        i = at(a[1])
        return Value(F.when(xs.isNotNull(), F.get(xs, F.when(i < 0, n + i).otherwise(i))), kind)
    lo, hi = (F.when(i < 0, n + i).otherwise(i) for i in (at(a[1]), at(a[2])))
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, n - 1)
    return Value(F.when(xs.isNotNull(), F.slice(xs, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))), f"arr:{kind}")


@_function("mvappend", "any", "any")
def _mvappend(a: Args) -> Value:
    kinds = {_items(v) if v.is_array else v.kind for v in a} - {"null"}
    kind = kinds.pop() if len(kinds) == 1 else "str"
    lift = lambda v: v.column if v.is_array else F.when(v.column.isNotNull(), F.array(v.column))
    if kinds:  # of several kinds: as texts
        lift = lambda v: F.transform(v.column, lambda x: text(Value(x, _items(v)))) if v.is_array else F.when(v.column.isNotNull(), F.array(text(v)))
    return Value(F.concat(*[lift(v) if v.kind != "null" else F.lit(None).cast(f"array<{column_type(kind)}>") for v in a]), f"arr:{kind}")


# Numbers.

_function("abs", "num")(lambda a: _n(F.abs(_c(a[0], "num"))))
_function("ceil", "num")(lambda a: _n(F.ceil(_c(a[0], "num"))))
_function("floor", "num")(lambda a: _n(F.floor(_c(a[0], "num"))))
_function("sqrt", "num")(lambda a: _n(F.when(_c(a[0], "num") >= 0, F.sqrt(_c(a[0], "num")))))
_function("pow", "num num")(lambda a: _finite(F.pow(_c(a[0], "num"), _c(a[1], "num"))))
_function("exp", "num")(lambda a: _finite(F.exp(_c(a[0], "num"))))
_function("sign", "num")(lambda a: _n(F.when(_c(a[0], "num") < 0, -1.0).when(_c(a[0], "num") >= 0, 1.0)))
_function("trunc", "num")(lambda a: _n(F.when(_c(a[0], "num") < 0, F.ceil(_c(a[0], "num"))).otherwise(F.floor(_c(a[0], "num")))))
_function("is_finite", "num")(lambda a: _b(~F.isnan(_c(a[0], "num")) & (F.abs(_c(a[0], "num")) < float("inf"))))


@_function("round", "num ?num")
def _round(a: Args) -> Value:
    """Half away from zero, of the number times a power of ten."""
    x = _c(a[0], "num")
    scale = F.pow(F.lit(10.0), F.floor(_c(a[1], "num")) if len(a) > 1 else F.lit(0.0))
    y = F.abs(x) * scale
    return _finite(F.signum(x) * (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1.0).otherwise(0.0)) / scale)


@_function("log", "num ?num")
def _log(a: Args) -> Value:
    x = _c(a[0], "num")
    if len(a) == 1:
        return _n(F.when(x > 0, F.ln(x)))
    base = _c(a[1], "num")
    return _n(F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base)))


@_function("clamp", "num num num")
def _clamp(a: Args) -> Value:
    x, lo, hi = (_c(v, "num") for v in a)
    return _n(F.when(x.isNotNull() & (lo <= hi), F.least(F.greatest(x, lo), hi)))


# Nulls.


@_function("coalesce", "any", "any")
def _coalesce(a: Args) -> Value:
    kinds = {v.kind for v in a} - {"null"}
    some = [v for v in a if v.kind != "null"]
    if not some:
        return null()
    if len(kinds) > 1:
        return _s(F.coalesce(*[text(v) for v in some]))
    return Value(F.coalesce(*[v.column for v in some]), kinds.pop())


_function("isnull", "any")(lambda a: _b(a[0].column.isNull()))
_function("isnotnull", "any")(lambda a: _b(a[0].column.isNotNull()))


# Times: a time, or a number of nanoseconds.


def _micros(v: Value) -> Column:
    return F.unix_micros(v.column) if v.kind == "time" else F.floor(_c(v, "num") / 1000).cast("bigint")


_function("time_diff", "when when")(lambda a: _n(F.abs(_micros(a[0]) - _micros(a[1])) / 1e6))


@_function("time_bucket", "when num")
def _time_bucket(a: Args) -> Value:
    step = F.floor(_c(a[1], "num") * 1_000_000).cast("bigint")
    us = _micros(a[0])
    return Value(F.timestamp_micros(F.when(step > 0, us - F.pmod(us, F.greatest(step, F.lit(1))))), "time")


@_function("strftime", "when str")
def _strftime(a: Args) -> Value:
    pattern = spark_pattern(a[1].literal or "")
    if not pattern:
        return _s(F.lit(None).cast("string"))
    return _s(F.date_format(F.timestamp_micros(_micros(a[0])), pattern))


@_function("strptime", "str str")
def _strptime(a: Args) -> Value:
    given = a[1].literal or ""
    pattern = spark_pattern(given)
    if not pattern:
        return Value(F.lit(None).cast("timestamp"), "time")
    return Value(F.try_to_timestamp(_c(a[0], "str"), F.lit(pattern)), "time")

