"""Expressions to columns.

``strict`` names how mixed kinds compare: in guards any comparison of different kinds is false; in score and yield
(``strict`` false) ``!=`` is true then.  Null behaves as in SQL, with three-valued and/or; a condition that is null makes
``if`` null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Bin, Bool, Call, Expr, If, In, Neg, Num, Ref, Str
from ..lang.tokens import RuleError
from . import scalar
from .values import Value, column_type, null, text

Resolve = Callable[[Ref], Value | None]
Special = Callable[[Call], Value | None]


class Compiler:
    """Turns expressions into columns; ``resolve`` finds fields, ``special`` handles calls that need more than their arguments."""

    def __init__(self, resolve: Resolve, special: Special | None = None, strict: bool = True) -> None:
        self.resolve, self.special, self.strict = resolve, special, strict

    def value(self, e: Expr) -> Value:
        if isinstance(e, Num):
            return Value(F.lit(float(e.value)), "num")
        if isinstance(e, Str):
            return Value(F.lit(e.value), "str", e.value)
        if isinstance(e, Bool):
            return Value(F.lit(e.value), "bool")
        if isinstance(e, Ref):
            return self.resolve(e) or null()
        if isinstance(e, Neg):
            v = self.value(e.of)
            return Value(-v.column, "num") if v.kind == "num" else null()
        if isinstance(e, Bin):
            return self.binary(e)
        if isinstance(e, In):
            return self.member(e)
        if isinstance(e, If):
            return self.choice(e)
        if isinstance(e, Call):
            found = self.special(e) if self.special else None
            if found is not None:
                return found
            if e.owner is None and e.name in scalar.FUNCTIONS:
                return scalar.call(e.name, [self.value(a) for a in e.args])
            raise RuleError(f"unknown function {e.owner + '.' if e.owner else ''}{e.name}")
        raise RuleError(f"can't compile {e!r}")

    def condition(self, e: Expr | None) -> Column:
        """A boolean column; anything that is no truth value is null."""
        if e is None:
            return F.lit(True)
        v = self.value(e)
        return v.column if v.kind == "bool" else F.lit(None).cast("boolean")

    def binary(self, e: Bin) -> Value:
        left, right = self.value(e.left), self.value(e.right)
        if e.op in ("&&", "||"):
            a, b = ((v.column if v.kind == "bool" else F.lit(None).cast("boolean")) for v in (left, right))
            return Value(a & b if e.op == "&&" else a | b, "bool")
        if e.op in ("+", "-", "*", "/", "%"):
            if {left.kind, right.kind} != {"num"}:
                return null()
            a, b = left.column, right.column
            by_zero = lambda c: F.when(b != 0, c)
            return Value({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: by_zero(F.try_divide(a, b)), "%": lambda: by_zero(F.try_mod(a, b))}[e.op](), "num")
        return Value(self.compare(e.op, left, right), "bool")

    def compare(self, op: str, left: Value, right: Value) -> Column:
        if "null" in (left.kind, right.kind):
            return F.lit(None).cast("boolean")
        a, b = left.column, right.column
        if {left.kind, right.kind} == {"time", "num"}:  # a number stands for nanoseconds
            a, b = (F.unix_micros(v.column) * F.lit(1000.0) if v.kind == "time" else v.column for v in (left, right))
        elif left.kind != right.kind:
            unequal = op == "!=" and not self.strict
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(unequal))
        elif left.kind == "bool" and op not in ("==", "!=") and self.strict:
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def member(self, e: In) -> Value:
        """Null for a null target; items of another kind, or null, are not the target."""
        what = self.value(e.what)
        items = [v for v in map(self.value, e.items) if v.kind == what.kind]
        if what.kind == "null":
            return Value(F.lit(None).cast("boolean"), "bool")
        hit = F.lit(False)
        for v in items:
            hit = hit | F.coalesce(what.column == v.column, F.lit(False))
        return Value(F.when(what.column.isNotNull(), ~hit if e.negated else hit), "bool")

    def choice(self, e: If) -> Value:
        cond = self.condition(e.cond)
        then, other = self.value(e.then), self.value(e.other)
        kinds = {then.kind, other.kind} - {"null"}
        if not kinds:
            return null()
        if len(kinds) > 1:
            return Value(F.when(cond, text(then)).when(~cond, text(other)), "str")
        kind = kinds.pop()
        cast = lambda v: v.column if v.kind != "null" else F.lit(None).cast(column_type(kind))
        return Value(F.when(cond, cast(then)).when(~cond, cast(other)), kind)


def constant(e: Expr) -> float | str | bool | None:
    """The value of an expression of literals; none if it has anything else, as a threshold must not."""
    if isinstance(e, (Num, Str, Bool)):
        return e.value
    if isinstance(e, Neg):
        v = constant(e.of)
        return -v if isinstance(v, float) else None
    if isinstance(e, Bin) and e.op in ("+", "-", "*", "/", "%"):
        a, b = constant(e.left), constant(e.right)
        if not (isinstance(a, float) and isinstance(b, float)) or (e.op in "/%" and b == 0):
            return None
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a - b * int(a / b)}[e.op]()
    return None


def truth(e: Expr, known: dict[str, str]) -> bool | str | float | None:
    """An expression where every field is null but the ``known`` ones, in three-valued logic; calls are null."""
    if isinstance(e, Ref):
        return known.get(e.name) if e.owner is None else None
    if isinstance(e, Bin) and e.op in ("&&", "||"):
        a, b = truth(e.left, known), truth(e.right, known)
        stop = e.op == "||"
        if stop in (a, b) and (a is stop or b is stop):
            return stop
        return None if None in (a, b) else not stop
    if isinstance(e, Bin) and e.op in ("==", "!=", "<", "<=", ">", ">="):
        a, b = truth(e.left, known), truth(e.right, known)
        if a is None or b is None:
            return None
        if type(a) is not type(b):
            return False
        return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[e.op]()  # type: ignore[operator]
    if isinstance(e, In):
        a = truth(e.what, known)
        return None if a is None else (a in [truth(i, known) for i in e.items]) != e.negated
    return constant(e)
