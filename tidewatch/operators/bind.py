"""Binding: the events that a stage reads, with everything its matching needs as columns.

Filters, guards and fields are evaluated here, as columns, so that what comes after handles only
numbers, texts and flags.  Each window is read once however many aliases it has; an event is offered to each
alias whose filter is true.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compile import Compiler
from ..functions.values import Value, column_type, of_type, text
from ..lang.ast import Call, Expr, Ref, Str, WindowSchema
from ..lang.tokens import RuleError
from ..plans.plan import StagePlan
from .baseline import baseline

Tables = Mapping[str, DataFrame]
#: Rows up to which the values of a window that ``has`` looks into are broadcast.
BROADCAST_ROWS = 100_000


def fields_of(df: DataFrame) -> dict[str, Value]:
    return {f.name: of_type(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The DataFrame, marked for broadcast if its counted rows are few; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_membership(df: DataFrame, expressions: list[Expr | None], tables: Tables, compiler: Compiler, found: dict[Call, Value]) -> DataFrame:
    """``df`` with a flag for each W.has(value[, "field"]) in the expressions: whether the value's text is among the field's."""
    calls = dict.fromkeys(x for e in expressions if e for x in e.walk() if isinstance(x, Call) and x.name == "has" and x.owner)
    for k, call in enumerate(calls):
        other = tables.get(call.owner or "")
        if other is None:
            found[call] = Value(F.lit(None).cast("boolean"), "bool")
            continue
        arg = call.args[0]
        name = call.args[1].value if len(call.args) > 1 and isinstance(call.args[1], Str) else getattr(arg, "name", "")
        if name not in other.columns:
            raise RuleError(f"{call.owner}.has: there is no field {name}")
        flag, value = f"_has{k}_{len(found)}", f"_val{k}_{len(found)}"
        values = other.select(text(fields_of(other)[name]).alias(value)).where(F.col(value).isNotNull()).distinct().withColumn(flag, F.lit(True))
        target = text(compiler.value(arg))
        df = df.join(small(values), target == F.col(value), "left").drop(value)
        found[call] = Value(F.when(target.isNotNull(), F.coalesce(F.col(flag), F.lit(False))), "bool")
    return df


def with_baselines(plan: StagePlan, df: DataFrame, guards: list[Expr | None], ts: Column, seq: Column, keys: tuple[Ref, ...], compiler: Compiler, found: dict[Call, Value]) -> DataFrame:
    """``df`` with the deviation that each baseline(value, span[, method]) of the guards asks for.

    Rows are compared with those before them of the same keys and, in a fixed window, of the same window.
    """
    calls = dict.fromkeys(x for e in guards if e for x in e.walk() if isinstance(x, Call) and x.name == "baseline" and x.owner is None)
    for k, call in enumerate(calls):
        method = call.args[2].value if len(call.args) > 2 and isinstance(call.args[2], Str) else "mean"
        value, at, name = f"_bv{k}", f"_bt{k}", f"_bz{k}"
        df = df.withColumn(value, compiler.value(call.args[0]).column.cast("double")).withColumn(at, ts).withColumn(f"{at}s", seq)
        group = [f"`{r.name}`" for r in keys]
        if plan.match.window.kind == "fixed":
            length = round(plan.match.window.seconds * 1_000_000)
            df = df.withColumn(f"{at}b", F.unix_micros(at) - F.unix_micros(at) % length)
            group.append(f"{at}b")
        df = baseline(df, value, [g.strip("`") for g in group], [at, f"{at}s"], method, name)
        found[call] = Value(F.col(name), "num")
    return df


def bind(plan: StagePlan, tables: Tables, schemas: Mapping[str, WindowSchema], order: Mapping[str, str] | None = None) -> DataFrame:
    """The stage's events.

    Columns: ts; seq, which orders events of one time (``order`` names a window's column for it); grp;
    k0.. the keys; in_<alias> flags; ok<i>, v<i> and t<i> for each branch (guard, number, text); n<i> for each need.
    """
    groups: dict[tuple[str, tuple[Ref, ...]], list[str]] = {}
    for alias, window in plan.aliases.items():
        bare = tuple(Ref(None, r.name) for r in plan.key_of(alias))
        groups.setdefault((window, bare), []).append(alias)
    out: DataFrame | None = None
    for g, ((window, keys), aliases) in enumerate(groups.items()):
        part = _group(plan, g, window, keys, aliases, tables, schemas, (order or {}).get(window))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def _group(plan: StagePlan, g: int, window: str, keys: tuple[Ref, ...], aliases: list[str], tables: Tables, schemas: Mapping[str, WindowSchema], order: str | None) -> DataFrame:
    if window not in tables:
        raise RuleError(f"there is no table for window {window}")
    df = tables[window]
    known: dict[Call, Value] = {}
    columns = fields_of(df)

    def resolve(ref: Ref) -> Value | None:
        return columns.get(ref.name)

    compiler = Compiler(resolve, known.get)
    every = [plan.filters[a] for a in aliases] + [b.guard for b in plan.branches if b.source in aliases]
    df = with_membership(df, every, tables, compiler, known)
    time = schemas[window].time if window in schemas else "_ts"
    never = F.lit(0).cast("timestamp")  # rows without a time are at the beginning of all
    ts = F.coalesce(columns[time].column, never) if time in columns and columns[time].kind == "time" else never
    seq = F.col(order) if order else F.col("_seq") if "_seq" in df.columns else F.lit(0)
    df = with_baselines(plan, df, every[len(aliases) :], ts, seq, keys, compiler, known)
    picked: list[Column] = [ts.alias("ts"), seq.cast("bigint").alias("seq"), F.lit(g).alias("grp")]
    raw = {f.name: f.dataType for f in df.schema.fields}
    for i, ref in enumerate(keys):
        if ref.name not in raw:
            raise RuleError(f"window {window} has no key field {ref.name}")
        picked.append(F.col(f"`{ref.name}`").alias(f"k{i}"))
    accepted = {a: F.coalesce(compiler.condition(plan.filters[a]), F.lit(False)) for a in aliases}
    for a in plan.aliases:
        picked.append((accepted[a] if a in aliases else F.lit(False)).alias(f"in_{a}"))
    for i, b in enumerate(plan.branches):
        own = b.source in aliases
        value = resolve(Ref(b.source, b.field)) if own and b.field else None
        if own and b.field and value is None:
            raise RuleError(f"window {window} has no field {b.field}")
        ok = compiler.condition(b.guard) if own else F.lit(None).cast("boolean")
        picked.append(ok.alias(f"ok{i}"))
        picked.append((value.column if value and value.kind == "num" else F.lit(None).cast("double")).alias(f"v{i}"))
        picked.append((text(value) if value and (value.kind != "num" or b.distinct) else F.lit(None).cast("string")).alias(f"t{i}"))
    for i, need in enumerate(plan.needs):
        own = need.alias in aliases
        value = resolve(Ref(need.alias, need.field)) if own and need.field else None
        kind = need_type(plan, i, tables)
        col = F.lit(None).cast(column_type(kind)) if value is None else text(value) if kind == "str" and value.kind != "str" else value.column
        picked.append(F.when(accepted[need.alias], col).alias(f"n{i}") if own else F.lit(None).cast(column_type(kind)).alias(f"n{i}"))
    # Null is as good as false here, and only bare conditions reach the scan.
    some = None
    for a in aliases:
        one = compiler.condition(plan.filters[a])
        some = one if some is None else some | one
    df = df.where(some) if all(plan.filters[a] is not None for a in aliases) else df
    for ref in keys:
        df = df.where(F.col(f"`{ref.name}`").isNotNull())
    return df.select(*picked)


def need_type(plan: StagePlan, i: int, tables: Tables) -> str:
    """num or str: how the values of a need's field are kept."""
    need = plan.needs[i]
    if need.field is None:
        return "num"
    df = tables[plan.aliases[need.alias]]
    found = fields_of(df).get(need.field)
    return "num" if found is not None and found.kind == "num" and need.kind != "distinct" else "str"


def key_values(plan: StagePlan, df: DataFrame) -> dict[str, Value]:
    """The keys as values, from the columns k0.. of a stage's output."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {name: of_type(F.col(f"k{i}"), types[f"k{i}"]) for i, name in enumerate(plan.key_names)}
