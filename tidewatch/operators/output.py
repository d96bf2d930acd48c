"""From emissions to alerts: score, entity, output fields, id and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compile import Compiler
from ..functions.values import Value, null, of_type, text
from ..lang.ast import Call, Expr, Num, Ref, Rule
from ..plans.plan import LIST_FUNCTIONS, SET_FUNCTIONS, StagePlan, need_of
from . import bind

ALERT = ("wfx_id", "rule_name", "score", "entity_type", "entity_id", "origin", "fired_at", "summary", "yield_target", "event_time")
#: Spark types of declared fields, where they are not texts.
TYPES = {"digit": "bigint", "float": "double", "bool": "boolean", "time": "timestamp"}


def label_values(plan: StagePlan, implicit: bool = False) -> dict[str, Value]:
    """Each label's measure, from the emission's arrays; null where another branch won."""
    got: dict[str, Value] = {}
    for label, close, i, j in plan.labels(implicit):
        branch, value = (F.col("c_branch"), F.col("c_value")) if close else (F.col("s_branch"), F.col("s_value"))
        here = F.when(F.get(branch, F.lit(i)) == plan.number(i, j, close), F.get(value, F.lit(i)))
        got[label] = Value(F.coalesce(got[label].column, here) if label in got else here, "num")
    return got


def list_function(name: str, xs: Column, kind: str, p: float = 0.0) -> Value:
    """A function of a list of values in order."""
    n = F.size(xs)
    if name == "collect_list":
        return Value(xs, f"arr:{kind}")
    if name == "collect_set":
        return Value(F.array_distinct(xs), f"arr:{kind}")
    if name in ("first", "last"):
        return Value(F.try_element_at(xs, F.lit(1 if name == "first" else -1)), kind)
    if kind != "num":
        return null()
    if name == "stddev":
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
        var = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
        return Value(F.when(n >= 2, F.sqrt(var)).otherwise(0.0), "num")
    place = F.floor((n - 1) * min(max(p, 0.0), 100.0) / 100.0 + 0.5).cast("int")
    return Value(F.when(n > 0, F.get(F.array_sort(xs), place)).otherwise(0.0), "num")


def context(plan: StagePlan, df: DataFrame, implicit: bool = False) -> tuple[Compiler, dict[str, Value]]:
    """A compiler for score and output: keys, then labels, then joined fields; and functions of the aliases' rows."""
    keys = bind.key_values(plan, df)
    names = {**label_values(plan, implicit), **keys}
    joined = {f.name: of_type(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if "." in f.name}

    def resolve(ref: Ref) -> Value | None:
        if ref.owner and f"{ref.owner}.{ref.name}" in joined:
            return joined[f"{ref.owner}.{ref.name}"]
        if ref.owner is None and ref.name == "close_reason":
            return Value(F.when(F.startswith("origin", F.lit("close:")), F.substring("origin", 7, 20)), "str")
        if ref.name in names:
            return names[ref.name]
        return next((v for k, v in joined.items() if k.partition(".")[2] == ref.name), None)

    types = {f.name: f.dataType for f in df.schema.fields}

    def special(call: Call) -> Value | None:
        if call.owner is not None or not call.args or not isinstance(call.args[0], Ref):
            return None
        if call.name not in (*SET_FUNCTIONS, *LIST_FUNCTIONS):
            return None
        need = need_of(call)
        if need not in plan.needs:
            return null()
        i = plan.needs.index(need)
        column = F.col(f"n{i}")
        if need.kind != "list":
            v = of_type(column, types[f"n{i}"])
            return Value(F.coalesce(v.column, F.lit(0.0)), "num") if need.kind in ("sum", "avg") else v
        own = of_type(column, types[f"n{i}"])
        p = call.args[1].value if len(call.args) > 1 and isinstance(call.args[1], Num) else 0.0
        return list_function(call.name, own.column, own.item, p)

    return Compiler(resolve, special, strict=False), names


def _steps_text(plan: StagePlan, each: str) -> list[Column]:
    """``step`` texts of the emission: the winning branches' labels (or step numbers) with their measures."""
    out = []
    k = 0
    for close, steps in ((False, plan.match.steps), (True, plan.match.close_steps)):
        for i, s in enumerate(steps):
            branch, value = (F.col("c_branch"), F.col("c_value")) if close else (F.col("s_branch"), F.col("s_value"))
            label = F.lit(f"step{k}")
            for j, b in enumerate(s.branches):
                if b.label:
                    label = F.when(F.get(branch, F.lit(i)) == plan.number(i, j, close), F.lit(b.label)).otherwise(label)
            out.append(F.when(F.get(branch, F.lit(i)).isNotNull(), F.concat(label, F.lit("="), F.format_string(each, F.coalesce(F.get(value, F.lit(i)), F.lit(0.0))))))
            k += 1
    return out


def alerts(rule: Rule, plan: StagePlan, df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """The alerts of a rule: ``ALERT``, then the output's fields, each under its own name and in its declared type.

    Rows without a score or an entity are dropped, as a rule that can't say how bad or who says nothing.
    """
    compiler, _ = context(plan, df)
    score = compiler.value(rule.score)
    number = score.column if score.kind == "num" else F.lit(None).cast("double")
    keys = bind.key_values(plan, df)
    fired = F.date_format("fired", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    scope = F.concat(F.lit("scope=["), F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), text(v)) for k, v in keys.items()]), F.lit("]")) if keys else F.lit("scope=global")
    summary = F.concat_ws("; ", F.lit(f"rule={rule.name}"), scope, *_steps_text(plan, "%.1f"), F.concat(F.lit("origin="), F.col("origin")))
    whole = F.concat_ws("\u0000", F.lit(rule.name), F.concat_ws("\u001f", *[text(v) for v in keys.values()]) if keys else F.lit(""), fired, F.concat_ws("\u001f", *_steps_text(plan, "%a")), F.col("origin"))
    out = df.select(
        F.substring(F.sha2(whole, 256), 1, 16).alias("wfx_id"), F.lit(rule.name).alias("rule_name"),
        F.when(~F.isnan(number) & number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0))).alias("score"), F.lit(rule.entity_type).alias("entity_type"),
        text(compiler.value(rule.entity_id)).alias("entity_id"), "origin", fired.alias("fired_at"), summary.alias("summary"), F.lit(rule.output.target).alias("yield_target"),
        F.col("last").alias("event_time"), *[_field(compiler, e, name, (types or {}).get(name)) for name, e in rule.output.args], *[c for c in ("rank", "end") if c in df.columns],
    )
    return out.where(F.col("score").isNotNull() & F.col("entity_id").isNotNull())


def _field(compiler: Compiler, e: Expr, name: str, declared: str | None) -> Column:
    v = compiler.value(e)
    column = v.column.cast("string") if v.kind == "null" else v.column
    if declared in ("chars", "ip", "hex"):
        column = text(v) if v.kind != "null" else column
    elif declared in TYPES and not v.is_array:
        column = column.try_cast(TYPES[declared])
    return column.alias(name)


def stage_rows(plan: StagePlan, df: DataFrame) -> DataFrame:
    """A stage's emissions as the next stage's events: keys under their names, labels, and the time."""
    labels = label_values(plan, implicit=True)
    keys = [F.col(f"k{i}").alias(n) for i, n in enumerate(plan.key_names)]
    own = [v.column.alias(n) for n, v in labels.items() if n not in plan.key_names]
    return df.select(*keys, *own, F.col("last").alias("_ts"), F.unix_micros("fired").alias("_seq"))


