"""Running rules: text and tables in, alerts out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.compile import Compiler
from .functions.values import Value
from .lang.ast import Call, Ref, Rule, WindowSchema
from .lang.checker import check
from .lang.preprocess import substitute
from .lang.rule import parse_expression, parse_rules
from .lang.schema import parse_schemas
from .operators import bind, conv, joins, match, output
from .plans.plan import StagePlan, stage_plans


def _sql(v: object) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)


@dataclass
class Engine:
    """Schemas, the tables that stand for their windows, and for each window the column that orders rows of one time."""

    schemas: dict[str, WindowSchema]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    order: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, schema_text: str, tables: Mapping[str, DataFrame] | None = None, order: Mapping[str, str] | None = None) -> Engine:
        return cls(parse_schemas(schema_text), dict(tables or {}), dict(order or {}))

    def rules(self, text: str, variables: Mapping[str, str] | None = None) -> list[Rule]:
        """The checked rules of a text."""
        found = list(parse_rules(substitute(text, variables or {})).rules)
        for rule in found:
            check(rule, self.schemas)
        return found

    def run(self, text: str, variables: Mapping[str, str] | None = None, final: str | None = "eos") -> DataFrame:
        """The alerts of a text's only rule."""
        (rule,) = self.rules(text, variables)
        return self.alerts(rule, final)

    def run_all(self, text: str, variables: Mapping[str, str] | None = None, final: str | None = "eos") -> DataFrame:
        """The alerts of all rules together; output fields that a rule lacks are null."""
        out: DataFrame | None = None
        for rule in self.rules(text, variables):
            one = self.alerts(rule, final)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        assert out is not None, "the text has no rule"
        return out

    def emissions(self, rule: Rule, final: str | None = "eos", clock: int | None = None) -> tuple[StagePlan, DataFrame]:
        """The last stage's plan and emissions, joins and conv done."""
        tables = dict(self.tables)
        plans = stage_plans(rule)
        df: DataFrame | None = None
        for k, plan in enumerate(plans):
            events = bind.bind(plan, tables, self.schemas, self.order)
            df = match.run(plan, events, final, clock)
            if plan.limits and plan.limits.max_throttle:
                df = match.throttled(df, plan.limits)
            df = self.joined(rule, plan, df)
            if k < len(plans) - 1:
                tables[f"_{rule.name}_{k + 1}"] = output.stage_rows(plan, df)
        assert df is not None
        return plans[-1], self.conversed(rule, plans[-1], df)

    def joined(self, rule: Rule, plan: StagePlan, df: DataFrame) -> DataFrame:
        """A stage's emissions with its joins; joined windows are pruned to the columns that the rule speaks of."""
        spoken = [rule.score, rule.entity_id, *[e for _, e in rule.output.args], *[e for chain in rule.conv for op in chain for e in op.args]]
        wanted = {x.name for e in spoken for x in e.walk() if isinstance(x, Ref)} | {a.name for m in rule.stages for j in m.joins for a, _ in j.on}
        for j in plan.match.joins:
            compiler, _ = output.context(plan, df)
            left = {i: compiler.value(ref).column for i, (ref, _) in enumerate(j.on)}
            right = self.tables[j.window]
            used = wanted | {r.name for _, r in j.on} | {self.order.get(j.window), getattr(self.schemas.get(j.window), "time", None)}
            right = right.select(*[f"`{c}`" for c in right.columns if c in used])
            df = joins.apply(df, j, right, self.schemas.get(j.window), left, self.order.get(j.window))
        return df

    def conversed(self, rule: Rule, plan: StagePlan, df: DataFrame) -> DataFrame:
        """The last stage's emissions after what is done with windows that close together."""
        if not rule.conv:
            return df
        compiler, _ = output.context(plan, df)
        closed = df.where(F.startswith("origin", F.lit("close:")))
        kept = conv.apply(closed, rule.conv, compiler, ["end"], ["created", *[f"k{i}" for i in range(len(plan.key_names))]])
        other = df.where(~F.startswith("origin", F.lit("close:")))
        return kept if plan.match.close_mode == "and" else kept.unionByName(other, allowMissingColumns=True)

    def told(self, rule: Rule, plan: StagePlan, df: DataFrame) -> DataFrame:
        """The alerts of the last stage's emissions."""
        target = self.schemas.get(rule.output.target)
        return output.alerts(rule, plan, df if rule.conv else df.drop("end"), target.types if target else None)

    def alerts(self, rule: Rule, final: str | None = "eos") -> DataFrame:
        return self.told(rule, *self.emissions(rule, final))

    def close_key(self, rule: Rule, key: Mapping[str, object], final: str = "flush") -> DataFrame:
        """The alerts that closing the open windows of one key gives, and only those."""
        binds = {b.window for b in rule.binds}
        own = {w: df.where(" AND ".join(f"`{k}` <=> {_sql(v)}" for k, v in key.items())) if w in binds else df for w, df in self.tables.items()}
        alerts = Engine(self.schemas, own, self.order).alerts(rule, final)
        return alerts.where(F.col("origin") == f"close:{final}")

    def select(self, window: str, expressions: Mapping[str, str], keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
        """Expressions over a window's rows, without any matching."""
        df = self.tables[window]
        fields = bind.fields_of(df)
        known: dict[Call, Value] = {}
        compiler = Compiler(lambda ref: fields.get(ref.name), known.get, strict)
        parsed = {name: parse_expression(text) for name, text in expressions.items()}
        df = bind.with_membership(df, list(parsed.values()), self.tables, compiler, known)
        values = {name: compiler.value(e) for name, e in parsed.items()}
        return df.select(*keep, *[(v.column.cast("string") if v.kind == "null" else v.column).alias(name) for name, v in values.items()])
