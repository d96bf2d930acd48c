"""Scenarios: their language, their checks, and the events they make."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.compile import constant
from ..lang.ast import Bin, Expr, Ref, Rule, WindowSchema
from ..lang.tokens import Reader, RuleError, seconds
from .faults import inject, seeded
from .traffic import Rate, filled, mixed, of_type, shaped

START = 1_767_225_600.0
FAULTS = ("out_of_order", "late", "duplicate", "drop")
METRICS = ("hit", "near_miss", "miss", "precision", "recall", "fpr", "latency_p95")


@dataclass(frozen=True)
class Use:
    """So many events with these field values within so many seconds; ``negated``: none of them."""

    values: tuple[tuple[str, str], ...]
    count: int
    within: float
    negated: bool = False


@dataclass(frozen=True)
class Case:
    kind: str
    percent: float
    stream: str
    entity: str
    steps: tuple[Use, ...]


@dataclass(frozen=True)
class Expectation:
    metric: str
    rule: str
    op: str
    value: float


@dataclass
class Scenario:
    name: str
    uses: tuple[str, ...]
    options: dict[str, str]
    traffic: list[tuple[str, Rate]] = field(default_factory=list)
    cases: list[Case] = field(default_factory=list)
    faults: dict[str, float] = field(default_factory=dict)
    expects: list[Expectation] = field(default_factory=list)

    @property
    def duration(self) -> float:
        return seconds(self.options.get("duration", "10m"))

    @property
    def seed(self) -> int:
        return int(float(self.options.get("seed", "42")))


def _rate_value(r: Reader) -> float:
    n = r.number()
    r.expect("/", "s")
    return n


def _options(r: Reader, end: str) -> dict[str, str]:
    got = {}
    while not r.accept(end):
        name = r.name()
        r.expect("=")
        got[name] = r.next().text.strip('"')
        r.accept(",")
    return got


def _rate(r: Reader) -> Rate:
    if r.kind() == "number":
        return Rate("const", _rate_value(r))
    kind = r.name()
    if kind == "timeline":
        r.expect("{")
        segments = []
        while not r.accept("}"):
            a = r.duration() if r.kind() == "duration" else float(r.number())
            r.expect("..")
            b = r.duration()
            r.expect("=")
            segments.append((a, b, _rate_value(r)))
        return Rate("timeline", segments=tuple(segments))
    r.expect("(")
    given: dict[str, float | str] = {}
    while not r.accept(")"):
        name = r.name()
        r.expect("=")
        given[name] = r.duration() if r.kind() == "duration" else _rate_value(r) if r.kind() == "number" else r.name()
        r.accept(",")
    if kind == "wave":
        return Rate("wave", float(given["base"]), float(given["amp"]), float(given["period"]), str(given.get("shape", "sine")))
    if kind == "burst":
        return Rate("burst", float(given["base"]), period=float(given["every"]), peak=float(given["peak"]), hold=float(given["hold"]))
    raise RuleError(f"unknown rate {kind}")


def _case(r: Reader) -> Case:
    kind = r.name()
    if kind not in ("hit", "near_miss", "miss"):
        raise RuleError(f"unknown case {kind}")
    r.expect("<")
    percent = r.number()
    r.expect("%", ">")
    stream = r.name()
    r.expect("{")
    entity = r.name()
    r.expect("seq", "{")
    steps = []
    while not r.accept("}"):
        negated = r.accept("not")
        r.expect("use", "(")
        values = []
        while not r.accept(")"):
            name = r.name()
            r.expect("=")
            values.append((name, r.next().text.strip('"')))
            r.accept(",")
        r.expect("with", "(")
        count = r.integer()
        r.expect(",")
        steps.append(Use(tuple(values), count, r.duration(), negated))
        r.expect(")")
    r.expect("}")
    return Case(kind, percent, stream, entity, tuple(steps))


def parse_scenario(source: str) -> Scenario:
    r = Reader(source)
    uses, options = [], {}
    while r.accept("use"):
        uses.append(r.string())
    if r.accept("#["):
        options |= _options(r, "]")
    r.expect("scenario")
    name = r.name()
    if r.accept("<"):
        options |= _options(r, ">")
    s = Scenario(name, tuple(uses), options)
    r.expect("{")
    while not r.accept("}"):
        part = r.name()
        r.expect("{")
        while not r.accept("}"):
            if part == "traffic":
                r.expect("stream")
                stream = r.name()
                r.expect("gen")
                s.traffic.append((stream, _rate(r)))
            elif part == "injection":
                s.cases.append(_case(r))
            elif part == "faults":
                fault = r.name()
                r.expect("=")
                s.faults[fault] = r.number()
                r.expect("%")
                r.accept(";")
            elif part == "expect":
                metric = r.name()
                r.expect("(")
                rule = r.name()
                r.expect(")")
                op = r.next().text
                value = r.duration() if r.kind() == "duration" else r.number() / 100
                r.accept("%")
                s.expects.append(Expectation(metric, rule, op, value))
            else:
                raise RuleError(f"unknown block {part}")
    return s


def problems(s: Scenario, schemas: Mapping[str, WindowSchema], rules: Mapping[str, Rule]) -> list[str]:
    """What is wrong with a scenario."""
    found = []
    known = {n for n, w in schemas.items() if not w.is_output} | {x for w in schemas.values() for x in w.streams}
    if not s.traffic:
        found.append("SC2: there is no traffic")
    for stream, rate in s.traffic:
        if stream not in known:
            found.append(f"SC3: unknown stream {stream}")
        ends = sorted(rate.segments)
        if rate.kind == "timeline" and any(a[1] != b[0] for a, b in zip(ends, ends[1:])):
            found.append(f"SV2: the timeline of {stream} has a gap or overlap")
        if rate.kind == "burst" and rate.hold > rate.period:
            found.append(f"SV3: a burst of {stream} is longer than its period")
    for c in s.cases:
        if c.stream not in known:
            found.append(f"SC4: unknown stream {c.stream}")
        if not 0 < c.percent <= 100:
            found.append(f"SV4: {c.percent}% is no share")
        if not c.steps:
            found.append(f"SV5: {c.kind} has no steps")
    if sum(c.percent for c in s.cases) > 100:
        found.append("SV6: the cases' shares are over 100%")
    for fault, percent in s.faults.items():
        if fault not in FAULTS or not 0 <= percent <= 100:
            found.append(f"SV7: unknown fault or share: {fault} {percent}%")
    kinds = {c.kind for c in s.cases}
    for e in s.expects:
        if e.metric not in METRICS:
            found.append(f"VN1: unknown metric {e.metric}")
        if e.rule not in rules:
            found.append(f"VN2: unknown rule {e.rule}")
        if e.metric in ("hit", "near_miss", "miss") and e.metric not in kinds:
            found.append(f"VN3: nothing is injected as {e.metric}")
        if e.metric != "latency_p95" and not 0 <= e.value <= 1:
            found.append(f"VN4: {e.value} is no share")
    if s.duration <= 0:
        found.append("SC5: a scenario lasts some time")
    return found


def forced(where: Expr | None) -> dict[str, str | float | bool]:
    """Values that the equalities of a bind's filter ask for."""
    if isinstance(where, Bin) and where.op == "&&":
        return forced(where.left) | forced(where.right)
    if isinstance(where, Bin) and where.op == "==":
        for a, b in ((where.left, where.right), (where.right, where.left)):
            v = constant(b)
            if isinstance(a, Ref) and v is not None:
                return {a.name: v}
    return {}


def events(spark: SparkSession, s: Scenario, schemas: Mapping[str, WindowSchema], rules: Mapping[str, Rule]) -> dict[str, DataFrame]:
    """Each window's events (its fields, seq, arrival, copy, and the case and label of injected ones).

    A case's budget is its share of the stream's events; each of its entities gets the steps' events, the steps in equal slices
    of the window one after the other; a near miss stops one event short of the last step.
    """
    made: dict[str, DataFrame] = {}
    first = rules.get(s.expects[0].rule) if s.expects else next(iter(rules.values()), None)
    for k, (stream, rate) in enumerate(s.traffic):
        for name, w in schemas.items():
            if name != stream and stream not in w.streams:
                continue
            base = shaped(spark, rate, s.duration, START)
            df = filled(base, w, s.seed + 7919 * k).withColumn("label", F.lit(None).cast("string")).withColumn("entity", F.lit(None).cast("string"))
            made[name] = df if name not in made else made[name].unionByName(df)
    totals = {stream: sum(r.total(s.duration) for x, r in s.traffic if x == stream) for stream, _ in s.traffic}
    for k, c in enumerate(s.cases):
        for name, w in schemas.items():
            if name == c.stream or c.stream in w.streams:
                made[name] = made[name].unionByName(_injected(spark, s, c, k, w, totals.get(c.stream, 0), first, name))
    out = {}
    for name, df in made.items():
        fault = {f: seeded(F.col("seq"), s.seed, p, i) for i, (f, p) in enumerate(sorted(s.faults.items()))}
        out[name] = inject(
            df, F.unix_micros("_ts"), (fault["out_of_order"], 5_000_000) if "out_of_order" in fault else None, (fault["late"], 600_000_000) if "late" in fault else None, fault.get("duplicate"), fault.get("drop"),
        ).drop("_ts")
    return out


def _injected(spark: SparkSession, s: Scenario, c: Case, k: int, w: WindowSchema, total: int, rule: Rule | None, window: str) -> DataFrame:
    steps = [u for u in c.steps if not u.negated]
    counts = [u.count for u in steps]
    if c.kind == "near_miss" and rule is not None:
        needed = sum(b.threshold.value if hasattr(b.threshold, "value") and isinstance(b.threshold.value, float) else 1 for st in rule.stages[0].steps for b in st.branches[:1])
        if sum(counts) >= needed:
            counts[-1] = max(0, counts[-1] - 1)
    each = max(1, sum(counts))
    n = max(1, int(total * c.percent / 100) // each) if total else 0
    length = max((u.within for u in steps), default=1.0)
    entities = spark.range(n).withColumn("at", (mixed(F.col("id"), s.seed, 500 + k) % max(1, round((s.duration - min(length * len(steps), s.duration)) * 1_000_000) + 1)))
    places = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(j).alias("place"), F.lit(round((i * length + j * length / max(1, m)) * 1_000_000)).alias("after")) for i, m in enumerate(counts) for j in range(m)]) if sum(counts) else F.array().cast("array<struct<step:int,place:int,after:int>>")
    rows = entities.select("id", "at", F.inline(places))
    entity = F.concat(F.lit(f"{c.kind}-{k}-"), F.col("id").cast("string"))
    keys = {r.name for r in rule.stages[0].keys} if rule else {c.entity}
    bind = next((b for b in rule.binds if b.window == window), None) if rule else None
    equal = forced(bind.where) if bind and c.kind != "miss" else {}
    rows = rows.select(
        (F.lit((k + 1) * 1_000_000_000) + F.col("id") * each + F.row_number().over(_place())).alias("seq"), F.timestamp_micros(F.lit(round(START * 1_000_000)) + F.col("at") + F.col("after")).alias("ts"), "step", entity.alias("entity"),
        (F.lit((k + 1) * 1_000_000_000) + F.col("id")).alias("number"),
    )
    given: dict[str, Column] = {}
    types = w.types
    for name, kind in w.fields:
        if name in keys or name == c.entity:
            given[name] = F.col("entity") if kind in ("chars", "ip", "hex") else F.col("number")  # the same for all of an entity's events
        values = [dict(u.values).get(name) for u in steps]
        if any(v is not None for v in values):
            given[name] = F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("step") + 1).try_cast({"digit": "bigint", "float": "double", "bool": "boolean"}.get(types[name], "string"))
        if name in equal:
            given[name] = F.lit(equal[name])
    keep = rows.select("seq", "ts", "step", "entity", "number")
    out = [(F.col("ts") if name == w.time else given.get(name, _plain(kind, s.seed, i))).alias(name) for i, (name, kind) in enumerate(w.fields)]
    return keep.select("seq", F.col("ts").alias("_ts"), *out, F.lit(c.kind).alias("label"), F.col("entity"))


def _plain(kind: str, seed: int, i: int) -> Column:
    return of_type(kind, mixed(F.col("seq"), seed, i), F.col("ts"))


def _place() -> WindowSpec:
    return Window.partitionBy("id").orderBy("step", "place")


def fulfilled(s: Scenario, metrics: Mapping[str, float | None]) -> list[tuple[Expectation, float | None, bool]]:
    """Each expectation with its value and whether it holds."""
    got = []
    for e in s.expects:
        v = metrics.get(e.metric)
        holds = v is not None and {">=": v >= e.value, "<=": v <= e.value, ">": v > e.value, "<": v < e.value, "==": abs(v - e.value) < 1e-9}[e.op]
        got.append((e, v, bool(holds)))
    return got
