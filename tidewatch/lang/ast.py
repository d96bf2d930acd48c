"""What the parsers make: schemas, expressions, rules, tests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    def parts(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for p in self.parts():
            yield from p.walk()


@dataclass(frozen=True)
class Num(Expr):
    value: float


@dataclass(frozen=True)
class Str(Expr):
    value: str


@dataclass(frozen=True)
class Bool(Expr):
    value: bool


@dataclass(frozen=True)
class Ref(Expr):
    """A field, perhaps of an alias or a joined window; or a label, or a whole alias."""

    owner: str | None
    name: str


@dataclass(frozen=True)
class Call(Expr):
    owner: str | None
    name: str
    args: tuple[Expr, ...]

    def parts(self) -> tuple[Expr, ...]:
        return self.args


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Neg(Expr):
    of: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.of,)


@dataclass(frozen=True)
class In(Expr):
    what: Expr
    items: tuple[Expr, ...]
    negated: bool

    def parts(self) -> tuple[Expr, ...]:
        return (self.what, *self.items)


@dataclass(frozen=True)
class If(Expr):
    cond: Expr
    then: Expr
    other: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.cond, self.then, self.other)


@dataclass(frozen=True)
class WindowSchema:
    name: str
    streams: tuple[str, ...]
    time: str | None
    over: float
    fields: tuple[tuple[str, str], ...]

    @property
    def types(self) -> dict[str, str]:
        return dict(self.fields)

    @property
    def is_output(self) -> bool:
        return not self.streams


@dataclass(frozen=True)
class Bind:
    alias: str
    window: str
    where: Expr | None


@dataclass(frozen=True)
class Branch:
    label: str | None
    source: str
    field: str | None
    guard: Expr | None
    distinct: bool
    measure: str
    cmp: str
    threshold: Expr


@dataclass(frozen=True)
class Step:
    branches: tuple[Branch, ...]


@dataclass(frozen=True)
class WindowSpec:
    kind: str  # sliding, fixed or session
    seconds: float


@dataclass(frozen=True)
class Join:
    window: str
    mode: str  # snapshot or asof
    within: float | None
    on: tuple[tuple[Ref, Ref], ...]


@dataclass(frozen=True)
class Match:
    keys: tuple[Ref, ...]
    window: WindowSpec
    key_map: tuple[tuple[str, Ref], ...]
    steps: tuple[Step, ...]
    close_mode: str | None  # "or", "and" or none
    close_steps: tuple[Step, ...]
    joins: tuple[Join, ...] = ()


@dataclass(frozen=True)
class Yield:
    target: str
    version: int | None
    args: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class ConvOp:
    kind: str
    args: tuple[Expr, ...]  # of sort: Neg marks descending order
    n: int = 0


@dataclass(frozen=True)
class Limits:
    max_memory: str | None = None
    max_instances: int | None = None
    max_throttle: str | None = None
    on_exceed: str = "throttle"

    def throttle(self) -> tuple[int, float] | None:
        """How many emissions in how many seconds."""
        if not self.max_throttle:
            return None
        n, _, unit = self.max_throttle.partition("/")
        per = {"s": 1.0, "sec": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0, "hour": 3600.0, "d": 86400.0, "day": 86400.0}[unit.strip()]
        return int(n), per


@dataclass(frozen=True)
class Rule:
    name: str
    meta: tuple[tuple[str, str], ...]
    binds: tuple[Bind, ...]
    stages: tuple[Match, ...]
    score: Expr
    entity_type: str
    entity_id: Expr
    output: Yield
    conv: tuple[tuple[ConvOp, ...], ...] = ()
    limits: Limits | None = None


@dataclass(frozen=True)
class TestInput:
    __test__ = False
    alias: str | None  # none: a tick
    values: tuple[tuple[str, Expr], ...] = ()
    seconds: float = 0.0


@dataclass(frozen=True)
class TestCase:
    __test__ = False
    name: str
    rule: str
    inputs: tuple[TestInput, ...]
    expects: tuple[tuple[object, ...], ...]  # ("hits", op, n) or ("hit", i, what, op, value, field)
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class RuleFile:
    uses: tuple[str, ...]
    rules: tuple[Rule, ...]
    tests: tuple[TestCase, ...] = field(default=())
