"""Stage plans: branches numbered, labels resolved, the strategy chosen.

Strategies, the cheapest that is exact is taken:

* ``close_agg``: fixed or session windows with an ``and close`` block and one counting event step: a grouped aggregate;
* ``count_or_close``: fixed windows with an ``on close`` block and one plain count: row numbers for the event path, a grouped
  aggregate for the close path;
* ``modular``: fixed windows without a close block and one plain count with >= or >: row numbers;
* ``fold``: everything else, an ordered fold over each key's events in constant memory for each open window;
* ``global_fold``: rules with max_instances or max_memory, whose state spans all keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..functions.compile import constant
from ..lang.ast import Branch, Call, Expr, Limits, Match, Ref, Rule, Step

SET_FUNCTIONS = ("count", "sum", "avg", "min", "max", "distinct")
LIST_FUNCTIONS = ("collect_list", "collect_set", "first", "last", "stddev", "percentile")


@dataclass(frozen=True)
class Need:
    """What the score or output asks of an alias's rows: a count, a number, or the list of a field's values."""

    kind: str  # count, sum, avg, min, max, distinct or list
    alias: str
    field: str | None


@dataclass
class StagePlan:
    match: Match
    aliases: dict[str, str]  # alias: window
    filters: dict[str, Expr | None]
    needs: list[Need] = field(default_factory=list)
    limits: Limits | None = None
    rule: str = ""

    @property
    def branches(self) -> list[Branch]:
        """All branches, those of the event steps first."""
        return [b for s in (*self.match.steps, *self.match.close_steps) for b in s.branches]

    def number(self, step: int, branch: int, close: bool = False) -> int:
        """A branch's place in ``branches``."""
        before = self.match.steps if close else self.match.steps[:step]
        n = sum(len(s.branches) for s in before)
        if close:
            n += sum(len(s.branches) for s in self.match.close_steps[:step])
        return n + branch

    @property
    def key_names(self) -> list[str]:
        if self.match.key_map:
            return list(dict.fromkeys(name for name, _ in self.match.key_map))
        return [k.name for k in self.match.keys]

    def key_of(self, alias: str) -> list[Ref]:
        """Which field gives each key for an alias."""
        if self.match.key_map:
            own = {}
            for name, ref in self.match.key_map:
                if ref.owner == alias or ref.owner is None:
                    own.setdefault(name, ref)
            return [own.get(k, Ref(alias, k)) for k in self.key_names]
        return [Ref(alias, k.name) for k in self.match.keys]

    def labels(self, implicit: bool = False) -> list[tuple[str, bool, int, int]]:
        """(label, of a close step, step, branch); with ``implicit``, unlabelled measures are named after themselves."""
        got = []
        for close, steps in ((False, self.match.steps), (True, self.match.close_steps)):
            for i, s in enumerate(steps):
                for j, b in enumerate(s.branches):
                    label = b.label or (b.measure if implicit else None)
                    if label:
                        got.append((label, close, i, j))
        return got

    @property
    def strategy(self) -> str:
        m = self.match
        if self.limits and (self.limits.max_instances or self.limits.max_memory):
            return "global_fold"
        one = m.steps[0].branches[0] if len(m.steps) == 1 and len(m.steps[0].branches) == 1 else None
        counts = one is not None and crossing(one) is not None
        if counts and m.window.kind in ("fixed", "session") and m.close_mode == "and":
            return "close_agg"
        if counts and m.window.kind == "fixed" and m.close_mode == "or" and not one.distinct and not self.needs:  # type: ignore[union-attr]
            return "count_or_close"
        if counts and m.window.kind == "fixed" and m.close_mode is None and not one.distinct and not self.needs:  # type: ignore[union-attr]
            return "modular"
        return "fold"


def crossing(b: Branch) -> int | None:
    """The count at which a counting branch is first met, if it stays met from there on."""
    c = constant(b.threshold)
    if b.measure != "count" or not isinstance(c, float) or b.cmp not in (">=", ">"):
        return None
    return max(1, math.ceil(c) if b.cmp == ">=" else math.floor(c) + 1)


def needs_of(*expressions: Expr) -> list[Need]:
    found: dict[Need, None] = {}
    for e in expressions:
        for x in e.walk():
            if isinstance(x, Call) and x.owner is None and x.args and isinstance(x.args[0], Ref) and x.name in (*SET_FUNCTIONS, *LIST_FUNCTIONS):
                found[need_of(x)] = None
    return list(found)


def need_of(call: Call) -> Need:
    ref = call.args[0]
    assert isinstance(ref, Ref)
    alias, name = (ref.name, None) if ref.owner is None else (ref.owner, ref.name)
    return Need(call.name if call.name in SET_FUNCTIONS else "list", alias, name)


def stage_plans(rule: Rule) -> list[StagePlan]:
    """One plan for each stage; those after the first read what the one before yields, as ``_in``."""
    plans = []
    for k, match in enumerate(rule.stages):
        last = k == len(rule.stages) - 1
        aliases = {b.alias: b.window for b in rule.binds} if k == 0 else {"_in": f"_{rule.name}_{k}"}
        filters = {b.alias: b.where for b in rule.binds} if k == 0 else {"_in": None}
        needs = needs_of(rule.score, rule.entity_id, *[e for _, e in rule.output.args]) if last else []
        plans.append(StagePlan(match, aliases, filters, [n for n in needs if n.alias in aliases], rule.limits if last else None, rule.name))
    return plans


def uses(step: Step, alias: str) -> bool:
    return any(b.source == alias for b in step.branches)
