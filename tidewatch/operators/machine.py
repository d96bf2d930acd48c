"""The matching of one key's events, in order: the fold behind all that is no plain aggregate.

Used by the batch fold, the streaming processor, the rule tests and the verifier.  A window is closed before an
event is looked at if the event's time has reached its end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from ..functions.compile import constant, truth
from ..lang.ast import Branch, Expr
from ..plans.plan import StagePlan

MICROS = 1_000_000


@dataclass
class Tally:
    """What a branch has seen."""

    n: int = 0
    numbers: int = 0
    total: float = 0.0
    low: float = math.inf
    high: float = -math.inf
    low_text: str | None = None
    high_text: str | None = None
    seen: set[str] | None = None
    held: int = 0  # an estimate of the bytes of ``seen``

    def plain(self) -> int | tuple:
        """The tally as built-in types: its count, if that is all there is."""
        if not self.numbers and self.seen is None and self.low_text is None:
            return self.n
        return (self.n, self.numbers, self.total, self.low, self.high, self.low_text, self.high_text, self.seen, self.held)

    @staticmethod
    def of_plain(d: int | tuple) -> Tally:
        return Tally(*d) if isinstance(d, tuple) else Tally(d)

    def add(self, b: Branch, number: float | None, words: str | None) -> bool:
        """Takes a value in; false if it is skipped altogether."""
        if b.distinct:
            if words is None:
                return False
            self.seen = self.seen if self.seen is not None else set()
            if words in self.seen:
                return False
            self.seen.add(words)
            self.held += len(words) + 48
        self.n += 1
        if number is not None and not math.isnan(number):
            self.numbers += 1
            self.total += number
            self.low, self.high = min(self.low, number), max(self.high, number)
        elif words is not None and number is None:
            self.low_text = words if self.low_text is None else min(self.low_text, words)
            self.high_text = words if self.high_text is None else max(self.high_text, words)
        return True

    def measure(self, b: Branch) -> float:
        if b.measure == "count":
            return float(self.n)
        if b.measure == "sum":
            return self.total
        if b.measure == "avg":
            return self.total / self.numbers if self.numbers else 0.0
        return self.low if b.measure == "min" else self.high

    def holds(self, b: Branch, limit: float | str | bool | None) -> bool:
        got: float | str | None = self.measure(b)
        if isinstance(limit, str) and b.measure in ("min", "max"):
            got = self.low_text if b.measure == "min" else self.high_text
        if got is None or limit is None or isinstance(limit, bool) or isinstance(got, str) != isinstance(limit, str):
            return False
        return {"==": lambda: got == limit, "!=": lambda: got != limit, "<": lambda: got < limit, "<=": lambda: got <= limit, ">": lambda: got > limit, ">=": lambda: got >= limit}[b.cmp]()  # type: ignore[operator]


@dataclass
class Instance:
    """A window that is open."""

    created: int
    last: int
    step: int = 0
    done: list[tuple[int, float]] = field(default_factory=list)  # winning branch and measure of each step done
    tallies: dict[int, Tally] = field(default_factory=dict)
    close: dict[int, Tally] = field(default_factory=dict)
    needs: list[Any] = field(default_factory=list)
    emitted: bool = False
    ok: bool = False

    def restart(self, at: int, needs: int) -> None:
        self.created, self.step, self.done, self.tallies, self.close = at, 0, [], {}, {}
        self.needs, self.emitted, self.ok = [None] * needs, False, False

    def plain(self) -> tuple:
        """The window as built-in types."""
        tallies = {i: t.plain() for i, t in self.tallies.items()}
        close = {i: t.plain() for i, t in self.close.items()}
        return (self.created, self.last, self.step, self.done, tallies, close, self.needs, self.emitted, self.ok)

    @staticmethod
    def of_plain(d: tuple) -> Instance:
        created, last, step, done, tallies, close, needs, emitted, ok = d
        return Instance(created, last, step, done, {i: Tally.of_plain(t) for i, t in tallies.items()}, {i: Tally.of_plain(t) for i, t in close.items()}, needs, emitted, ok)


@dataclass
class Emission:
    origin: str
    fired: int
    last: int
    created: int
    end: int
    steps: list[tuple[int, float]]
    close: list[tuple[int, float]]
    needs: list[Any]


@dataclass
class Offer:
    """An event as one alias sees it: guard, number and text of each branch, and the needs' values."""

    alias: str
    ok: Sequence[bool | None]
    numbers: Sequence[float | None]
    words: Sequence[str | None]
    needs: Sequence[Any]


class Machine:
    """Matches the events of one stage; ``advance`` and ``close`` work on one key's open window."""

    def __init__(self, plan: StagePlan) -> None:
        self.plan = plan
        m = plan.match
        self.kind, self.length = m.window.kind, round(m.window.seconds * MICROS)
        self.branches = plan.branches
        self.limits = [constant(b.threshold) for b in self.branches]
        self.steps = [[plan.number(i, j) for j in range(len(s.branches))] for i, s in enumerate(m.steps)]
        self.close_steps = [[plan.number(i, j, True) for j in range(len(s.branches))] for i, s in enumerate(m.close_steps)]
        self.mode = m.close_mode

    def open(self, ts: int) -> Instance:
        created = ts - ts % self.length if self.kind == "fixed" else ts
        return Instance(created, ts, needs=[None] * len(self.plan.needs))

    def end(self, w: Instance) -> int:
        return (w.last if self.kind == "session" else w.created) + self.length

    def expired(self, w: Instance, now: int) -> bool:
        return now >= self.end(w)

    def idle(self, w: Instance) -> bool:
        """Whether a window is as good as one not yet open: a fixed one that tells nothing as it closes and has begun anew."""
        return self.kind == "fixed" and self.mode is None and not w.step and not w.tallies and all(v is None for v in w.needs)

    def take_needs(self, w: Instance, offer: Offer) -> None:
        for i, need in enumerate(self.plan.needs):
            if need.alias != offer.alias:
                continue
            v, old = offer.needs[i], w.needs[i]
            if need.kind == "count":
                w.needs[i] = (old or 0.0) + 1
            elif v is None or v != v:
                continue
            elif need.kind == "list":
                w.needs[i] = old if old is not None else []
                w.needs[i].append(v)
            elif need.kind == "distinct":
                w.needs[i] = old if old is not None else set()
                w.needs[i].add(v)
            elif need.kind == "avg":
                w.needs[i] = (old[0] + v, old[1] + 1) if old else (v, 1)
            else:
                w.needs[i] = v if old is None else {"sum": lambda: old + v, "min": lambda: min(old, v), "max": lambda: max(old, v)}[need.kind]()

    def offered(self, w: Instance, ts: int, offer: Offer) -> Emission | None:
        """Shows an event to the window; a match comes back when the last step is met."""
        w.last = max(w.last, ts)
        if self.plan.needs:
            self.take_needs(w, offer)
        for step in self.close_steps:
            for i in step:
                b = self.branches[i]
                if b.source == offer.alias and offer.ok[i] is not False:
                    w.close.setdefault(i, Tally()).add(b, offer.numbers[i], offer.words[i])
        if w.emitted or w.ok or w.step >= len(self.steps):
            return None
        for i in self.steps[w.step]:
            b = self.branches[i]
            if b.source != offer.alias or offer.ok[i] is not True:
                continue
            tally = w.tallies.setdefault(i, Tally())
            if tally.add(b, offer.numbers[i], offer.words[i]) and tally.holds(b, self.limits[i]):
                w.done.append((i, tally.measure(b)))
                w.step += 1
                return self.met(w, ts) if w.step == len(self.steps) else None
        return None

    def met(self, w: Instance, ts: int) -> Emission | None:
        if self.mode == "and":
            w.ok = True
            return None
        got = Emission("event", ts, ts, w.created, self.end(w), w.done, [], self.final(w))
        if self.mode == "or":
            w.emitted = True
        else:
            w.restart(w.created if self.kind == "fixed" else ts, len(self.plan.needs))
        return got

    def final(self, w: Instance) -> list[Any]:
        return [sorted(v) if isinstance(v, set) else list(v) if isinstance(v, list) else v for v in w.needs]

    def close(self, w: Instance, reason: str, fired: int) -> Emission | None:
        """What a window yields as it closes, if it qualifies."""
        if self.mode is None or (self.mode == "and" and not w.ok):
            return None
        got = []
        for step in self.close_steps:
            for i in step:
                b, tally = self.branches[i], w.close.get(i) or Tally()
                if truth(b.guard, {"close_reason": reason}) is not False if isinstance(b.guard, Expr) else True:
                    if tally.holds(b, self.limits[i]):
                        got.append((i, tally.measure(b)))
                        break
            else:
                return None
        return Emission(f"close:{reason}", fired, w.last, w.created, self.end(w), w.done, got, self.final(w))
