"""Hints on rules that are right but perhaps not what is meant."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.compile import constant
from .ast import Call, Rule, Str, WindowSchema


def hints(rule: Rule, schemas: Mapping[str, WindowSchema]) -> list[str]:
    found = []
    used = {b.source for m in rule.stages for s in (*m.steps, *m.close_steps) for b in s.branches}
    for b in rule.binds:
        if b.alias not in used:
            found.append(f"W001: alias {b.alias} is in no step")
    if rule.limits is None:
        found.append("W002: no limits are set")
    for m in rule.stages:
        if not m.keys and not m.key_map:
            found.append("W003: without keys all events share one window")
        for s in m.steps:
            for b in s.branches:
                c = constant(b.threshold)
                if b.measure == "count" and isinstance(c, float) and ((b.cmp == ">=" and c <= 0) or (b.cmp == ">" and c < 0)):
                    found.append("W004: a count is always met")
        for bind in rule.binds:
            w = schemas.get(bind.window)
            if w and w.over and m.window.seconds > w.over:
                found.append(f"W005: the window is longer than {w.name} keeps its events")
    for _, e in rule.output.args:
        for x in e.walk():
            if isinstance(x, Call) and x.name == "fmt" and x.args and isinstance(x.args[0], Str) and x.args[0].value.count("{}") != len(x.args) - 1:
                found.append("W006: fmt has more or fewer places than arguments")
    return found
