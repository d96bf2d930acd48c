"""A rule in words: what it reads, how it matches, which strategy runs it, and where each output field comes from."""

from __future__ import annotations

from ..plans.plan import stage_plans
from .ast import Bin, Bool, Call, Expr, If, In, Neg, Num, Ref, Rule, Str


def show(e: Expr) -> str:
    """An expression as it would be written."""
    if isinstance(e, Num):
        return str(int(e.value)) if e.value == int(e.value) else str(e.value)
    if isinstance(e, Str):
        return f'"{e.value}"'
    if isinstance(e, Bool):
        return str(e.value).lower()
    if isinstance(e, Ref):
        return f"{e.owner}.{e.name}" if e.owner else e.name
    if isinstance(e, Neg):
        return f"-{show(e.of)}"
    if isinstance(e, Bin):
        return f"({show(e.left)} {e.op} {show(e.right)})"
    if isinstance(e, In):
        return f"{show(e.what)} {'not ' if e.negated else ''}in ({', '.join(map(show, e.items))})"
    if isinstance(e, If):
        return f"if {show(e.cond)} then {show(e.then)} else {show(e.other)}"
    assert isinstance(e, Call)
    return f"{e.owner + '.' if e.owner else ''}{e.name}({', '.join(map(show, e.args))})"


def lineage(rule: Rule) -> dict[str, list[str]]:
    """For each output field (and score and entity) the fields it is made from."""
    window = {b.alias: b.window for b in rule.binds}

    def sources(e: Expr) -> list[str]:
        refs = [x for x in e.walk() if isinstance(x, Ref)]
        return sorted({f"{window.get(r.owner or '', r.owner)}.{r.name}" if r.owner else window.get(r.name, r.name) for r in refs})

    return {"score": sources(rule.score), "entity": sources(rule.entity_id), **{n: sources(e) for n, e in rule.output.args}}


def explain(rule: Rule) -> str:
    lines = [f"rule {rule.name}", "  reads:"]
    lines += [f"    {b.alias}: {b.window}" + (f" where {show(b.where)}" if b.where else "") for b in rule.binds]
    for k, plan in enumerate(stage_plans(rule)):
        m = plan.match
        keys = ", ".join(plan.key_names) or "nothing"
        lines.append(f"  stage {k + 1}: by {keys}, {m.window.kind} window of {m.window.seconds:g} s, run as {plan.strategy}")
        for title, steps in (("event", m.steps), (f"{m.close_mode} close", m.close_steps)):
            for i, s in enumerate(steps):
                each = [f"{b.label + ': ' if b.label else ''}{b.source}{'.' + b.field if b.field else ''}{' where ' + show(b.guard) if b.guard else ''} {'distinct ' if b.distinct else ''}{b.measure} {b.cmp} {show(b.threshold)}" for b in s.branches]
                lines.append(f"    {title} step {i + 1}: {' or '.join(each)}")
        lines += [f"    join {j.window} {j.mode}{f' within {j.within:g} s' if j.within else ''} on {' and '.join(f'{show(a)} = {show(b)}' for a, b in j.on)}" for j in m.joins]
    lines.append(f"  score: {show(rule.score)}")
    lines.append(f"  entity: {rule.entity_type} {show(rule.entity_id)}")
    lines.append(f"  output: {rule.output.target}")
    lines += [f"    {n} = {show(e)}" for n, e in rule.output.args]
    for chain in rule.conv:
        lines.append("  conv: " + " | ".join(f"top({op.n})" if op.kind == "top" else f"{op.kind}({', '.join(map(show, op.args))})" for op in chain))
    if rule.limits:
        lines.append(f"  limits: {rule.limits}")
    lines.append("  comes from:")
    lines += [f"    {n}: {', '.join(s) or 'constants'}" for n, s in lineage(rule).items()]
    return "\n".join(lines)
