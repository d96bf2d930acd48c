"""Reading, checking and explaining rules."""

import pytest

from tidewatch.functions.compile import constant
from tidewatch.lang.checker import problems, version_changes
from tidewatch.lang.explain import explain, lineage, show
from tidewatch.lang.layout import layout
from tidewatch.lang.lint import hints
from tidewatch.lang.preprocess import substitute
from tidewatch.lang.rule import expand_patterns, parse_expression, parse_rules
from tidewatch.lang.schema import parse_schemas
from tidewatch.lang.tokens import RuleError, seconds

S = parse_schemas('window a { stream = "x" time = t over = 5m fields { t: time k: digit s: chars f: float `d.e`: chars l: array/chars } } window o { over = 0 fields { k: digit s: chars } }')


def rule(match="match<k:5m> { on event { e | count >= 1; } }", bind="e : a", out="k = k", score="1", tail=""):
    return parse_rules(f"rule r {{ events {{ {bind} }} {match} -> score({score}) entity(user, k) yield o ({out}) {tail} }}").rules[0]


@pytest.mark.parametrize("text,value", [("30s", 30), ("5m", 300), ("2h", 7200), ("1d", 86400)])
def test_durations(text, value):
    assert seconds(text) == value


@pytest.mark.parametrize("text,shown", [
    ("1 + 2 * 3", "(1 + (2 * 3))"), ("a.b == 'x'".replace("'", '"'), '(a.b == "x")'), ('e["d.e"] in ("x", "y")', 'e.d.e in ("x", "y")'), ("x not in (1, 2) && y || z", "((x not in (1, 2) && y) || z)"),
    ("if a > 1 then 2 else -3", "if (a > 1) then 2 else -3"), ("w.has(f(x), \"k\")", 'w.has(f(x), "k")'), ("5m", "300"),
])
def test_expressions(text, shown):
    assert show(parse_expression(text)) == shown


@pytest.mark.parametrize("text", ["1 +", "(a", "a b", 'x in 1', "rule"])
def test_bad_expressions(text):
    if text == "rule":
        with pytest.raises(RuleError):
            parse_rules("rule {")
    else:
        with pytest.raises(RuleError):
            parse_expression(text)


def test_variables():
    assert substitute("a ${X:3} $Y $$ \"${X}\" // $Z", {"Y": "q"}) == 'a 3 q $ "${X}" // $Z'
    with pytest.raises(RuleError):
        substitute("${X}", {})


def test_patterns():
    text = "pattern p(a, n) { ${a} | count >= ${n}; } rule { p(x, 3) }"
    assert expand_patterns(text).split() == "rule { x | count >= 3; }".split()
    with pytest.raises(RuleError):
        expand_patterns("pattern p(a) { ${a} } p(1, 2)")


@pytest.mark.parametrize("bad", [
    "window a { over = 5m fields { k: digit } }", "window a { over = 0 fields { k: nothing } }", "window a { over = 0 fields { k: digit } } window a { over = 0 fields { } }", "window a { over = 0 fields { k: digit k: digit } }",
])
def test_bad_schemas(bad):
    with pytest.raises(RuleError):
        parse_schemas(bad)


@pytest.mark.parametrize("code,given", [
    ("EV3", {"bind": "e : nowhere"}), ("EV4", {"bind": "e : o"}), ("K1", {"match": "match<z:5m> { on event { e | count >= 1; } }"}), ("R3", {"match": "match<k:5m> { on event { q | count >= 1; } }"}),
    ("T1", {"match": "match<k:5m> { on event { e | distinct | count >= 1; } }"}), ("T2", {"match": "match<k:5m> { on event { e.s | count >= 1; } }"}), ("T3", {"match": "match<k:5m> { on event { e.s | sum >= 1; } }"}),
    ("T6", {"match": 'match<k:5m> { on event { e.f | max >= "x"; } }'}), ("T5", {"match": "match<k:5m> { on event { e.f | max >= k; } }"}), ("T7", {"match": "match<k:5m> { on event { e && count(e) > 1 | count >= 1; } }"}),
    ("T8", {"bind": 'e : a && close_reason == "eos"'}), ("T16", {"bind": "e : a && s == 1"}), ("T20", {"out": "k = nothing(k)"}), ("T21", {"out": "s = substr(s)"}), ("T22", {"out": "s = substr(k, 1)"}), ("T23", {"out": 's = replace(e.s, "(", "")'}), ("T23", {"out": 's = replace(e.s, "(?=x)", "")'}),
    ("Y1", {"tail": ""}), ("Y4", {"out": "zz = 1"}), ("Y5", {"out": "s = k"}), ("C1", {"tail": "conv { top(1); }"}), ("L1", {"tail": 'limits { on_exceed = "never"; }'}), ("L2", {"tail": 'limits { max_throttle = "many"; }'}), ("S1", {"score": "s"}),
    ("T17", {"bind": "e : a && o.got(k)"}), ("T17", {"bind": "e : a && o.has()"}), ("T18", {"bind": 'e : a && o.has(k, "z")'}), ("T18", {"bind": "e : a && o.has(k, s)"}), ("T24", {"out": "k = count(e.s)"}), ("T25", {"out": "k = sum(e)"}), ("T26", {"out": "k = avg(e.s)"}),
    ("T26", {"out": "k = max(e.l)"}), ("T27", {"out": "k = percentile(e.f, 101)"}), ("T27", {"out": "k = percentile(e.f)"}), ("R5", {"out": "k = sum(e.zz)"}), ("T28", {"bind": "e : a && baseline(f) > 1"}), ("T28", {"bind": "e : a && baseline(s, 5m) > 1"}),
    ("T28", {"bind": "e : a && baseline(f, 0 - 1) > 1"}), ("T29", {"bind": 'e : a && baseline(f, 5m, "mode") > 1'}), ("T30", {"out": "s = coalesce(s, k)"}), ("T31", {"out": 's = replace(s, concat("a", s), "")'}), ("Y8", {"out": "k = k", "tail": ""}),
    ("K4", {"match": "match<k:5m> { key { k = k; } on event { e | count >= 1; } }"}), ("K5", {"match": "match<k:5m> { key { k = q.k; } on event { e | count >= 1; } }"}), ("L2", {"tail": 'limits { max_throttle = "0/min"; }'}), ("L4", {"tail": 'limits { max_memory = "50 bananas"; }'}),
    ("L5", {"tail": 'limits { max_memory = "0MB"; }'}), ("P1", {"match": "match<k:5m> { on event { e | count >= 1; e | count >= 2; } } |> match<k:9m> { on event { _in | count >= 1; } }", "out": "k = 1"}),
])
def test_checks(code, given):
    if code == "Y8":
        r = parse_rules("rule r { events { e : a } match<k:5m> { on event { e | count >= 1; } } -> score(1) entity(user, k) yield o@v2 (k = k) }").rules[0]
    else:
        r = rule(**given)
    schemas = {"a": S["a"]} if code == "Y1" else S
    assert any(p.startswith(code + ":") for p in problems(r, schemas)), problems(r, schemas)


@pytest.mark.parametrize("span,sound", [("1d", True), ("5m", True), ("30s", True), ("500ms", True), ("86400", True), ("2 * 12h", True), ("0s", False), ("0", False), ("-1d", False), ("f", False)])
def test_spans_of_baselines(span, sound):
    found = problems(rule(match=f"match<k:5m> {{ on event {{ e && baseline(f, {span}) > 1 | count >= 1; }} }}"), S)
    assert [p[:4] for p in found] == ([] if sound else ["T28:"]), found


@pytest.mark.parametrize("text,value", [("1d", 86400.0), ("-5m", -300.0), ("2 * 12h", 86400.0), ("1h / 60", 60.0)])
def test_durations_are_numbers(text, value):
    assert constant(parse_expression(text)) == value and isinstance(constant(parse_expression(text)), float)


def test_entities_and_versions():
    bad = parse_rules("rule r { events { e : a } match<k:5m> { on event { e | count >= 1; } } -> score(1) entity(user, collect_list(e.s)) yield o (k = k) }").rules[0]
    assert any(p.startswith("S2") for p in problems(bad, S))
    text = "".join(f'rule r{i} {{ meta {{ contract_version = "{v}" }} events {{ e : a }} match<k:5m> {{ on event {{ e | count >= 1; }} }} -> score(1) entity(user, k) yield o@v{v} ({out}) }}\n' for i, (v, out) in enumerate([(1, "k = k"), (2, 's = "x"'), (1, "k = 2")]))
    assert version_changes(parse_rules(text).rules) == ["V1: output o: s is new in version 2", "V2: output o: k of version 1 is gone in version 2"]


def test_sound_rule_has_no_problems():
    assert problems(rule(out='k = k, s = fmt("{}", k)'), S) == []


def test_hints():
    got = hints(rule(match="match<:9m> { on event { e | count >= 0; } }", out='s = fmt("{} {}", k)'), S)
    assert {h[:4] for h in got} == {"W002", "W003", "W004", "W005", "W006"}
    assert any(h.startswith("W001") for h in hints(rule(bind="e : a f : a"), S))


def test_explain_and_lineage():
    r = rule(bind="e : a && f > 1", out="k = e.k, s = concat(e.s, e[\"d.e\"])")
    assert "where (f > 1)" in explain(r) and "run as fold" in explain(r)
    assert lineage(r)["s"] == ["a.d.e", "a.s"]


def test_layout():
    assert layout("rule r {\n\n\nevents {\ne : a\n}\n}") == "rule r {\n\n    events {\n        e : a\n    }\n}\n"


def test_parts_of_a_rule():
    f = parse_rules("""use "x.schema" rule r { meta { contract_version = "2" } events { e : a } match<k:session(5m)> { key { k = e.k; } on event { x: e.f && f > 1 | distinct | sum > 1 + 2 || e | count >= 1; } on close { e | count == 0; } } -> score(1)
      join o asof within 5m on k == o.k && s == o.s entity("Host", k) yield o@v3 (k = k) limits { max_instances = 5; max_throttle = "10/min"; } }
      test t for r { input { row(e, k = 1); tick(5m); } expect { hits >= 1; hit[0].score == 1; } options { close_trigger = flush; } }""")
    r = f.rules[0]
    assert r.entity_type == "host" and r.output.version == 3 and r.stages[0].window.kind == "session" and r.limits.throttle() == (10, 60.0)
    assert len(r.stages[0].steps[0].branches) == 2 and r.stages[0].joins[0].within == 300 and f.tests[0].inputs[1].seconds == 300
    assert any(p.startswith("Y7") for p in problems(r, S))
