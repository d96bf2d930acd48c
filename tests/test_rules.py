"""Scenarios of rules, written as tests in the rule language itself: doors, tills, boilers and parcels; the answers are worked out by hand."""

import pytest

from tidewatch.harness import run_tests
from tidewatch.lang.schema import parse_schemas

SCHEMAS = parse_schemas("""
window doors { stream = "badge" time = at over = 12h fields { badge: chars door: chars result: chars floor: digit at: time } }
window tills { stream = "sales" time = at over = 12h fields { till: chars clerk: chars kind: chars amount: float at: time } }
window boilers { stream = "telemetry" time = at over = 12h fields { boiler: chars part: chars degrees: float at: time } }
window parcels { stream = "parcels" time = at over = 12h fields { depot: chars parcel: chars state: chars grams: digit at: time } }
window desk { over = 0 fields { who: chars n: digit m: float how: chars note: chars } }
""")


def rows(alias, *each, **same):
    """A row for each dictionary, with the fields that are the same in all."""
    shown = lambda v: f'"{v}"' if isinstance(v, str) else str(v)
    return "".join(f"row({alias}, {', '.join(f'{k} = {shown(v)}' for k, v in {**same, **own}.items())}); " for own in each)


def swipes(badge, *doors, result="open"):
    return rows("d", *[{"door": x} for x in doors], badge=badge, result=result, floor=len(doors))


def sold(clerk, *amounts, kind="sale", alias="t"):
    return rows(alias, *[{"amount": a} for a in amounts], clerk=clerk, till="east", kind=kind)


def heat(boiler, *degrees, part="drum"):
    return rows("b", *[{"degrees": x} for x in degrees], boiler=boiler, part=part)


def parcel(state, *names, depot="north", grams=400):
    return rows(state, *[{"parcel": x} for x in names], depot=depot, state=state, grams=grams)


TAILGATE = """rule tailgate { events { d : doors && result == "open" && floor >= 0 } match<badge:20m> { on event { d.door | distinct | count > 3; } } -> score(10 + 5 * 9)
  entity(badge, d.badge) yield desk (who = d.badge, n = distinct(d.door), note = fmt("{} went everywhere", d.badge)) }"""
WALK = """rule walk { events { d : doors } match<badge:8m> { on event { d && door == "garage" | count >= 1; d && door in ("stairs", "lift") | count >= 2; d && door == "vault" | count >= 1; } }
  -> score(77) entity(badge, d.badge) yield desk (who = d.badge, how = last(d.door)) }"""
REFUNDS = """rule refunds { events { t : tills && kind == "refund" } match<clerk:45m:fixed> { on event { t | count >= 1; } and close { back: t.amount | sum > ${LIMIT:90}; worst: t.amount | max >= 25; } }
  -> score(if back > 150 then 95 else 55) entity(person, t.clerk) yield desk (who = t.clerk, m = back - worst, n = count(t)) }"""
TAKINGS = """rule takings { events { t : tills } match<till:2h:fixed> { on event { t | count >= 4; } on close { mean: t.amount | avg < 7.5; } } -> score(33) entity(till, t.till) yield desk (who = till, m = mean) }"""
FEVER = """rule fever { events { b : boilers && part in ("drum", "valve") } match<boiler:session(90s)> { on event { b | count >= 2; } and close { low: b.degrees | min >= 70; } } -> score(low)
  entity(boiler, b.boiler) yield desk (who = b.boiler, m = percentile(b.degrees, 50), n = count(b)) }"""
EITHER = """rule either { events { b : boilers } match<boiler:30m> { on event { hot: b.degrees | max > 120 || calm: b && part == "valve" | count >= 3; } } -> score(20) entity(boiler, b.boiler) yield desk (who = b.boiler, m = hot, n = calm) }"""
LOST = """rule lost { events { out : parcels && state == "out"  home : parcels && state == "home" }
  match<depot, parcel:3m> { on event { out | count >= 1; } and close { home && close_reason != "eos" | count == 0; } } -> score(61) entity(parcel, out.parcel) yield desk (who = out.parcel, how = close_reason) }"""
BUSIEST = """rule busiest { events { out : parcels && state == "out" } match<depot:6h:fixed> { on event { out | count >= 2; } and close { load: out.grams | sum >= 1; kinds: out.parcel | distinct | count >= 1; } } -> score(kinds)
  entity(depot, out.depot) yield desk (who = out.depot, m = load) conv { sort(-load, kinds) | top(3) | where(kinds > 1); } }"""
EACH = """rule each { events { t : tills } match<clerk:10m> { on event { t | count >= 2; } and close { t | count >= 2; } } -> score(5) entity(person, t.clerk) yield desk (who = t.clerk, how = close_reason) }"""


def test_text(name, rule, inputs, expect, options=""):
    return f"test {name} for {rule} {{ input {{ {inputs} }} expect {{ {expect} }} {'options { ' + options + ' }' if options else ''} }}"


test_text.__test__ = False

#: rule, name, inputs, what is expected, options.
CASES = [
    (TAILGATE, "four_doors", swipes("ann", "a", "b", "a", "c", "d"), 'hits == 1; hit[0].score == 55; hit[0].origin == "event"; hit[0].entity_type == "badge"; hit[0].field("n") == 4; hit[0].field("note") == "ann went everywhere";', ""),
    (TAILGATE, "three_doors_often", swipes("ann", *"abcabcabcabc"), "hits == 0;", ""),
    (TAILGATE, "shut_doors", swipes("ann", *"abcdefg", result="shut"), "hits == 0;", ""),
    (TAILGATE, "begins_again", swipes("ann", *"abcdefgh"), "hits == 2;", ""),  # the fourth door and, counted anew, the eighth
    (TAILGATE, "too_slow", swipes("ann", "a", "b") + "tick(20m);" + swipes("ann", "c", "d"), "hits == 0;", ""),
    (TAILGATE, "two_badges", swipes("ann", "a", "b", "c") + swipes("bob", "d", "e", "f"), "hits == 0;", ""),
    (WALK, "in_order", swipes("cy", "garage", "lift", "hall", "stairs", "vault"), 'hits == 1; hit[0].score == 77; hit[0].entity_id == "cy"; hit[0].field("how") == "vault";', ""),
    (WALK, "vault_first", swipes("cy", "vault", "garage", "lift", "stairs"), "hits == 0;", ""),
    (WALK, "one_floor_short", swipes("cy", "garage", "lift", "vault"), "hits == 0;", ""),
    (WALK, "steps_between", swipes("cy", "garage", "lift") + swipes("di", "garage") + swipes("cy", "lift", "vault") + swipes("di", "vault"), 'hits == 1; hit[0].entity_id == "cy";', ""),
    (WALK, "out_of_time", swipes("cy", "garage", "lift", "stairs") + "tick(8m);" + swipes("cy", "vault"), "hits == 0;", ""),
    (REFUNDS, "over", sold("eve", 40.5, 20, 31, kind="refund"), 'hits == 1; hit[0].score == 55; hit[0].field("m") == 51; hit[0].field("n") == 3; hit[0].origin == "close:eos";', ""),
    (REFUNDS, "far_over", sold("eve", 80, 80, kind="refund"), 'hits == 1; hit[0].score == 95; hit[0].field("m") == 80;', ""),
    (REFUNDS, "no_large_one", sold("eve", *[24] * 5, kind="refund"), "hits == 0;", ""),
    (REFUNDS, "sales_do_not_count", sold("eve", 60, kind="refund") + sold("eve", 500), "hits == 0;", ""),
    (REFUNDS, "two_windows", sold("eve", 60, kind="refund") + "tick(45m);" + sold("eve", 60, kind="refund"), "hits == 0;", ""),
    (TAKINGS, "both_ways", sold("flo", 3, 4, 5, 6, 7), 'hits == 2; hit[0].origin == "event"; hit[1].origin == "close:timeout"; hit[1].field("m") == 5;', "close_trigger = timeout;"),
    (TAKINGS, "only_close", sold("flo", 1, 2), 'hits == 1; hit[0].origin == "close:flush"; hit[0].field("m") == 1.5;', "close_trigger = flush;"),
    (TAKINGS, "only_event", sold("flo", 9, 9, 9, 9), 'hits == 1; hit[0].origin == "event";', ""),
    (FEVER, "one_session", heat("b1", 70, 90, 80), 'hits == 1; hit[0].score == 70; hit[0].field("m") == 80; hit[0].field("n") == 3;', ""),
    (FEVER, "cool_once", heat("b1", 99, 69, 99), "hits == 0;", ""),
    (FEVER, "two_sessions", heat("b1", 75, 76) + "tick(2m);" + heat("b1", 71, 72, 73), 'hits == 2; hit[0].score == 75; hit[0].origin == "close:timeout"; hit[1].score == 71; hit[1].field("n") == 3;', ""),
    (FEVER, "other_parts", heat("b1", 90, 90, part="door"), "hits == 0;", ""),
    (EITHER, "hot", heat("b2", 100, 121), 'hits == 1; hit[0].field("m") == 121;', ""),
    (EITHER, "calm", heat("b2", 1, 2, 3, part="valve"), 'hits == 1; hit[0].field("n") == 3;', ""),
    (EITHER, "neither", heat("b2", 1, 2, part="valve") + heat("b2", 3), "hits == 0;", ""),
    (LOST, "never_home", parcel("out", "p1"), 'hits == 1; hit[0].entity_id == "p1"; hit[0].field("how") == "timeout"; hit[0].origin == "close:timeout";', "close_trigger = timeout;"),
    (LOST, "came_home", parcel("out", "p1") + parcel("home", "p1"), "hits == 0;", "close_trigger = timeout;"),
    (LOST, "other_came", parcel("out", "p1", "p2") + parcel("home", "p2"), 'hits == 1; hit[0].entity_id == "p1";', "close_trigger = timeout;"),
    (LOST, "still_time", parcel("out", "p1"), "hits == 0;", ""),
    (LOST, "flushed", parcel("out", "p1"), 'hits == 1; hit[0].origin == "close:flush";', "close_trigger = flush;"),
    (
        BUSIEST, "three_of_five", parcel("out", "a", "b") + parcel("out", "a", "a", depot="south", grams=5000) + parcel("out", "c", "d", "e", depot="east", grams=300) + parcel("out", "f", "g", depot="west", grams=100) + parcel("out", "h", depot="mid", grams=9000),
        'hits == 2; hit[0].entity_id == "east"; hit[0].score == 3; hit[1].entity_id == "north"; hit[1].field("m") == 800;', "close_trigger = timeout;",
    ),
    (BUSIEST, "a_tie", parcel("out", "a", "b", "c", depot="x", grams=200) + parcel("out", "d", "e", depot="y", grams=300), 'hits == 2; hit[0].entity_id == "y"; hit[1].entity_id == "x";', ""),
    (EACH, "any_order", sold("ida", 1, 1) + sold("joe", 2, 2, 2) + sold("kim", 3), 'hits == 2; hit[0].field("how") == "eos";', "close_trigger = eos;"),
    (EACH, "by_time", sold("ida", 1, 1) + "tick(11m);" + sold("ida", 1), 'hits == 1; hit[0].field("how") == "timeout"; hit[0].score == 5;', ""),
    (EACH, "shuffled", sold("ida", 1, 2) + sold("joe", 1, 2) + sold("kim", 1, 2, 3), "hits == 3;", "permutation = shuffle; runs = 4;"),
]


@pytest.mark.parametrize("rule,name,inputs,expect,options", CASES, ids=[f"{c[0].split()[1]}-{c[1]}" for c in CASES])
def test_case(spark, rule, name, inputs, expect, options):
    text = rule + "\n" + test_text(name, rule.split()[1], inputs, expect, options)
    (outcome,) = run_tests(spark, text, SCHEMAS)
    assert outcome.failures == []


def test_fmt_keeps_the_whole_template(spark):
    """All that is left of a template after its arguments stays, and a null template is null."""
    from pyspark.sql import functions as F

    from tidewatch.functions.scalar import _fmt
    from tidewatch.functions.values import Value

    rows = [(1, "a{}" + "b{}" * 1500 + "end"), (2, "x"), (3, "{}"), (4, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r.s for r in df.select("k", _fmt([Value(F.col("t"), "str"), Value(F.lit("v"), "str")]).column.alias("s")).collect()}
    assert got == {1: "av" + "b{}" * 1500 + "end", 2: "x", 3: "v", 4: None}
