"""Rules on odd rows: nulls, ties, no rows, other types of keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.engine import Engine

SCHEMA = 'window a { stream = "s" time = at over = 5m fields { k: chars n: float at: time i: digit } } window o { over = 0 fields { k: chars n: float m: digit } }'
MATCHES = {
    "fold": "match<k:1m> { on event { e | count >= 2; } }",
    "close_agg": "match<k:1m:fixed> { on event { e | count >= 1; } and close { t: e.n | sum >= 0; } }",
    "modular": "match<k:1m:fixed> { on event { e | count >= 2; } }",
    "count_or_close": "match<k:1m:fixed> { on event { e | count >= 2; } on close { e.n | max > 1; } }",
    "session": "match<k:session(1m)> { on event { e | count >= 1; } and close { t: e.n | avg >= 0; } }",
    "global_fold": "match<k:1m:fixed> { on event { e | count >= 2; } }",
}


def run(spark, rows, name, score="1"):
    df = spark.createDataFrame(rows, "k string, n double, at timestamp, i bigint")
    tail = "limits { max_instances = 100; }" if name == "global_fold" else ""
    text = f"rule r {{ events {{ e : a }} {MATCHES[name]} -> score({score}) entity(user, k) yield o (k = k) {tail} }}"
    return Engine.of(SCHEMA, {"a": df}, {"a": "i"}).run(text)


def at(s):
    return datetime.datetime(2024, 1, 1, 0, 0, s)


@pytest.mark.parametrize("name", list(MATCHES))
def test_odd_rows(spark, name):
    rows = [("x", 1.0, at(1), 1), ("x", None, at(1), 2), ("x", float("nan"), at(2), 3), (None, 1.0, at(2), 4), ("y", 2.0, None, 5), ("y", 3.0, None, 6), ("", 1.0, at(3), 7), ("", 5.0, at(3), 7)]
    got = run(spark, rows, name).collect()
    assert {r.entity_id for r in got} <= {"x", "y", ""} and {"y", ""} <= {r.entity_id for r in got}


@pytest.mark.parametrize("name", list(MATCHES))
def test_no_rows(spark, name):
    assert run(spark, [], name).collect() == []


@pytest.mark.parametrize("name", list(MATCHES))
def test_order_of_rows_does_not_matter(spark, name):
    rows = [("xyz"[j % 3], float(j % 7), at(j * 7 % 60), j) for j in range(60)]
    plain = lambda df: sorted(map(str, df.drop("event_time").collect()))
    assert plain(run(spark, rows, name)) == plain(run(spark, rows[::-1], name))


@pytest.mark.parametrize("score,rows", [("0 / 0", 0), ("sqrt(0 - 1)", 0), ("0 - 5", 1), ("1000", 1), ("exp(1000)", 0)])
def test_scores(spark, score, rows):
    got = run(spark, [("x", 1.0, at(1), 1), ("x", 1.0, at(2), 2)], "fold", score).collect()
    assert len(got) == rows and all(0 <= r.score <= 100 for r in got)


def test_ids_tell_alerts_apart(spark):
    got = run(spark, [("xy"[j % 2], 1.0, at(j % 60), j) for j in range(120)], "fold")
    assert got.select("wfx_id").distinct().count() == got.count() > 5
    assert got.where(F.length("wfx_id") != 16).isEmpty()


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_are_in_order_of_events(spark, parts):
    """Sums and means, as measures and in the output, don't depend on how rows are dealt: they add up in order of events, as a fold does."""
    values = [float(v) for v in (1e16, 1, -1e16, 3, 0.1, 0.2, 0.3, 1e16, 0.7, -1e16)]
    rows = [(k, v, at(j), j) for k in "xyz" for j, v in enumerate(values)]
    df = spark.createDataFrame(rows[::-1], "k string, n double, at timestamp, i bigint").repartition(parts, "i")
    total = 0.0
    for v in values:
        total += v
    text = """rule r { events { e : a } match<k:1m:fixed> { on event { e | count >= 1; } and close { t: e.n | sum > -1; e.n | avg >= 0; } } -> score(t)
    entity(user, k) yield p (t = t, s = sum(e.n), a = avg(e.n)) }"""
    schema = SCHEMA + " window p { over = 0 fields { t: float s: float a: float } }"
    got = Engine.of(schema, {"a": df}, {"a": "i"}).run(text).select("entity_id", "t", "s", "a").collect()
    assert sorted(map(tuple, got)) == [(k, total, total, total / len(values)) for k in "xyz"]
