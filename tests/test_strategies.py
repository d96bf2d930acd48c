"""The native strategies give what the ordered fold gives, on random events."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.engine import Engine
from tidewatch.operators import bind, match
from tidewatch.plans.plan import stage_plans

SCHEMA = 'window a { stream = "s" time = at over = 5d fields { k: chars c: chars n: float at: time i: digit } } window o { over = 0 fields { k: chars n: digit m: float t: chars } }'
OUT = "-> score(1) entity(user, k) yield o (k = k)"
NEEDS = '-> score(1) entity(user, k) yield o (n = count(e), m = sum(e.n), t = fmt("{} {} {} {}", avg(e.n), min(e.n), distinct(e.c), mvjoin(collect_list(e.c), "")))'
RULES = {
    "close_count": ("close_agg", f"match<k:10s:fixed> {{ on event {{ e | count >= 2; }} and close {{ x: e.n | sum > 3; }} }} {OUT}"),
    "close_many": ("close_agg", f'match<k:10s:fixed> {{ on event {{ e && c == "a" | count > 1; }} and close {{ e.n | avg < 5; e.c | distinct | count >= 2 || e.n | max > 8; e.n | min >= 0; }} }} {OUT}'),
    "close_needs": ("close_agg", f"match<k:10s:fixed> {{ on event {{ e | count >= 1; }} and close {{ e | count >= 1; }} }} {NEEDS}"),
    "close_distinct": ("close_agg", f"match<k:10s:fixed> {{ on event {{ d: e.c | distinct | count >= 2; }} and close {{ e | count != 3; }} }} {OUT}"),
    "close_reason": ("close_agg", f'match<k:10s:fixed> {{ on event {{ e | count >= 1; }} and close {{ e && close_reason == "eos" && n > 2 | count >= 1 || e && close_reason == "timeout" | count > 2; }} }} {OUT}'),
    "close_text": ("close_agg", f'match<k:10s:fixed> {{ on event {{ e | count >= 1; }} and close {{ e.c | max == "c"; }} }} {OUT}'),
    "sessions": ("close_agg", f"match<k:session(3s)> {{ on event {{ e | count >= 2; }} and close {{ e.c | distinct | count >= 2; e.n | sum > 1; }} }} {NEEDS}"),
    "keyless": ("close_agg", f"match<:10s:fixed> {{ on event {{ e | count >= 2; }} and close {{ e | count >= 2; }} }} -> score(1) entity(user, \"all\") yield o (n = count(e))"),
    "repeats": ("modular", f"match<k:10s:fixed> {{ on event {{ e && n > 1 | count >= 3; }} }} {OUT}"),
    "or_close": ("count_or_close", f"match<k:10s:fixed> {{ on event {{ x: e | count >= 3; }} on close {{ y: e.n | sum > 6; }} }} {OUT}"),
}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", list(RULES))
def test_strategy_equals_fold(spark, name, seed):
    r = random.Random(seed)
    rows = [(r.choice(["x", "y", "z", None]), r.choice("abc"), r.choice([None, *map(float, range(10))]), r.randrange(60) + r.choice([0.0, 0.5]), j) for j in range(300)]
    df = spark.createDataFrame(rows, "k string, c string, n double, s double, i bigint").withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("bigint") + 1_700_000_000_000_000)).drop("s")
    strategy, body = RULES[name]
    engine = Engine.of(SCHEMA, {"a": df}, {"a": "i"})
    (rule,) = engine.rules(f"rule r {{ events {{ e : a }} {body} }}")
    (plan,) = stage_plans(rule)
    assert plan.strategy == strategy
    events = bind.bind(plan, engine.tables, engine.schemas, engine.order)
    rounded = lambda v: round(v, 9) if isinstance(v, float) else [rounded(x) for x in v] if isinstance(v, list) else v
    plain = lambda out: sorted(str([rounded(v) for v in row]) for row in out.select(sorted(out.columns)).collect())
    native, folded = plain(match.run(plan, events)), plain(match.fold(plan, events, "eos"))
    assert native == folded and len(native) > 0
