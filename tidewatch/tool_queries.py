"""Registered queries of sources, sinks, tools and generators: each runs its part over the test tables, or over texts of its own, with the SQL that gives the same rows."""

from __future__ import annotations

import pathlib
import urllib.parse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .gen import output, scenario, traffic, verify
from .harness import run_tests
from .lang import checker, explain, layout, lint, preprocess
from .lang.rule import parse_rules
from .lang.schema import parse_schemas
from .operators import bind, match
from .plans.plan import stage_plans
from .queries import DAY, ORACLES, ORDER, QUERIES, SCHEMAS, engine, ev, live, query, scratch, stamp, text_of
from .sources import metrics, readers, sinks
from .streaming import memory
from .streaming.processor import stream_alerts

WINDOWS = parse_schemas(SCHEMAS)


def table(spark: SparkSession, shape: str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), shape)


def values(names: str, *rows: tuple) -> str:
    """SQL of rows written out; texts are quoted, whole numbers are bigint."""
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


def _lines(spark: SparkSession, sf_dir: str, name: str = "events") -> str:
    """The folder that a table's rows were written to as JSON lines."""
    path = scratch(spark, "lines")
    df = engine(spark, sf_dir).tables[name].withColumn("arrival", F.col(ORDER[name]))
    output.write_lines({name: df.withColumn("ts", F.col("ts").cast("timestamp"))}, WINDOWS, path)
    return path


# Sources.

_EVENT = "event_id, user_id, event_type, value, props"


@query("source_lines", f"SELECT {_EVENT}, epoch_us(ts) AS us FROM events")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read again, among lines of another stream and lines that are no JSON."""
    path = _lines(spark, sf_dir)
    other = table(spark, "value string", [('{"_stream": "elsewhere", "event_id": 1}',), ("{ broken",), ("",)])
    other.write.mode("append").text(path)
    return readers.ndjson(spark, path, {"events": WINDOWS["events"]})["events"].selectExpr(*_EVENT.split(", "), "unix_micros(ts) AS us")


@query("source_bad_lines", values("bad, good", (2, 3)))
def source_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bad")
    table(spark, "value string", [('{"_stream": "events", "event_id": 7, "ts": 5000}',), ('{"event_id": "8"}',), ('{"_stream": "events"}',), ("{ broken",), ("nothing",), (" ",)]).write.text(path)
    good = readers.ndjson(spark, path, {"events": WINDOWS["events"]})["events"].count()
    return table(spark, "bad bigint, good bigint", [(readers.bad_lines(spark, path), good)])


@query("source_tcp", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, min(epoch_us(ts)) AS first_us FROM events GROUP BY event_type")
def source_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent in frames to receivers, which keep them as files for executors to read."""
    folder = scratch(spark, "tcp")
    own = urllib.parse.urlparse(folder).path or folder
    pathlib.Path(own).mkdir(parents=True, exist_ok=True)
    events = engine(spark, sf_dir).tables["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    output.land({"events": events}, WINDOWS, own)
    got = readers.arrow_ipc(spark, f"{folder}/events", WINDOWS["events"])
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.min(F.unix_micros("ts")).alias("first_us"))


@query("source_rows", values("who, what, us, seq", ("3", "in", 1_000_000, 0), ("4", None, 2_500_000, 1), (None, "out", 2_500_000, 2)))
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by hand, on a clock."""
    got = readers.rows(spark, WINDOWS["both"], [{"who": 3, "what": "in"}, {"who": 4.0}, {"what": "out"}], [1_000_000, 2_500_000, 2_500_000])
    return got.select(F.col("who").cast("string").alias("who"), "what", F.unix_micros("ts").alias("us"), F.col("_seq").alias("seq"))


@query(
    "source_route",
    """SELECT 'events' AS "window", count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'both', (SELECT count(*) FROM events) + (SELECT count(*) FROM orders)""",
)
def source_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several streams go to the windows that subscribe to them."""
    tables = engine(spark, sf_dir).tables
    rows = tables["events"].select("ts", "event_id", F.lit("events").alias("_stream")).unionByName(tables["orders"].select(F.col("o_orderdate").alias("o_orderdate"), "o_orderkey", F.lit("orders").alias("_stream")), allowMissingColumns=True)
    rows = rows.unionByName(table(spark, "_stream string", [("nobody",)]), allowMissingColumns=True)
    got = readers.route(rows, {n: WINDOWS[n] for n in ("events", "orders", "both")})
    out = None
    for name, df in got.items():
        one = df.select(F.lit(name).alias("window")).groupBy("window").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# Sinks.


@query("sink_lines", f"SELECT entity_id, score, origin, fired_at, n, 'env:test,kind:x' AS tags FROM ({ORACLES['fixed_count_close']})")
def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written as JSON lines with a sink's tags, twice as the same batch, and read again."""
    alerts, path = QUERIES["fixed_count_close"](spark, sf_dir), scratch(spark, "sink")
    sink = sinks.Sink("s", path, tags={"kind": "x", "env": "test"}, parallel=2)
    for _ in range(2):
        sink.write(alerts, batch=0)
    return spark.read.json(path).select("entity_id", "score", "origin", "fired_at", "n", F.array_join("tags", ",").alias("tags"))


_SINKS = """
[defaults]
tags = ["env:test", "team:a"]
[[connector]]
id = "files"
params = { path = "base", format = "json" }
allow_override = ["path"]
tags = ["team:b"]
[[route]]
name = "security"
windows = ["sec_*", "auth?"]
connect = "files"
params = { path = "elsewhere" }
tags = ["kind:x"]
parallel = 99
required = true
[default]
connect = "files"
"""


@query("sink_config", values("name, path, format, tags, parallel, required, takes", ("security", "elsewhere", "json", "env:test,kind:x,team:b", 10, True, "auth1 sec_a"), ("default", "base", "json", "env:test,team:b", 0, False, "other")))
def sink_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes, found = sinks.load_config(_SINKS)
    names = ["sec_a", "auth1", "other"]
    takes = {n: sorted(x for x in names if any(sinks.matches(p, x) for p in ps)) for n, ps in routes.groups}
    takes["default"] = [x for x in names if not any(x in t for t in takes.values())]
    rows = [(s.name, s.path, s.format, ",".join(f"{k}:{v}" for k, v in sorted(s.tags.items())), s.parallel or 0, s.required, " ".join(takes[n])) for n, s in found.items()]
    return table(spark, "name string, path string, format string, tags string, parallel bigint, required boolean, takes string", rows)


@query("sink_metrics", "SELECT 'events_total{of=\"' || event_type || '\"}' AS metric, count(*)::DOUBLE AS value FROM events GROUP BY event_type UNION ALL SELECT 'events_total{of=\"all\"}', count(*)::DOUBLE FROM events")
def sink_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the rows that pass, as the text for scraping tells them."""
    m, events = metrics.Metrics(), engine(spark, sf_dir).tables["events"]
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]
    seen, counts = m.watched(events, "events", {k: f"event_type = '{k}'" for k in kinds})
    seen.write.format("noop").mode("overwrite").save()
    m.counted("events", counts)
    lines = [line.rsplit(" ", 1) for line in m.text().splitlines() if not line.startswith("#")]
    return table(spark, "metric string, value double", [(name, float(v)) for name, v in lines])


@query("alert_ids", f"""SELECT substr(sha256('ids' || chr(0) || user_id || chr(0) || {stamp("ts")} || chr(0) || 'step0=0x1.0p0' || chr(0) || 'event'), 1, 16) AS wfx_id, user_id::VARCHAR AS entity_id, {stamp("ts")} AS fired_at FROM events WHERE event_type = 'error'""")
def alert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of alerts, which are the same for the same rule, keys, time, measures and origin."""
    text = 'rule ids { events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) }'
    return engine(spark, sf_dir).run(text).select("wfx_id", "entity_id", "fired_at")


# What windows hold.


@query("memory_newest", """SELECT event_id FROM (SELECT event_id, sum(16 + 8 * 4 + strlen(event_type) + strlen(props)) OVER (ORDER BY ts DESC, event_id DESC) AS upto FROM events) WHERE upto <= 40000""")
def memory_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events that fit a window's budget of bytes."""
    df = engine(spark, sf_dir).tables["events"].select("event_id", "ts", "user_id", "event_type", "value", "props")
    return memory.newest(df, "ts", 40_000, "event_id").select("event_id")


@query(
    "memory_total",
    """WITH e AS (SELECT event_id AS id, ts AS t, 16 + 8 * 2 + strlen(event_type) AS b FROM events), o AS (SELECT o_orderkey AS id, o_orderdate AS t, 16 + 8 * 2 + strlen(o_orderstatus) AS b FROM orders),
    s AS (SELECT (SELECT sum(b) FROM e) AS x, (SELECT sum(b) FROM o) AS y), l AS (SELECT CASE WHEN x + y <= 60000 THEN greatest(x, y) WHEN least(x, y) * 2 <= 60000 THEN 60000 - least(x, y) ELSE 30000 END AS top FROM s)
    SELECT 'events' AS "window", id FROM (SELECT id, sum(b) OVER (ORDER BY t DESC, id DESC) AS upto FROM e), l WHERE upto <= top
    UNION ALL SELECT 'orders', id FROM (SELECT id, sum(b) OVER (ORDER BY t DESC, id DESC) AS upto FROM o), l WHERE upto <= top""",
)
def memory_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that share a budget of bytes: the largest gives way first."""
    t = engine(spark, sf_dir).tables
    windows = {"events": t["events"].select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type"), "orders": t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), "o_orderstatus")}
    got = memory.within(windows, dict.fromkeys(windows, "at"), 60_000, dict.fromkeys(windows, "id"))
    return got["events"].select(F.lit("events").alias("window"), "id").unionByName(got["orders"].select(F.lit("orders").alias("window"), "id"))


# Tools.

_RULE = "rule {name} {{ events {{ {bind} }} match<user_id:{length}> {{ on event {{ e | {measure}; }} }} -> score({score}) entity(user, {who}) yield alerts ({out}) {tail} }}"


def made(name: str, bind: str = "e : events", length: str = "1d", measure: str = "count >= 1", score: str = "1", who: str = "user_id", out: str = "n = 1", tail: str = 'limits { max_throttle = "9/h"; }') -> str:
    return _RULE.format(name=name, bind=bind, length=length, measure=measure, score=score, who=who, out=out, tail=tail)


_WRONG = [
    made("good"), made("window", bind="e : nowhere"), made("output", bind="e : alerts"), made("key", bind="e : customer"), made("score", score="event_type"), made("field", out="zz = 1"), made("kind", out="label = value > 1"),
    made("function", out="n = nothing(1)"), made("arguments", out="label = substr(event_type)"), made("pattern", out='label = replace(event_type, "(", "")'), made("rate", tail='limits { max_throttle = "often"; }'), made("memory", tail='limits { max_memory = "0MB"; }'),
    made("conv", tail="conv { top(1); }"), made("entity", who="collect_list(e.event_type)"), made("summed", out="m = sum(e.event_type)"), made("guard", bind="e : events && count(e) > 1"), made("reason", bind='e : events && close_reason == "eos"'),
]


@query(
    "tool_check",
    values(
        "rule, codes", ("good", ""), ("window", "EV3,K1,R6"), ("output", "EV4,K1,R6"), ("key", "K1,R6"), ("score", "S1"), ("field", "Y4"), ("kind", "Y5"), ("function", "T20"), ("arguments", "T21"), ("pattern", "T23"), ("rate", "L2"), ("memory", "L5"), ("conv", "C1,C2"),
        ("entity", "S2"), ("summed", "T26"), ("guard", "T7"), ("reason", "T8"),
    ),
)
def tool_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of what is wrong with each of some rules."""
    rules = [r for text in _WRONG for r in parse_rules(text).rules]
    return table(spark, "rule string, codes string", [(r.name, ",".join(sorted({p.split(":")[0] for p in checker.problems(r, WINDOWS)}))) for r in rules])


@query("tool_lint", values("rule, hints", ("plain", ""), ("unused", "W001"), ("unlimited", "W002"), ("keyless", "W003"), ("always", "W004"), ("long", "W005"), ("places", "W006")))
def tool_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [
        made("plain"), made("unused", bind="e : events f : events"), made("unlimited", tail=""), made("keyless").replace("match<user_id:", "match<:"), made("always", measure="count >= 0"), made("long", length="500d"), made("places", out='label = fmt("{} {}", 1)'),
    ]
    return table(spark, "rule string, hints string", [(r.name, ",".join(h[:4] for h in lint.hints(r, WINDOWS))) for text in texts for r in parse_rules(text).rules])


@query("tool_explain", values("output, comes_from", ("score", "events.value"), ("entity", "user_id"), ("n", "events"), ("m", "events.event_id,events.value"), ("label", "")))
def tool_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields each part of an alert is made from."""
    (rule,) = parse_rules(made("told", score="first(e.value)", out='n = count(e), m = sum(e.value) + max(e.event_id), label = "x"')).rules
    assert "rule told" in explain.explain(rule)
    return table(spark, "output string, comes_from string", [(n, ",".join(s)) for n, s in explain.lineage(rule).items()])


@query("tool_layout", values("line, text", (0, "rule r {"), (1, "    events {"), (2, '        e : events && event_type == "}"  // {'), (3, "    }"), (4, ""), (5, "}")))
def tool_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'rule r {\n  events {\n e : events && event_type == "}"  // {\n}\n\n\n\n     }\n\n'
    return table(spark, "line bigint, text string", list(enumerate(layout.layout(text).splitlines())))


@query("tool_variables", values("text", ('a 3 q $ "${X:3}" // $Z',)))
def tool_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "text string", [(preprocess.substitute('a ${X:3} $Y $$ "${X:3}" // $Z', {"Y": "q"}),)])


@query("tool_tests", values("test, passed, failures", ("right", True, 0), ("wrong", False, 2), ("shuffled", True, 0), ("late", True, 0)))
def tool_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of tests that stand beside a rule."""
    rows = lambda *users: "".join(f'row(e, user_id = {u}, event_type = "error"); ' for u in users)
    test = lambda name, inputs, expect, options="": f"test {name} for t {{ input {{ {inputs} }} expect {{ {expect} }} options {{ {options} }} }}\n"
    text = made("t", bind='e : events && event_type == "error"', length="10m", measure="count >= 2", score="40", out="n = count(e)") + "\n"
    text += test("right", rows(1, 1, 2), 'hits == 1; hit[0].score == 40; hit[0].entity_id == "1"; hit[0].field("n") == 2;') + test("wrong", rows(1, 1), "hits == 2; hit[0].score == 41;")
    text += test("shuffled", rows(1, 2, 1, 2), "hits == 2;", "permutation = shuffle; runs = 3;") + test("late", rows(1) + "tick(11m);" + rows(1), "hits == 0;")
    return table(spark, "test string, passed boolean, failures bigint", [(o.test, o.passed, len(o.failures)) for o in run_tests(spark, text, WINDOWS)])


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {**engine(spark, sf_dir).tables, **readers.ndjson(spark, _lines(spark, sf_dir), {"events": WINDOWS["events"]})}
    return Engine.of(SCHEMAS, tables, ORDER).run_all(f"rule fixed_count_close {{ {text_of('fixed_count_close')} }}")


@query("tool_replay", f"SELECT entity_id, score, origin, fired_at, n FROM ({ORACLES['fixed_count_close']})")
def tool_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over events that are replayed from JSON lines."""
    return _replayed(spark, sf_dir).select("entity_id", "score", "origin", "fired_at", "n")


@query(
    "tool_replay_verify",
    f"""WITH a AS (SELECT *, entity_id::BIGINT % 4 AS k FROM ({ORACLES['fixed_count_close']})) SELECT CASE WHEN k = 0 THEN 'unexpected' WHEN k = 1 THEN 'field_mismatch' ELSE 'matched' END AS status, count(*) AS n FROM a GROUP BY ALL""",
)
def tool_replay_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed alerts against expected ones, of which some are left out and some have another score."""
    got = verify.read(_replayed(spark, sf_dir))
    k = F.col("entity_id").cast("bigint") % 4
    wanted = verify.read(engine(spark, sf_dir).run(f"rule fixed_count_close {{ {text_of('fixed_count_close')} }}")).where(k != 0).withColumn("score", F.when(k == 1, 1.0).otherwise(F.col("score")))
    return verify.compare(wanted, got).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "tool_strategies",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT user_id, b, count(*) AS n FROM e GROUP BY ALL) SELECT how, user_id, epoch_us(b) AS us, n::DOUBLE AS n, CASE WHEN b + {DAY} <= wm THEN 'close:timeout' ELSE 'close:eos' END AS origin
    FROM g, w, (VALUES ('aggregate'), ('fold')) t(how) WHERE n >= 2""",
)
def tool_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The emissions of a rule by its own strategy and by the ordered fold that all strategies are held against."""
    on = engine(spark, sf_dir)
    (rule,) = on.rules(f"rule fixed_count_close {{ {text_of('fixed_count_close')} }}")
    (plan,) = stage_plans(rule)
    events = bind.bind(plan, on.tables, on.schemas, on.order)
    both = {"aggregate": match.run(plan, events), "fold": match.fold(plan, events, "eos")}
    shown = [df.select(F.lit(how).alias("how"), F.col("k0").alias("user_id"), F.unix_micros("created").alias("us"), F.col("n0").alias("n"), "origin") for how, df in both.items()]
    return shown[0].unionByName(shown[1])


# Generators.

_WFG = """use "x"
#[duration=10m]
scenario s<seed=7> {
  traffic { stream events gen 2/s stream events gen wave(base=1/s, amp=1/s, period=2m, shape=sine) }
  injection { hit<10%> events { user_id seq { use(event_type="root") with(3, 1m) } } near_miss<5%> events { user_id seq { use(event_type="root") with(3, 1m) } } miss<5%> events { user_id seq { use(event_type="bob") with(1, 10s) } } }
  faults { duplicate = 0% }
  expect { hit(r) >= 95% near_miss(r) <= 1% recall(r) >= 90% precision(r) >= 90% }
}"""
_WFG_RULE = 'rule r { events { e : events && event_type == "root" } match<user_id:5m> { on event { e | count >= 3; } } -> score(1) entity(user, user_id) yield alerts (n = 3) }'


def _scenario(spark: SparkSession, text: str = _WFG) -> tuple[scenario.Scenario, DataFrame]:
    s = scenario.parse_scenario(text)
    rules = {r.name: r for r in parse_rules(_WFG_RULE).rules}
    return s, scenario.events(spark, s, {"events": WINDOWS["events"]}, rules)["events"]


@query("gen_rates", values("rate, n, first_second, last_second", ("const", 1200, 0, 599), ("burst", 300, 0, 591), ("timeline", 90, 10, 69), ("square", 600, 0, 569)))
def gen_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each shape of traffic over ten minutes: how many, and in which seconds the first and last are."""
    rates = {
        "const": traffic.Rate("const", 2), "burst": traffic.Rate("burst", 0, period=10, peak=2.5, hold=2), "timeline": traffic.Rate("timeline", segments=((0, 10, 0), (10, 40, 1), (40, 70, 2))), "square": traffic.Rate("wave", 1, 1, 60, "square"),
    }
    out = None
    for name, rate in rates.items():
        s = F.floor(F.unix_micros("ts") / 1_000_000) - 1000
        one = traffic.shaped(spark, rate, 600, 1000).agg(F.lit(name).alias("rate"), F.count("*").alias("n"), F.min(s).alias("first_second"), F.max(s).alias("last_second"))
        out = one if out is None else out.unionByName(one)
    return out


@query("gen_injection", values("label, entities, each, distinct_keys", ("hit", 60, 3, 60), ("near_miss", 45, 2, 45), ("miss", 90, 1, 90), ("none", 0, 1800, 0)))
def gen_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scenario of 1800 events injects: entities of each label, the events of each, and their keys."""
    _, df = _scenario(spark)
    own = df.where("label IS NOT NULL").groupBy("label", "entity").agg(F.count("*").alias("n"), F.min("user_id").alias("k"), F.max("user_id").alias("last"))
    own = own.groupBy("label").agg(F.count("*").alias("entities"), F.max("n").alias("each"), F.count_distinct(F.when(F.col("k") == F.col("last"), F.col("k"))).alias("distinct_keys"))
    return own.unionByName(df.where("label IS NULL").agg(F.lit("none").alias("label"), F.lit(0).cast("bigint").alias("entities"), F.count("*").alias("each"), F.lit(0).cast("bigint").alias("distinct_keys")))


@query("gen_problems", values("change, codes", ("none", ""), ("stream", "SC3"), ("share", "SV6"), ("fault", "SV7"), ("rule", "VN2"), ("metric", "VN1"), ("burst", "SV3"), ("traffic", "SC2")))
def gen_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of what is wrong with changed scenarios."""
    changes = {
        "none": ("", ""), "stream": ("stream events gen 2/s", "stream nothing gen 2/s"), "share": ("hit<10%>", "hit<95%>"), "fault": ("duplicate = 0%", "nonsense = 1%"), "rule": ("hit(r) >= 95%", "hit(q) >= 95%"), "metric": ("hit(r) >= 95%", "luck(r) >= 95%"),
        "burst": ("gen 2/s", "gen burst(base=1/s, peak=2/s, every=1s, hold=5s)"), "traffic": ("stream events gen 2/s stream events gen wave(base=1/s, amp=1/s, period=2m, shape=sine)", ""),
    }
    rules = {r.name: r for r in parse_rules(_WFG_RULE).rules}
    codes = lambda text: ",".join(sorted({p.split(":")[0] for p in scenario.problems(scenario.parse_scenario(text), WINDOWS, rules)}))
    return table(spark, "change string, codes string", [(n, codes(_WFG.replace(*c) if c[0] else _WFG)) for n, c in changes.items()])


@query("gen_expectations", values("metric, rule, holds", ("hit", "r", True), ("near_miss", "r", True), ("recall", "r", True), ("precision", "r", True)))
def gen_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rule finds in a scenario's events what the scenario expects of it."""
    s, df = _scenario(spark)
    alerts = Engine(WINDOWS, {"events": df.withColumn("_seq", F.col("seq"))}).run(_WFG_RULE)
    cases = df.where("label IS NOT NULL").withColumn("entity_id", F.col("user_id").cast("string"))
    got = verify.quality(alerts, cases)
    return table(spark, "metric string, rule string, holds boolean", [(e.metric, e.rule, ok) for e, _, ok in scenario.fulfilled(s, got)])


@query("gen_lines", values("keys, n", ("_stream,_timestamp,_window,event_id,event_type,props,ts,user_id,value", 2160)))
def gen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario's events as JSON lines: the keys of the objects, and how many there are."""
    _, df = _scenario(spark)
    path = scratch(spark, "scenario")
    output.write_lines({"events": df}, WINDOWS, path)
    keys = F.array_join(F.array_sort(F.expr("json_object_keys(value)")), ",")
    return spark.read.text(path).groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


# Streams and sinks together.


@query("stream_to_sinks", f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'rest' END AS sink, user_id::VARCHAR AS entity_id, {stamp("ts")} AS fired_at FROM events WHERE event_type = 'error'""")
def stream_to_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's alerts written to the sinks that their targets go to, and read from there."""
    on, folder = live(spark, sf_dir), scratch(spark, "routed")
    text = 'rule s { events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) }'
    alerts = stream_alerts(on, on.rules(text)[0]).withColumn("yield_target", F.when(F.col("user") % 2 == 0, "even_users").otherwise("users"))
    routes = sinks.Routes([("even", ["even_*"])], "rest")
    sinks.write_stream(alerts, routes, {n: sinks.Sink(n, f"{folder}/{n}") for n in ("even", "rest")}, f"{folder}/state").awaitTermination()
    read = lambda n: spark.read.schema("entity_id string, fired_at string").json(f"{folder}/{n}").select(F.lit(n).alias("sink"), "entity_id", "fired_at")
    return read("even").unionByName(read("rest"))
