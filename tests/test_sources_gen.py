"""Readers, traffic, scenarios and verification."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.engine import Engine
from tidewatch.gen import faults, scenario, traffic, verify
from tidewatch.lang.rule import parse_rules
from tidewatch.lang.schema import parse_schemas
from tidewatch.sources import readers

S = parse_schemas("""
window auth { stream = ["syslog", "audit"] time = at over = 5m fields { sip: ip user: chars n: digit ok: bool w: float at: time } }
window conn { stream = "net" time = at over = 5m fields { sip: ip at: time } }
window out { over = 0 fields { sip: ip } }""")


def test_json_lines(spark, tmp_path):
    lines = [{"_stream": "syslog", "sip": "a", "n": "7", "ok": True, "w": 1.5, "at": 1767225600000000000}, {"_stream": "audit", "sip": "b", "n": 8.0, "at": "2026-01-01T00:00:01Z"}, {"_stream": "net", "sip": "c", "at": 1767225600000000000}]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = readers.ndjson(spark, str(tmp_path / "x.json"), S)
    assert set(got) == {"auth", "conn"}
    a = {r.sip: r for r in got["auth"].select("*", F.unix_seconds("at").alias("s")).collect()}
    assert (a["a"].n, a["a"].ok, a["a"].w, a["a"].s, a["b"].s, a["b"].user) == (7, True, 1.5, 1767225600, 1767225601, None)
    assert got["conn"].count() == 1 and readers.bad_lines(spark, str(tmp_path / "x.json")) == 1


def test_arrow_files(spark, tmp_path):
    t = pa.table({"sip": ["a", "b"], "n": pa.array([1, 2], pa.int32()), "at": pa.array([1767225600000000000] * 2, pa.timestamp("ns"))})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    got = readers.arrow_ipc(spark, str(tmp_path), S["auth"]).orderBy("sip").collect()
    assert [(r.sip, r.n, r.user) for r in got] == [("a", 1, None), ("b", 2, None)] and got[0]["at"].year == 2026


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_files(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", "u", 1, True, 2.5)], "sip string, user string, n bigint, ok boolean, w double").withColumn("at", F.timestamp_seconds(F.lit(5)))
    df.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(str(tmp_path / "d"))
    (r,) = readers.files(spark, str(tmp_path / "d"), S["auth"], kind).select("*", F.unix_seconds("at").alias("s")).collect()
    assert (r.sip, r.n, r.ok, r.w, r.s) == ("a", 1, True, 2.5, 5)


def test_route(spark):
    df = spark.createDataFrame([("syslog", "a"), ("audit", "b"), ("net", "c"), ("none", "d")], "_stream string, sip string").withColumn("at", F.timestamp_seconds(F.lit(1)))
    got = readers.route(df, S)
    assert {k: sorted(r.sip for r in v.collect()) for k, v in got.items()} == {"auth": ["a", "b"], "conn": ["c"]}


@pytest.mark.parametrize("rate,total", [
    (traffic.Rate("const", 10), 600), (traffic.Rate("wave", 10, 5, 20), 600), (traffic.Rate("burst", 0, period=10, peak=5, hold=2), 60), (traffic.Rate("timeline", segments=((0, 30, 2), (30, 60, 0))), 60), (traffic.Rate("wave", 10, 5, 20, "square"), 600), (traffic.Rate("wave", 10, 5, 20, "triangle"), 600),
])
def test_rates(spark, rate, total):
    df = traffic.shaped(spark, rate, 60, 1000)
    assert abs(df.count() - total) <= 2
    assert df.select("seq").distinct().count() == df.count() and df.agg(F.max(F.unix_seconds("ts"))).first()[0] < 1060


SCENARIO = """use "x"
#[duration=10m]
scenario s<seed=7> {
  traffic { stream syslog gen 2/s stream syslog gen wave(base=1/s, amp=1/s, period=2m, shape=sine) }
  injection { hit<10%> syslog { sip seq { use(user="root") with(3, 1m) } } near_miss<5%> syslog { sip seq { use(user="root") with(3, 1m) } } miss<5%> syslog { sip seq { use(user="bob") with(1, 10s) } } }
  faults { duplicate = 0% }
  expect { hit(r) >= 95% near_miss(r) <= 1% recall(r) >= 90% precision(r) >= 90% latency_p95(r) <= 2s }
}"""
RULE = 'rule r { events { e : auth && user == "root" } match<sip:5m> { on event { e | count >= 3; } } -> score(1) entity(ip, sip) yield out (sip = sip) }'


def test_scenario(spark):
    s = scenario.parse_scenario(SCENARIO)
    rules = {r.name: r for r in parse_rules(RULE).rules}
    assert scenario.problems(s, S, rules) == [] and s.seed == 7 and s.duration == 600 and len(s.cases) == 3
    made = scenario.events(spark, s, S, rules)["auth"].cache()
    labels = {r["label"]: r["n"] for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert labels[None] == sum(r.total(600) for _, r in s.traffic) and labels["hit"] % 3 == 0 and labels["near_miss"] % 2 == 0
    again = scenario.events(spark, s, S, rules)["auth"]
    assert made.exceptAll(again).isEmpty()
    alerts = Engine(S, {"auth": made.withColumn("_seq", F.col("seq"))}).run(RULE)
    got = verify.quality(alerts, made.where("label is not null").withColumnRenamed("entity", "entity_id"))
    assert all(ok for _, _, ok in scenario.fulfilled(s, got)), got


@pytest.mark.parametrize("change,code", [
    (("stream syslog gen 2/s", "stream nothing gen 2/s"), "SC3"), (("hit<10%>", "hit<95%>"), "SV6"), (("duplicate = 0%", "nonsense = 1%"), "SV7"), (("hit(r) >= 95%", "hit(q) >= 95%"), "VN2"), (("hit(r) >= 95%", "luck(r) >= 95%"), "VN1"),
    (("gen 2/s", "gen burst(base=1/s, peak=2/s, every=1s, hold=5s)"), "SV3"),
])
def test_bad_scenarios(change, code):
    s = scenario.parse_scenario(SCENARIO.replace(*change))
    assert any(p.startswith(code) for p in scenario.problems(s, S, {r.name: r for r in parse_rules(RULE).rules}))


def test_faults(spark):
    df = spark.range(10000).select(F.col("id").alias("seq"))
    got = faults.inject(df, F.col("seq"), duplicate=faults.seeded(F.col("seq"), 1, 10, 0), drop=faults.seeded(F.col("seq"), 1, 20, 1), late=(faults.seeded(F.col("seq"), 1, 5, 2), 1000))
    n = got.count()
    assert 8400 < n < 9200 and 350 < got.where("arrival > seq").count() < 550


def test_verify(spark):
    row = lambda i, t, s: ("r", "ip", i, "event", t, s)
    shape = "rule_name string, entity_type string, entity_id string, origin string, at double, score double"
    make = lambda rows: spark.createDataFrame(rows, shape).withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("bigint")))
    want = make([row("a", 1.0, 5.0), row("a", 9.0, 5.0), row("b", 1.0, 5.0), row("c", 1.0, 5.0)])
    got = make([row("a", 1.5, 5.0), row("a", 9.2, 7.0), row("c", 8.0, 5.0)])
    r = verify.report(verify.compare(want, got))
    assert (r["status"], r["matched"], r["field_mismatch"], r["missing"], r["unexpected"]) == ("fail", 1, 1, 2, 1)
    assert verify.report(verify.compare(want, want))["status"] == "pass"
