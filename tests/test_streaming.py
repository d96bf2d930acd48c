"""Rules over streams give what they give over tables."""

import pytest
from pyspark.sql import functions as F

from tidewatch.engine import Engine
from tidewatch.lang.ast import Limits
from tidewatch.lang.tokens import RuleError
from tidewatch.operators import match
from tidewatch.queries import ORDER, SCHEMAS, engine
from tidewatch.sources.sinks import Routes, Sink, load_config, matches, uncovered, write_stream
from tidewatch.streaming.late import apply_policy, split_late
from tidewatch.streaming.processor import drain, stream_alerts, write_batches

RULES = {
    "anchored": 'match<user_id:1d> { on event { e | count >= 3; } } -> score(1)',
    "sequence": 'match<user_id:1d:fixed> { on event { e && event_type == "signup" | count >= 1; e && event_type == "purchase" | count >= 1; } and close { total: e.value | sum > 10; } } -> score(total)',
    "sessions": "match<user_id:session(6h)> { on event { e | count >= 1; } and close { n: e | count >= 3; } } -> score(n)",
    "or_mode": "match<user_id:1d:fixed> { on event { e | count >= 2; } on close { e.event_type | distinct | count >= 2; } } -> score(1)",
}


def fed(spark, sf, tmp_path):
    """The tables, and the same with a stream of events that come in three files and a fourth of an event far in the future."""
    table = engine(spark, sf)
    events = table.tables["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    cut = [F.col("event_id") < 400, (F.col("event_id") >= 400) & (F.col("event_id") < 700), F.col("event_id") >= 700]
    late = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("user_id", F.lit(-1).cast("bigint")).withColumn("event_id", F.lit(10**9).cast("bigint"))
    for part in [*(events.where(c) for c in cut), late]:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table.tables["events"] = events.unionByName(late)
    return table, Engine.of(SCHEMAS, {**table.tables, "events": source}, ORDER)


COLUMNS = ["entity_id", "origin", "fired_at", "score", "n"]


def told(df, *more):
    return sorted(tuple(r) for r in df.where("entity_id <> '-1'").select(*COLUMNS, *more).collect())


@pytest.mark.parametrize("name", list(RULES))
def test_stream_equals_table(spark, sf, tmp_path, name):
    table, live = fed(spark, sf, tmp_path)
    rule = table.rules(f"rule r {{ events {{ e : events }} {RULES[name]} entity(user, user_id) yield alerts (n = count(e)) }}")[0]
    q = stream_alerts(live, rule).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = told(table.alerts(rule))
    assert told(spark.table(f"out_{name}")) == want and len(want) > 5


END = "entity(user, user_id) yield alerts (n = {})"
BATCHES = {
    "throttle": "match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(1) " + END.format("1") + ' limits { max_throttle = "3/d"; on_exceed = "throttle"; }',
    "throttle_fails": "match<user_id:1d> { on event { e | count >= 2; } } -> score(1) " + END.format("1") + ' limits { max_throttle = "2/h"; on_exceed = "fail_rule"; }',
    "instances": "match<user_id:1d:fixed> { on event { e | count >= 1; } and close { e | count >= 1; } } -> score(1) " + END.format("count(e)") + ' limits { max_instances = 5; on_exceed = "throttle"; }',
    "oldest": "match<user_id:session(6h)> { on event { e | count >= 1; } and close { e | count >= 1; } } -> score(1) " + END.format("count(e)") + ' limits { max_instances = 4; on_exceed = "drop_oldest"; }',
    "top": "match<user_id:1d:fixed> { on event { e | count >= 1; } and close { t: e.value | sum > 0; } } -> score(t) " + END.format("count(e)") + " conv { sort(-t, user_id) | top(2); }",
    "dedup": "match<user_id:12h:fixed> { on event { e | count >= 1; } and close { c: e | count >= 1; } } -> score(c) " + END.format("c") + " conv { sort(user_id) | dedup(c); where(c >= 1); }",
    "asof": 'match<user_id:1d:fixed> { on event { e && event_type == "error" | count >= 1; } } -> score(1) join signups asof on user_id == signups.user_id ' + END.format("signups.event_id"),
    "stages": "match<user_id, event_type:1d:fixed> { on event { e | count >= 1; } and close { burst: e | count >= 1; } } |> match<user_id:10d> { on event { _in | count >= 2; } } -> score(85) entity(user, _in.user_id) yield alerts (n = 2)",
}


@pytest.mark.parametrize("name", list(BATCHES))
def test_batches_equal_table(spark, sf, tmp_path, name):
    """Rules that need the emissions of a batch together, and limits, give over a stream what they give over tables."""
    table, live = fed(spark, sf, tmp_path)
    rule = table.rules(f"rule r {{ events {{ e : events }} {BATCHES[name]} }}")[0]
    more = ["rank"] if rule.conv else []
    write_batches(live, rule, lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}")), str(tmp_path / "run"))
    want = told(table.alerts(rule), *more)
    assert told(spark.read.parquet(str(tmp_path / "out")), *more) == want and len(want) > 5
    if name not in ("instances", "oldest"):
        with pytest.raises(RuleError, match="write_batches"):
            stream_alerts(live, rule)


@pytest.mark.parametrize("limit", ["", "limits { max_instances = 100; }"])
def test_drain(spark, sf, tmp_path, limit):
    """What a stream has told and what draining it tells are what the table tells, whose open windows close at its end."""
    table, live = fed(spark, sf, tmp_path)
    rule = table.rules("rule r { events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (n = count(e)) " + limit + " }")[0]
    q = stream_alerts(live, rule).writeStream.format("memory").queryName(f"drained_{bool(limit)}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted(tuple(r) for r in df.select(*COLUMNS).collect())
    left = rows(drain(live, rule, str(tmp_path / "cp")))
    assert sorted(rows(spark.table(f"drained_{bool(limit)}")) + left) == rows(table.alerts(rule, final="flush")) and [r[:2] for r in left] == [("-1", "close:flush")]


def test_late_rows(spark):
    df = spark.createDataFrame([(1, 100), (2, 50), (3, 95), (4, 200), (5, 120)], "i int, s int").withColumn("ts", F.timestamp_seconds("s"))
    ontime, late = split_late(df, "ts", ["i"], 10)
    assert [r.i for r in ontime.orderBy("i").collect()] == [1, 3, 4] and sorted(r.i for r in late.collect()) == [2, 5]
    assert apply_policy(df, "ts", ["i"], 10, "revise").count() == 5 and apply_policy(df, "ts", ["i"], 10, "side_output", 100).count() == 5
    with pytest.raises(ValueError):
        apply_policy(df, "ts", ["i"], 10, "ignore")


CONFIG = """
[defaults]
tags = ["env:test", "team:a"]
[[connector]]
id = "files"
params = { path = "none", format = "json" }
allow_override = ["path"]
tags = ["team:b"]
[[route]]
name = "security"
windows = ["sec_*"]
connect = "files"
params = { path = "PATH/security" }
tags = ["kind:x"]
parallel = 99
[default]
connect = "files"
params = { path = "PATH/default" }
[error]
connect = "files"
params = { path = "PATH/error" }
"""


def test_sinks(spark, tmp_path):
    routes, sinks = load_config(CONFIG.replace("PATH", str(tmp_path)))
    assert sinks["security"].tags == {"env": "test", "team": "b", "kind": "x"} and sinks["security"].parallel == 10
    df = spark.createDataFrame([("sec_a", 1), ("other", 2), (None, 3)], "yield_target string, n int")
    assert routes.write(df, sinks) == []
    assert [r.n for r in spark.read.json(str(tmp_path / "security")).collect()] == [1]
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "default")).collect()) == [2, 3]
    broken = {**sinks, "security": Sink("security", "nowhere://x")}
    assert routes.write(df, broken) == ["security"] and spark.read.json(str(tmp_path / "error")).count() == 1
    assert matches("a*b?", "axxbc") and not matches("a?", "abc") and uncovered(Routes([("x", ["a*"])]), ["ab", "b"]) == ["b"]
    with pytest.raises(ValueError):
        load_config(CONFIG.replace('allow_override = ["path"]', "allow_override = []"))


def test_sinks_make_alerts_once(spark, tmp_path):
    """However many groups there are, the rows are made once, by all their tasks; a batch that is written again replaces itself."""
    made = spark.sparkContext.accumulator(0)

    def work(parts):
        for p in parts:
            made.add(len(p))
            yield p

    df = spark.range(90, numPartitions=5).selectExpr("id AS n", "concat('t', id % 3) AS yield_target").mapInPandas(work, "n bigint, yield_target string")
    routes = Routes([("a", ["t0"]), ("b", ["t*"]), ("c", ["t2"])], "rest", "bad")
    sinks = {n: Sink(n, str(tmp_path / n)) for n in ("a", "b", "c", "rest", "bad")} | {"c": Sink("c", "nowhere://x")}
    assert routes.write(df, sinks, batch=4) == ["c"] and made.value == 90
    assert routes.write(df, sinks, batch=4) == ["c"]
    count = lambda n: spark.read.json(str(tmp_path / n)).count()
    assert (count("a"), count("b"), count("bad")) == (30, 90, 30)
    plan = lambda sink: sink.rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan(Sink("x")) and "Exchange" not in plan(Sink("x")) and "REPARTITION_BY_NUM" in plan(Sink("x", parallel=2))


def test_stream_to_sinks(spark, sf, tmp_path):
    table = engine(spark, sf)
    rule = table.rules('rule r { events { e : events && event_type == "error" } match<user_id:1d> { on event { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (n = 1) }')[0]
    events = table.tables["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = write_stream(stream_alerts(Engine.of(SCHEMAS, {"events": source}, ORDER), rule), Routes([("all", ["*"])]), {"all": Sink("all", str(tmp_path / "out"))}, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == events.where("event_type = 'error'").count()


@pytest.mark.parametrize("name", list(RULES))
def test_state_by_groups_of_keys(spark, sf, tmp_path, monkeypatch, name):
    """What the state store is asked for, and holds, grows with groups of keys and not with keys; windows of keys that share a group are kept apart."""
    monkeypatch.setattr("tidewatch.streaming.processor.SHARDS", 2, raising=False)
    table, live = fed(spark, sf, tmp_path)
    rule = table.rules(f"rule r {{ events {{ e : events }} {RULES[name]} entity(user, user_id) yield alerts (n = count(e)) }}")[0]
    q = stream_alerts(live, rule).writeStream.format("memory").queryName(f"grouped_{name}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = told(table.alerts(rule))
    assert told(spark.table(f"grouped_{name}")) == want and len(want) > 5
    days = 31 if "fixed" in RULES[name] else 1
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert 0 < max(held) <= 2 * (days + 3), held


def test_throttle_passes_on_few_rows(spark):
    """Of emissions that a throttle stops, only the last of each Arrow batch goes on, for the state after it."""
    df = spark.range(30_000).selectExpr("'event' AS origin", "timestamp_seconds(id) AS fired", "timestamp_seconds(0) AS created", "id AS k0", "array(id) AS x")
    rows = match.marked(df, Limits(max_throttle="3/h", on_exceed="throttle"))
    assert rows.count() <= 9 * 3 + 30_000 / 1000 and [r.k0 for r in match.kept(rows).orderBy("k0").limit(4).collect()] == [0, 1, 2, 3600]
    assert rows.agg(F.max_by(F.struct("_count", F.unix_seconds(F.timestamp_micros("_start"))), "_at")).first()[0] == (3, 28_800) and rows.schema["x"].dataType.simpleString() == "array<bigint>"
