"""Transport, configuration, command line, and the output of scenarios."""

import json
import random
import time
import urllib.request

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch import __main__ as cli
from tidewatch.config import check_retention, load
from tidewatch.gen import output
from tidewatch.lang.schema import parse_schemas
from tidewatch.sources import readers, tcp
from tidewatch.sources.metrics import Metrics
from tidewatch.streaming import memory

SCHEMA = 'window a { stream = "s" time = at over = 5m fields { k: chars n: digit at: time } } window o { over = 0 fields { k: chars n: digit } }'
S = parse_schemas(SCHEMA)
RULE = """rule r { events { e : a && n > 1 } match<k:5m> { on event { e | count >= ${LEAST:2}; } } -> score(7) entity(user, k) yield o (k = k, n = count(e)) }
test t for r { input { row(e, k = "x", n = 2); row(e, k = "x", n = 3); } expect { hits == 1; hit[0].score == 7; hit[0].field("n") == 2; } }
test u for r { input { row(e, k = "x", n = 2); } expect { hits == 1; } }"""


def test_frames_over_tcp(spark, tmp_path):
    r = tcp.Receiver(str(tmp_path))
    t = pa.table({"k": ["x", "y"], "n": [1, 2]})
    assert tcp.send("127.0.0.1", r.port, [("s", t), ("other", t), ("s", t), ("../bad", t)]) == 4
    for _ in range(100):
        if r.frames + r.errors == 4:
            break
        time.sleep(0.05)
    r.close()
    assert (r.frames, r.rows, r.errors) == (3, 6, 1)
    assert readers.arrow_ipc(spark, str(tmp_path / "s"), S["a"]).count() == 4


def test_cut_frames():
    whole = tcp.encode("s", pa.table({"n": [1]}))
    pieces = [whole[:3], whole[3:50], whole[50:] + whole, whole[:-1]]
    assert [tcp.decode(b)[0] for b in tcp.frames(iter(pieces))] == ["s", "s"]


CONFIG = """
sinks = "sinks"
[runtime]
rules = "r"
[window_defaults]
watermark = "5s"
max_total_bytes = "1GB"
[window.a]
mode = "local"
over_cap = "30m"
late_policy = "revise"
[window.o]
over_cap = "1h"
[vars]
LEAST = "3"
"""


def test_config():
    c = load(CONFIG)
    assert c.windows["a"].watermark == 5 and c.windows["a"].late_policy == "revise" and c.windows["o"].late_policy == "drop" and c.variables == {"LEAST": "3"}
    check_retention(c, S)
    with pytest.raises(ValueError):
        check_retention(load(CONFIG.replace("30m", "1m")), S)


@pytest.mark.parametrize("old,new", [('"local"', '"far"'), ('"local"', '"partitioned"'), ('"revise"', '"maybe"'), ("LEAST", '"1X"'), ('over_cap = "1h"', 'over_cap = "1h"\nmax_window_bytes = "2GB"')])
def test_bad_config(old, new):
    with pytest.raises(ValueError):
        load(CONFIG.replace(old, new))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.schema").write_text(SCHEMA)
    (tmp_path / "r.rule").write_text(RULE)
    (tmp_path / "x.json").write_text("\n".join(json.dumps({"_stream": "s", "k": k, "n": n, "at": 1767225600000000000 + i * 10**9}) for i, (k, n) in enumerate([("x", 2), ("x", 3), ("y", 5), ("x", 1)])))
    rules, schemas = str(tmp_path / "r.rule"), ["--schemas", str(tmp_path / "*.schema")]
    assert cli.main(["check", rules, *schemas]) == 0 and cli.main(["explain", rules, *schemas]) == 0 and cli.main(["lint", rules, *schemas]) == 0 and cli.main(["format", rules]) == 0
    assert "rule r" in capsys.readouterr().out
    assert cli.main(["test", rules, *schemas]) == 1
    out = capsys.readouterr().out
    assert "ok   t" in out and "FAIL u" in out
    assert cli.main(["replay", rules, *schemas, "--input", str(tmp_path / "x.json")]) == 0
    assert [json.loads(x)["entity_id"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["x"]
    assert cli.main(["replay", rules, *schemas, "--var", "LEAST=1", "--input", str(tmp_path / "x.json"), "--output", str(tmp_path / "alerts")]) == 0
    assert spark.read.json(str(tmp_path / "alerts")).count() == 3
    assert cli.main(["verify", str(tmp_path / "alerts"), str(tmp_path / "alerts")]) == 0
    (tmp_path / "g.scenario").write_text("#[duration=1m]\nscenario s<seed=1> { traffic { stream s gen 2/s } }")
    assert cli.main(["generate", str(tmp_path / "g.scenario"), *schemas, "--output", str(tmp_path / "gen")]) == 0
    first = json.loads(spark.read.text(str(tmp_path / "gen")).first()[0])
    assert set(first) == {"_stream", "_window", "_timestamp", "k", "n", "at"} and spark.read.text(str(tmp_path / "gen")).count() == 120


def test_events_sent(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)] * 3, "k string, n bigint").withColumn("at", F.timestamp_seconds(F.lit(5))).withColumn("arrival", F.lit(0))
    r = tcp.Receiver(str(tmp_path))
    assert output.send({"a": df}, S, "127.0.0.1", r.port) == 1
    r.close()
    assert readers.arrow_ipc(spark, str(tmp_path / "s"), S["a"]).count() == 3


def test_events_pass_by_the_driver(spark, tmp_path, monkeypatch):
    """Frames go from tasks to receivers, as many rows as there are and once if a task's are landed again; the driver takes no rows."""
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    df = spark.range(0, 23_000, numPartitions=3).selectExpr("concat('x', id) AS k", "id AS n", "timestamp_micros(id * 1000) AS at")
    r = tcp.Receiver(str(tmp_path / "sent"))
    frames = output.send({"a": df}, S, "127.0.0.1", r.port)
    r.wait(frames)
    r.close()
    assert (r.frames, r.rows, r.errors) == (frames, 23_000, 0)
    assert output.land({"a": df}, S, str(tmp_path / "landed")) == output.land({"a": df}, S, str(tmp_path / "landed")) == frames == 6
    for place in ("sent", "landed"):
        got = readers.arrow_ipc(spark, str(tmp_path / place / "s"), S["a"])
        assert got.agg(F.count("*"), F.count_distinct("k"), F.sum("n"), F.max(F.unix_micros("at"))).first() == (23_000, 23_000, 22_999 * 11_500, 22_999_000)


def test_metrics_text(spark, sf, tmp_path):
    """Counters, gauges and histograms of a stream are served as text."""
    m = Metrics()
    spark.streams.addListener(m)
    try:
        events = spark.read.parquet(f"{sf}/events.parquet")
        events.write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = source.groupBy("event_type").count().writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            if ("queries_ended_total", (("query", "counted"),)) in m.counters:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(m)
    assert m.counters["rows_total", (("query", "counted"),)] == events.count() and m.gauges["query_active", (("query", "counted"),)] == 0
    df, seen = m.watched(events, "events", {"errors": "event_type = 'error'"})
    df.count()
    m.counted("events", seen)
    server = m.serve()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics") as got:
        text = got.read().decode()
    server.shutdown()
    assert f'events_total{{of="errors"}} {events.where("event_type = \'error\'").count():g}\n' in text and "# TYPE batch_seconds histogram" in text and 'state_rows{operator="0",query="counted"} 5' in text
    assert 'batch_seconds_bucket{query="counted",le="+Inf"}' in text and text == m.text()


def test_memory_budget(spark):
    """The newest rows stay, and of several windows the largest give way first; checked against taking rows off one by one."""
    r = random.Random(4)
    made = {name: [(i, r.randint(0, 50), "x" * r.randint(0, 90)) for i in range(n)] for name, n in (("a", 300), ("b", 90), ("c", 3))}
    frames = {n: spark.createDataFrame(rows, "i bigint, s int, t string").withColumn("at", F.timestamp_seconds("s")) for n, rows in made.items()}
    size = lambda row: memory.ROW + 3 * memory.VALUE + len(row[2])
    left = {n: sorted(rows, key=lambda x: (x[1], x[0])) for n, rows in made.items()}
    for most in (40_000, 9_000, 500, 0):
        got = {n: sorted(x.i for x in df.collect()) for n, df in memory.within(frames, dict.fromkeys(frames, "at"), most, dict.fromkeys(frames, "i")).items()}
        top = memory.level({n: sum(map(size, rows)) for n, rows in made.items()}, most)
        for n, rows in left.items():
            kept = list(rows)
            while top is not None and sum(map(size, kept)) > top:
                kept.pop(0)
            assert got[n] == sorted(x[0] for x in kept), (most, n)
        assert sum(size(x) for n in made for x in made[n] if x[0] in got[n]) <= most
    assert memory.level({"a": 10, "b": 100, "c": 100}, 90) == 40 and memory.level({"a": 1}, 1) is None


def test_replay_verify(spark, tmp_path, capsys):
    (tmp_path / "s.schema").write_text(SCHEMA)
    (tmp_path / "r.rule").write_text(RULE)
    (tmp_path / "x.json").write_text("\n".join(json.dumps({"_stream": "s", "k": k, "n": n, "at": 1767225600000000000 + i * 10**9}) for i, (k, n) in enumerate([("x", 2), ("x", 3), ("y", 5), ("x", 1)])))
    alert = {"rule_name": "r", "entity_type": "user", "entity_id": "x", "origin": "event", "fired_at": "2026-01-01T00:00:01.000Z", "score": 7.0}
    common = ["replay-verify", str(tmp_path / "r.rule"), "--schemas", str(tmp_path / "*.schema"), "--input", str(tmp_path / "x.json"), "--expected", str(tmp_path / "want.json")]
    (tmp_path / "want.json").write_text(json.dumps(alert))
    assert cli.main(common) == 0 and '"matched": 1' in capsys.readouterr().out
    (tmp_path / "want.json").write_text(json.dumps(alert | {"score": 9.0, "fired_at": "2026-01-01T00:00:03.000Z"}))
    assert cli.main([*common, "--seconds", "5"]) == 1 and '"field_mismatch": 1' in capsys.readouterr().out
    (tmp_path / "meta.json").write_text('{"time_tolerance_secs": 5, "score_tolerance": 3}')
    assert cli.main([*common, "--meta", str(tmp_path / "meta.json")]) == 0
    capsys.readouterr()
    assert cli.main([*common, "--format", "markdown"]) == 1
    out = capsys.readouterr().out
    assert "# Verification: fail" in out and "| missing | r | user x | event | 2026-01-01T00:00:03 (9) | - |" in out
