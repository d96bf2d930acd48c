"""Registered queries: rules and operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.values import number_text
from .gen import faults, traffic, verify
from .operators import joins
from .operators.baseline import baseline
from .sources import sinks
from .streaming.late import retained, split_late
from .streaming.processor import STATE_STORE, drain, stream_alerts, write_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TEXTS: dict[str, str] = {}

SCHEMAS = """
window events { stream = "events" time = ts over = 400d
  fields { event_id: digit ts: time user_id: digit event_type: chars value: float props: chars } }
window orders { stream = "orders" time = o_orderdate over = 4000d
  fields { o_orderkey: digit o_custkey: digit o_orderstatus: chars o_totalprice: float o_orderdate: time o_orderpriority: chars } }
window customer { stream = "customer" over = 0
  fields { c_custkey: digit c_name: chars c_nationkey: digit c_acctbal: float c_mktsegment: chars } }
window nation { stream = "nation" over = 0 fields { n_nationkey: digit n_name: chars n_regionkey: digit } }
window signups { stream = "signups" time = ts over = 400d
  fields { event_id: digit ts: time user_id: digit event_type: chars value: float props: chars } }
window part { stream = "part" over = 0 fields { p_partkey: digit p_name: chars p_brand: chars p_type: chars p_size: digit p_retailprice: float } }
window both { stream = ["events", "orders"] time = ts over = 400d fields { ts: time who: digit what: chars } }
window alerts { over = 0 fields { user: digit n: digit m: float label: chars list: chars other: float } }
"""
ORDER = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "signups": "event_id", "part": "p_partkey"}


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under the one that the driver and all executors share; only a session in one process may do without that."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='tidewatch-')}/{what}-{uuid.uuid4().hex}"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {name: read(name) for name in ("events", "orders", "customer", "nation", "part")}
    tables["signups"] = tables["events"].where("event_type = 'signup'")
    events = tables["events"].select("ts", F.col("user_id").alias("who"), F.col("event_type").alias("what"), F.col("event_id").alias("_seq"))
    orders = tables["orders"].select(F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("who"), F.col("o_orderstatus").alias("what"), F.col("o_orderkey").alias("_seq"))
    tables["both"] = events.unionByName(orders)
    return Engine.of(SCHEMAS, tables, ORDER)


def rule(name: str, text: str, columns: str, sql: str) -> None:
    """Registers a rule: the columns wanted of its alerts, and the SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).run(f"rule {name} {{ {text} }}").selectExpr(*columns.split("; "))

    QUERIES[name], ORACLES[name], TEXTS[name] = run, sql, text


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


ALERT = "entity_id; score; origin; fired_at"
DAY = "INTERVAL 1 DAY"


def closing(end: str = f"b + {DAY}") -> str:
    """SQL of origin and fired_at of a window that closes at ``end``, with the watermark wm."""
    return f"CASE WHEN {end} <= wm THEN 'close:timeout' ELSE 'close:eos' END AS origin, {stamp(f'least({end}, wm)')} AS fired_at"


def ev(where: str = "TRUE") -> str:
    """SQL of events with their day and the watermark."""
    return f"e AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS b FROM events WHERE {where}), w AS (SELECT max(ts) AS wm FROM e)"


# Matching.

rule(
    "fixed_count_close",
    """events { e : events && event_type == "error" }
    match<user_id:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 2; } } -> score(70)
    entity(user, e.user_id) yield alerts (user = e.user_id, n = count(e), label = fmt("{} failed {} times", e.user_id, n))""",
    f"{ALERT}; entity_type; summary; yield_target; user; n; label",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT user_id, b, count(*) AS n FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 70.0::DOUBLE AS score, 'user' AS entity_type, 'alerts' AS yield_target, user_id AS "user", n, {closing()},
    'rule=fixed_count_close; scope=[user_id=' || user_id || ']; step0=1.0; n=' || n || '.0; origin=' || CASE WHEN b + {DAY} <= wm THEN 'close:timeout' ELSE 'close:eos' END AS summary,
    user_id || ' failed ' || n || ' times' AS label FROM g, w WHERE n >= 2""",
)
rule(
    "fixed_count_repeat",
    """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { hit: e | count >= 2; } } -> score(50 + hit)
    entity(user, user_id) yield alerts (user = user_id, m = hit)""",
    f"{ALERT}; user; m",
    f"""WITH {ev("event_type = 'error'")}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS rn FROM e)
    SELECT user_id::VARCHAR AS entity_id, 52.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at, user_id AS "user", 2.0::DOUBLE AS m FROM r WHERE rn % 2 = 0""",
)
rule(
    "fixed_distinct_close",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { kinds: e.event_type | distinct | count >= 3; } } -> score(kinds * 10)
    entity(user, user_id) yield alerts (m = kinds, n = distinct(e.event_type))""",
    f"{ALERT}; m; n",
    f"""WITH {ev()}, g AS (SELECT user_id, b, count(DISTINCT event_type) AS k FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, least(k * 10, 100)::DOUBLE AS score, {closing()}, k::DOUBLE AS m, k AS n FROM g, w WHERE k >= 3""",
)
rule(
    "fixed_sum_on_close_or",
    """events { e : events && event_type == "purchase" } match<user_id:1d:fixed> { on event { e | count >= 2; } on close { total: e.value | sum >= 100; } } -> score(85)
    entity(user, user_id) yield alerts (m = round(total, 2))""",
    f"{ALERT}; m",
    f"""WITH {ev("event_type = 'purchase'")}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS rn FROM e),
    g AS (SELECT user_id, b, sum(value) AS s FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 85.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at, NULL::DOUBLE AS m FROM r WHERE rn = 2
    UNION ALL SELECT user_id::VARCHAR, 85.0::DOUBLE, CASE WHEN b + {DAY} <= wm THEN 'close:timeout' ELSE 'close:eos' END, {stamp(f"least(b + {DAY}, wm)")}, floor(s * 100 + 0.5) / 100 FROM g, w WHERE s >= 100""",
)
rule(
    "fixed_avg",
    """events { e : events && event_type == "view" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { mean: e.value | avg > 60; } } -> score(60)
    entity(user, user_id) yield alerts (m = round(mean, 3))""",
    f"{ALERT}; m",
    f"""WITH {ev("event_type = 'view'")}, g AS (SELECT user_id, b, avg(value) AS s FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 60.0::DOUBLE AS score, {closing()}, floor(s * 1000 + 0.5) / 1000 AS m FROM g, w WHERE s > 60""",
)
rule(
    "fixed_min_max",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 2; } and close { lo: e.value | min < 5; hi: e.value | max > 90; } } -> score(hi - lo)
    entity(user, user_id) yield alerts (m = lo, other = hi)""",
    f"{ALERT}; m; other",
    f"""WITH {ev()}, g AS (SELECT user_id, b, count(*) AS n, min(value) AS lo, max(value) AS hi FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, least(hi - lo, 100.0) AS score, {closing()}, lo AS m, hi AS other FROM g, w WHERE n >= 2 AND lo < 5 AND hi > 90""",
)
rule(
    "text_min_threshold",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { e.event_type | min == "error"; } } -> score(40)
    entity(user, user_id) yield alerts (user = user_id)""",
    ALERT,
    f"""WITH {ev()}, g AS (SELECT user_id, b, min(event_type) AS t FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 40.0::DOUBLE AS score, {closing()} FROM g, w WHERE t = 'error'""",
)
rule(
    "absence_a_not_b",
    """events { s : events && event_type == "signup"  p : events && event_type == "purchase" }
    match<user_id:1d:fixed> { on event { s | count >= 1; } and close { p | count == 0; } } -> score(50) entity(user, user_id) yield alerts (n = count(s))""",
    f"{ALERT}; n",
    f"""WITH {ev("event_type IN ('signup', 'purchase')")}, g AS (SELECT user_id, b, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 50.0::DOUBLE AS score, {closing()}, s AS n FROM g, w WHERE s >= 1 AND p = 0""",
)
rule(
    "close_reason_guard",
    """events { s : events && event_type == "signup"  p : events && event_type == "purchase" }
    match<user_id:1d:fixed> { on event { s | count >= 1; } and close { p && close_reason == "timeout" && value > 20 | count == 0; } } -> score(50) entity(user, user_id) yield alerts (label = close_reason)""",
    f"{ALERT}; label",
    f"""WITH {ev("event_type IN ('signup', 'purchase')")}, g AS (SELECT user_id, b, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase' AND value > 20) AS p FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 50.0::DOUBLE AS score, {closing()}, 'timeout' AS label FROM g, w WHERE s >= 1 AND p = 0 AND b + {DAY} <= wm""",
)
_SESSIONS = f"""WITH {ev()}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e),
    i AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l),
    g AS (SELECT user_id, sid, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS fin FROM i GROUP BY ALL)"""
rule(
    "session_count",
    """events { e : events } match<user_id:session(6h)> { on event { e | count >= 1; } and close { n: e | count >= 3; } } -> score(n) entity(user, user_id) yield alerts (n = n)""",
    f"{ALERT}; n",
    f"""{_SESSIONS} SELECT user_id::VARCHAR AS entity_id, least(n, 100)::DOUBLE AS score, {closing("fin")}, n FROM g, w WHERE n >= 3""",
)
rule(
    "session_repeat",
    """events { e : events } match<user_id:session(6h)> { on event { e | count >= 2; } } -> score(1) entity(user, user_id) yield alerts (user = user_id)""",
    ALERT,
    f"""WITH {ev()}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e),
    i AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts, event_id) AS rn FROM i)
    SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at FROM r WHERE rn % 2 = 0""",
)
rule(
    "sliding_chain",
    """events { e : events && event_type == "click" } match<user_id:1d> { on event { e | count >= 3; } } -> score(65) entity(user, user_id) yield alerts (user = user_id)""",
    ALERT,
    f"""WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click'),
    f AS (SELECT user_id, rn, ts, ts AS c, 1 AS n, FALSE AS hit FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.rn, o.ts, CASE WHEN o.ts >= f.c + {DAY} THEN o.ts WHEN f.n + 1 >= 3 THEN o.ts ELSE f.c END,
        CASE WHEN o.ts >= f.c + {DAY} THEN 1 WHEN f.n + 1 >= 3 THEN 0 ELSE f.n + 1 END, o.ts < f.c + {DAY} AND f.n + 1 >= 3
      FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id::VARCHAR AS entity_id, 65.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at FROM f WHERE hit""",
)
rule(
    "seq_two_step",
    """events { a : events && event_type == "signup"  p : events && event_type == "purchase" }
    match<user_id:1d:fixed> { on event { first: a | count >= 1; then_: p | count >= 1; } and close { a | count >= 1; } } -> score(90) entity(user, user_id) yield alerts (m = first, other = then_)""",
    f"{ALERT}; m; other",
    f"""WITH {ev("event_type IN ('signup', 'purchase')")}, a AS (SELECT user_id, b, min(struct_pack(t := ts, i := event_id)) AS at FROM e WHERE event_type = 'signup' GROUP BY ALL),
    g AS (SELECT DISTINCT e.user_id, e.b FROM e JOIN a USING (user_id, b) WHERE event_type = 'purchase' AND struct_pack(t := e.ts, i := e.event_id) > a.at)
    SELECT user_id::VARCHAR AS entity_id, 90.0::DOUBLE AS score, {closing()}, 1.0::DOUBLE AS m, 1.0::DOUBLE AS other FROM g, w""",
)
rule(
    "or_branches",
    """events { a : events && event_type == "error"  p : events && event_type == "purchase" }
    match<user_id:1d:fixed> { on event { errors: a | count >= 2 || bought: p | count >= 2; } and close { a | count >= 0; } } -> score(60) entity(user, user_id) yield alerts (m = errors, other = bought)""",
    f"{ALERT}; m; other",
    f"""WITH {ev("event_type IN ('error', 'purchase')")}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, b, event_type ORDER BY ts, event_id) AS rn FROM e),
    g AS (SELECT user_id, b, min_by(event_type, struct_pack(t := ts, i := event_id)) AS k FROM r WHERE rn = 2 GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 60.0::DOUBLE AS score, {closing()}, CASE WHEN k = 'error' THEN 2.0 END::DOUBLE AS m, CASE WHEN k = 'purchase' THEN 2.0 END::DOUBLE AS other FROM g, w""",
)
rule(
    "keyless_global",
    """events { e : events && event_type == "error" } match<:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 10; } } -> score(n) entity(site, "all") yield alerts (n = n)""",
    f"{ALERT}; n; split(summary, ';')[1] AS scope",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT b, count(*) AS n FROM e GROUP BY ALL)
    SELECT 'all' AS entity_id, least(n, 100)::DOUBLE AS score, {closing()}, n, ' scope=global' AS scope FROM g, w WHERE n >= 10""",
)
rule(
    "compound_key",
    """events { e : events } match<user_id, event_type:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 2; } } -> score(20) entity(user, concat(user_id, "/", event_type)) yield alerts (label = e.event_type, n = n)""",
    f"{ALERT}; label; n",
    f"""WITH {ev()}, g AS (SELECT user_id, event_type, b, count(*) AS n FROM e GROUP BY ALL)
    SELECT user_id || '/' || event_type AS entity_id, 20.0::DOUBLE AS score, {closing()}, event_type AS label, n FROM g, w WHERE n >= 2""",
)
rule(
    "key_map_two_sources",
    """events { e : events  o : orders } match<:30d:fixed> { key { who = e.user_id; who = o.o_custkey; } on event { e | count >= 5 || o | count >= 2; } and close { e | count >= 0; } }
    -> score(10) entity(user, who) yield alerts (user = who)""",
    f"{ALERT}; user",
    f"""WITH u AS (SELECT user_id AS who, ts, 'e' AS k FROM events UNION ALL SELECT o_custkey, o_orderdate, 'o' FROM orders), w AS (SELECT max(ts) AS wm FROM u),
    c AS (SELECT who, make_timestamp((epoch_us(ts) // 2592000000000) * 2592000000000) AS b, count(*) FILTER (k = 'e') AS ne, count(*) FILTER (k = 'o') AS no FROM u GROUP BY ALL),
    g AS (SELECT * FROM c WHERE ne >= 5 OR no >= 2)
    SELECT who::VARCHAR AS entity_id, 10.0::DOUBLE AS score, {closing("b + INTERVAL 30 DAY")}, who AS "user" FROM g, w""",
)
rule(
    "multi_stream_union",
    """events { x : both } match<who:30d:fixed> { on event { x | count >= 1; } and close { kinds: x.what | distinct | count >= 3; } } -> score(kinds) entity(user, who) yield alerts (m = kinds)""",
    f"{ALERT}; m",
    f"""WITH u AS (SELECT user_id AS who, ts, event_type AS k FROM events UNION ALL SELECT o_custkey, o_orderdate, o_orderstatus FROM orders), w AS (SELECT max(ts) AS wm FROM u),
    g AS (SELECT who, make_timestamp((epoch_us(ts) // 2592000000000) * 2592000000000) AS b, count(DISTINCT k) AS n FROM u GROUP BY ALL)
    SELECT who::VARCHAR AS entity_id, n::DOUBLE AS score, {closing("b + INTERVAL 30 DAY")}, n::DOUBLE AS m FROM g, w WHERE n >= 3""",
)
rule(
    "collect_statistics",
    """events { e : events && event_type == "view" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { e | count >= 2; } } -> score(percentile(e.value, 50)) entity(user, user_id)
    yield alerts (n = count(e), m = round(stddev(e.value), 4), other = last(e.value), label = fmt("{}|{}|{}|{}|{}", first(e.value), min(e.value), max(e.value), round(sum(e.value), 2), round(avg(e.value), 3)), list = mvjoin(collect_list(e.event_id), ","))""",
    f"{ALERT}; n; m; other; label; list",
    f"""WITH {ev("event_type = 'view'")}, g AS (SELECT user_id, b, count(*) AS n, list(value ORDER BY ts, event_id) AS vs, list(value ORDER BY value) AS so, stddev_pop(value) AS sd, sum(value) AS su, avg(value) AS av, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM e GROUP BY ALL),
    t AS (SELECT *, so[floor((n - 1) * 0.5 + 0.5)::BIGINT + 1] AS p FROM g)
    SELECT user_id::VARCHAR AS entity_id, least(p, 100.0) AS score, {closing()}, n, floor(sd * 10000 + 0.5) / 10000 AS m, vs[-1] AS other,
    regexp_replace(vs[1]::VARCHAR, '\\.0$', '') || '|' || regexp_replace(so[1]::VARCHAR, '\\.0$', '') || '|' || regexp_replace(so[-1]::VARCHAR, '\\.0$', '') || '|' || regexp_replace((floor(su * 100 + 0.5) / 100)::VARCHAR, '\\.0$', '') || '|' || regexp_replace((floor(av * 1000 + 0.5) / 1000)::VARCHAR, '\\.0$', '') AS label, ids AS list FROM t, w WHERE n >= 2""",
)
rule(
    "collect_set_event",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 3; } } -> score(count(e)) entity(user, user_id) yield alerts (list = mvjoin(mvsort(collect_set(e.event_type)), ","), n = mvcount(collect_list(e.value)))""",
    f"{ALERT}; list; n",
    f"""WITH {ev()}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS rn FROM e),
    g AS (SELECT user_id, b, (rn - 1) // 3 AS k, count(*) AS n, max(ts) AS t, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS list FROM r GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 3.0::DOUBLE AS score, 'event' AS origin, {stamp("t")} AS fired_at, list, n FROM g WHERE n = 3""",
)

# Joins.

_ERR = """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(30)"""
rule(
    "snapshot_join",
    f"""{_ERR} join customer snapshot on user_id == customer.c_custkey entity(user, user_id) yield alerts (label = customer.c_name, m = customer.c_acctbal)""",
    f"{ALERT}; label; m",
    f"""SELECT user_id::VARCHAR AS entity_id, 30.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at, c_name AS label, c_acctbal AS m
    FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'error'""",
)
rule(
    "chained_joins",
    f"""{_ERR} join customer snapshot on user_id == customer.c_custkey join nation snapshot on customer.c_nationkey == nation.n_nationkey entity(user, user_id) yield alerts (label = nation.n_name, other = n_regionkey)""",
    f"{ALERT}; label; other",
    f"""SELECT user_id::VARCHAR AS entity_id, 30.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at, n_name AS label, n_regionkey::DOUBLE AS other
    FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE event_type = 'error'""",
)
_ASOF = f"""SELECT e.user_id::VARCHAR AS entity_id, 30.0::DOUBLE AS score, 'event' AS origin, {stamp("e.ts")} AS fired_at"""
rule(
    "asof_join",
    f"""{_ERR} join signups asof on user_id == signups.user_id entity(user, user_id) yield alerts (m = signups.value, other = signups.event_id)""",
    f"{ALERT}; m; other",
    f"""{_ASOF}, s.value AS m, s.event_id::DOUBLE AS other FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""",
)
rule(
    "asof_within",
    f"""{_ERR} join signups asof within 12h on user_id == signups.user_id entity(user, user_id) yield alerts (m = signups.value)""",
    f"{ALERT}; m",
    f"""{_ASOF}, CASE WHEN s.ts >= e.ts - INTERVAL 12 HOUR THEN s.value END AS m FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""",
)
rule(
    "join_at_close",
    """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 2; } } -> score(30)
    join signups asof on user_id == signups.user_id entity(user, user_id) yield alerts (m = signups.value, n = n)""",
    f"{ALERT}; m; n",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT user_id, b, count(*) AS n, max(ts) AS last FROM e GROUP BY ALL HAVING count(*) >= 2)
    SELECT g.user_id::VARCHAR AS entity_id, 30.0::DOUBLE AS score, {closing()}, s.value AS m, n FROM (SELECT * FROM g, w) g ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON g.user_id = s.user_id AND g.last >= s.ts""",
)
rule(
    "has_semi_join",
    """events { e : events && customer.has(user_id, "c_custkey") && event_type == "error" } match<user_id:1d:fixed> { on event { e && signups.has(user_id) | count >= 1; } } -> score(30) entity(user, user_id) yield alerts (user = user_id)""",
    ALERT,
    f"""SELECT user_id::VARCHAR AS entity_id, 30.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at FROM events
    WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer) AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""",
)

# What is done with results.

rule(
    "conv_sort_top",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { total: e.value | sum > 0; } } -> score(80) entity(user, user_id) yield alerts (m = round(total, 2)) conv { sort(-total, user_id) | top(3); }""",
    f"{ALERT}; m; rank",
    f"""WITH {ev()}, g AS (SELECT user_id, b, sum(value) AS s FROM e GROUP BY ALL HAVING sum(value) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s DESC, user_id) AS rank FROM g)
    SELECT user_id::VARCHAR AS entity_id, 80.0::DOUBLE AS score, {closing()}, floor(s * 100 + 0.5) / 100 AS m, rank::INT AS rank FROM r, w WHERE rank <= 3""",
)
rule(
    "conv_dedup_where",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 1; } } -> score(80) entity(user, user_id) yield alerts (n = n) conv { sort(user_id) | dedup(n); where(n >= 2); }""",
    f"{ALERT}; n; rank",
    f"""WITH {ev()}, g AS (SELECT user_id, b, count(*) AS n FROM e GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY b, n ORDER BY user_id) AS k FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY user_id) AS rank FROM d WHERE k = 1 AND n >= 2)
    SELECT user_id::VARCHAR AS entity_id, 80.0::DOUBLE AS score, {closing()}, n, rank::INT AS rank FROM r, w""",
)
rule(
    "pipeline_two_stage",
    """events { e : events } match<user_id, event_type:1d:fixed> { on event { e | count >= 1; } and close { burst: e | count >= 2; } }
    |> match<user_id:10d:fixed> { on event { _in | count >= 1; } and close { kinds: _in.event_type | distinct | count >= 2; most: _in.burst | max >= 2; } } -> score(85) entity(user, _in.user_id) yield alerts (m = kinds, other = most)""",
    f"{ALERT}; m; other",
    f"""WITH {ev()}, g AS (SELECT user_id, event_type, b, count(*) AS n, max(ts) AS last FROM e GROUP BY ALL HAVING count(*) >= 2),
    h AS (SELECT *, make_timestamp((epoch_us(last) // 864000000000) * 864000000000) AS b2 FROM g), w2 AS (SELECT max(last) AS wm FROM h),
    r AS (SELECT user_id, b2, count(DISTINCT event_type) AS k, max(n) AS most FROM h GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 85.0::DOUBLE AS score, {closing("b2 + INTERVAL 10 DAY")}, k::DOUBLE AS m, most::DOUBLE AS other FROM r, w2 WHERE k >= 2""",
)
rule(
    "limits_throttle",
    """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) limits { max_throttle = "3/d"; on_exceed = "throttle"; }""",
    ALERT,
    f"""WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (ORDER BY ts, date_trunc('day', ts), user_id) AS rn FROM events WHERE event_type = 'error'),
    f AS (SELECT user_id, rn, ts, ts AS c, 1 AS n, TRUE AS hit FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.rn, o.ts, CASE WHEN o.ts >= f.c + {DAY} THEN o.ts ELSE f.c END, CASE WHEN o.ts >= f.c + {DAY} THEN 1 WHEN f.n < 3 THEN f.n + 1 ELSE f.n END, o.ts >= f.c + {DAY} OR f.n < 3
      FROM f JOIN o ON o.rn = f.rn + 1)
    SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at FROM f WHERE hit""",
)
rule(
    "limits_instances",
    """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) limits { max_instances = 5; on_exceed = "throttle"; }""",
    f"entity_id; score; fired_at",
    f"""WITH {ev("event_type = 'error'")}, f AS (SELECT user_id, b, min(struct_pack(t := ts, i := event_id)) AS p FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p) AS k FROM f)
    SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, {stamp(f"least(b + {DAY}, wm)")} AS fired_at FROM r, w WHERE k <= 5""",
)
rule(
    "limits_memory",
    """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) limits { max_memory = "1MB"; }""",
    f"entity_id; score; fired_at",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT DISTINCT user_id, b FROM e) SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, {stamp(f"least(b + {DAY}, wm)")} AS fired_at FROM g, w""",
)
rule(
    "score_if_clamped",
    """events { e : events && event_type == "purchase" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { total: e.value | sum > 0; } } -> score(if total > 120 then 500 else if total > 50 then round(total - 60, 2) else 7) entity(user, user_id) yield alerts (n = count(e))""",
    f"{ALERT}; n",
    f"""WITH {ev("event_type = 'purchase'")}, g AS (SELECT user_id, b, sum(value) AS s, count(*) AS n FROM e GROUP BY ALL HAVING sum(value) > 0)
    SELECT user_id::VARCHAR AS entity_id, CASE WHEN s > 120 THEN 100.0 WHEN s > 50 THEN greatest(sign(s - 60) * floor(abs(s - 60) * 100 + 0.5) / 100, 0.0) ELSE 7.0 END AS score, {closing()}, n FROM g, w""",
)
rule(
    "guard_conditions",
    """events { e : events && event_type in ("error", "click") && not_like == not_like || false }
    match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id)""".replace("not_like == not_like || false", 'user_id not in (1, 2, 3) && (value > 30 || contains(props, "9"))'),
    ALERT,
    f"""SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at FROM events WHERE event_type IN ('error', 'click') AND user_id NOT IN (1, 2, 3) AND (value > 30 OR contains(props, '9'))""",
)


@query(
    "pattern_and_variables",
    f"""WITH {ev("event_type = 'error'")}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS rn FROM e)
    SELECT user_id::VARCHAR AS entity_id, 55.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at FROM r WHERE rn % 3 = 0""",
)
def pattern_and_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """pattern burst(alias, n, length) { match<user_id:${length}:fixed> { on event { ${alias} | count >= ${n}; } } -> score(55) }
    rule bursts { events { e : events && event_type == "$KIND" } burst(e, ${LEAST:3}, 1d) entity(user, user_id) yield alerts (user = user_id) }"""
    return engine(spark, sf_dir).run(text.replace('"$KIND"', "${KIND}"), {"KIND": '"error"', "LEAST": "3"}).selectExpr(*ALERT.split("; "))


@query(
    "rules_union",
    f"""SELECT 'a' AS rule_name, event_type AS label, user_id::VARCHAR AS entity_id, {stamp("ts")} AS fired_at, NULL::DOUBLE AS m FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'b', NULL, user_id::VARCHAR, {stamp("ts")}, 1.0 FROM events WHERE event_type = 'signup'""",
)
def rules_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """rule a { events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (label = "error") }
    rule b { events { e : events && event_type == "signup" } match<user_id:1d:fixed> { on event { c: e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (m = c) }"""
    return engine(spark, sf_dir).run_all(text).select("rule_name", "label", "entity_id", "fired_at", "m")


@query("flush_close", None)
def flush_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """rule f { events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { e && close_reason == "flush" | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) }"""
    return engine(spark, sf_dir).run(text, final="flush").selectExpr(*ALERT.split("; "))


ORACLES["flush_close"] = f"""WITH {ev()}, g AS (SELECT DISTINCT user_id, b FROM e) SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, 'close:flush' AS origin, {stamp("wm")} AS fired_at FROM g, w WHERE b + {DAY} > wm"""



# Streams: read to their end, with what is still open left open.


def live(spark: SparkSession, sf_dir: str) -> Engine:
    """The tables, with the events as a stream."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    tables = engine(spark, sf_dir)
    path = f"{sf_dir}/event[s].parquet"  # a pattern, as a stream's path must be that or a folder
    source = spark.readStream.schema(tables.tables["events"].schema).parquet(path)
    return Engine.of(SCHEMAS, {**tables.tables, "events": source.withColumn("ts", F.col("ts").cast("timestamp"))}, ORDER)


def stream(name: str, text: str, columns: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on, folder = live(spark, sf_dir), scratch(spark, "stream")
        alerts = stream_alerts(on, on.rules(f"rule {name} {{ {text} }}")[0])
        started = alerts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        started.awaitTermination()
        return spark.read.schema(alerts.schema).parquet(f"{folder}/out").selectExpr(*columns.split("; "))

    QUERIES[name], ORACLES[name], TEXTS[name] = run, sql, text


def batches(name: str, text: str, columns: str, sql: str) -> None:
    """Registers a rule over a stream that needs the emissions of a batch together."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on, folder = live(spark, sf_dir), scratch(spark, "batches")
        write_batches(on, on.rules(f"rule {name} {{ {text} }}")[0], lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), folder)
        return spark.read.parquet(f"{folder}/out").selectExpr(*columns.split("; "))

    QUERIES[name], ORACLES[name] = run, sql


stream(
    "stream_anchored",
    """events { e : events && event_type == "click" } match<user_id:1d> { on event { e | count >= 3; } } -> score(65) entity(user, user_id) yield alerts (user = user_id)""",
    ALERT,
    ORACLES["sliding_chain"],
)
stream(
    "stream_fixed_close",
    """events { e : events && event_type == "error" } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { n: e | count >= 2; } } -> score(70) entity(user, user_id) yield alerts (n = count(e))""",
    f"{ALERT}; n",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT user_id, b, count(*) AS n FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 70.0::DOUBLE AS score, {closing()}, n FROM g, w WHERE n >= 2 AND b + {DAY} <= wm""",
)
stream(
    "stream_join",
    f"""{_ERR} join customer snapshot on user_id == customer.c_custkey entity(user, user_id) yield alerts (label = customer.c_name)""",
    f"{ALERT}; label",
    f"""SELECT user_id::VARCHAR AS entity_id, 30.0::DOUBLE AS score, 'event' AS origin, {stamp("ts")} AS fired_at, c_name AS label FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'error'""",
)


def text_of(rule_name: str) -> str:
    """The text of a rule that was registered above."""
    return TEXTS[rule_name]


batches("stream_throttle", text_of("limits_throttle"), ALERT, ORACLES["limits_throttle"])
batches(
    "stream_instances",
    text_of("limits_instances"),
    "entity_id; score; fired_at",
    f"""WITH {ev("event_type = 'error'")}, f AS (SELECT user_id, b, min(struct_pack(t := ts, i := event_id)) AS p FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p) AS k FROM f)
    SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, {stamp(f"b + {DAY}")} AS fired_at FROM r, w WHERE k <= 5 AND b + {DAY} <= wm""",
)
batches("stream_sort_top", text_of("conv_sort_top"), f"{ALERT}; m; rank", f"SELECT * FROM ({ORACLES['conv_sort_top']}) WHERE origin = 'close:timeout'")
batches("stream_dedup_where", text_of("conv_dedup_where"), f"{ALERT}; n; rank", f"SELECT * FROM ({ORACLES['conv_dedup_where']}) WHERE origin = 'close:timeout'")
batches("stream_asof", text_of("asof_join"), f"{ALERT}; m; other", ORACLES["asof_join"])
batches(
    "stream_two_stage",
    text_of("pipeline_two_stage"),
    f"{ALERT}; m; other",
    f"""WITH {ev()}, g AS (SELECT user_id, event_type, b, count(*) AS n, max(ts) AS last FROM e, w GROUP BY ALL HAVING count(*) >= 2 AND b + {DAY} <= max(wm)),
    h AS (SELECT *, make_timestamp((epoch_us(last) // 864000000000) * 864000000000) AS b2 FROM g), w2 AS (SELECT max(last) - {DAY} AS wm FROM h),
    r AS (SELECT user_id, b2, count(DISTINCT event_type) AS k, max(n) AS most FROM h GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 85.0::DOUBLE AS score, 'close:timeout' AS origin, {stamp("b2 + INTERVAL 10 DAY")} AS fired_at, k::DOUBLE AS m, most::DOUBLE AS other FROM r, w2 WHERE k >= 2 AND b2 + INTERVAL 10 DAY <= wm""",
)


@query(
    "stream_drain",
    f"""WITH {ev("event_type = 'error'")}, g AS (SELECT user_id, b, count(*) AS n FROM e GROUP BY ALL)
    SELECT user_id::VARCHAR AS entity_id, 70.0::DOUBLE AS score, 'close:flush' AS origin, {stamp("wm")} AS fired_at, n FROM g, w WHERE n >= 2 AND b + {DAY} > wm""",
)
def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closing the windows that a stopped stream has left open gives."""
    on, folder = live(spark, sf_dir), scratch(spark, "drain")
    rule_ = on.rules(f"rule stream_drain {{ {text_of('stream_fixed_close')} }}")[0]
    stream_alerts(on, rule_).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return drain(on, rule_, f"{folder}/state").selectExpr(*f"{ALERT}; n".split("; "))


@query("close_one_key", f"""WITH {ev()} SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, 'close:flush' AS origin, {stamp("max(ts)")} AS fired_at FROM e WHERE user_id = 3 GROUP BY user_id, b HAVING b + {DAY} > (SELECT max(ts) FROM e WHERE user_id = 3)""")
def close_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = engine(spark, sf_dir)
    rule_ = on.rules("rule c { events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { e | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (user = user_id) }")[0]
    return on.close_key(rule_, {"user_id": 3}).selectExpr(*ALERT.split("; "))


# Expressions.


def expressions(name: str, window: str, keep: str, items: dict[str, tuple[str, str]], sql_from: str, strict: bool = False) -> None:
    """Registers expressions over a window: for each its text and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).select(window, {k: t for k, (t, _) in items.items()}, (keep,), strict)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {keep}, {', '.join(f'{s} AS {k}' for k, (_, s) in items.items())} FROM {sql_from}"


expressions(
    "fn_string_tests", "customer", "c_custkey",
    {
        "a": ('contains(c_name, "01")', "contains(c_name, '01')"), "b": ('startswith(c_mktsegment, "BU")', "starts_with(c_mktsegment, 'BU')"), "c": ('endswith(c_name, "7")', "suffix(c_name, '7')"),
        "d": ('startswith_any(c_mktsegment, "AU", "MA")', "(starts_with(c_mktsegment, 'AU') OR starts_with(c_mktsegment, 'MA'))"), "e": ('endswith_any(c_name, "1", "22")', "(suffix(c_name, '1') OR suffix(c_name, '22'))"),
        "f": ('regex_match(c_name, "0[1-3]+$")', "regexp_matches(c_name, '0[1-3]+$')"), "g": ("len(c_mktsegment)", "strlen(c_mktsegment)::DOUBLE"), "h": ('indexof(c_name, "#")', "(instr(c_name, '#') - 1)::DOUBLE"),
        "i": ('indexof(c_mktsegment, "Z")', "(instr(c_mktsegment, 'Z') - 1)::DOUBLE"),
    }, "customer",
)
expressions(
    "fn_string_changes", "customer", "c_custkey",
    {
        "a": ("substr(c_name, 1, 8)", "c_name[1:8]"), "b": ("substr(c_name, -3)", "c_name[-3:]"), "c": ("substr(c_name, -40, 2)", "c_name[1:2]"), "d": ("substr(c_name, 3, 0)", "''"),
        "e": ('replace(c_name, "0+", "_")', "regexp_replace(c_name, '0+', '_', 'g')"), "f": ('replace_plain(c_name, "#", "")', "replace(c_name, '#', '')"), "g": ('trim(concat("  ", c_mktsegment, " "))', "c_mktsegment"),
        "h": ('ltrim("  x ")', "'x '"), "i": ('rtrim(concat(c_name, "  "))', "c_name"), "j": ("lower(c_mktsegment)", "lower(c_mktsegment)"), "k": ("upper(c_name)", "upper(c_name)"),
        "l": ('concat(c_name, "/", c_custkey, "/", true)', "c_name || '/' || c_custkey || '/true'"), "m": ('fmt("{} of {}: {}", c_custkey, c_mktsegment, 2.5)', "c_custkey || ' of ' || c_mktsegment || ': 2.5'"),
    }, "customer",
)
expressions(
    "fn_array", "part", "p_partkey",
    {
        "a": ('mvcount(split(p_name, " "))', "len(string_split(p_name, ' '))::DOUBLE"), "b": ('mvjoin(mvreverse(split(p_name, " ")), "-")', "array_to_string(list_reverse(string_split(p_name, ' ')), '-')"),
        "c": ('mvindex(split(p_name, " "), 0)', "string_split(p_name, ' ')[1]"), "d": ('mvindex(split(p_name, " "), -1)', "string_split(p_name, ' ')[-1]"), "e": ('mvindex(split(p_name, " "), 9)', "NULL::VARCHAR"),
        "f": ('mvjoin(mvindex(split("a,b,c,d", ","), 1, 2), "+")', "'b+c'"), "g": ('mvjoin(mvappend(split(p_name, " "), p_type, p_brand), ",")', "array_to_string(string_split(p_name, ' ') || [p_type, p_brand], ',')"),
        "h": ('mvjoin(mvdedup(split("b,a,b", ",")), ",")', "'b,a'"), "i": ('mvjoin(mvsort(split(p_name, " ")), ",")', "array_to_string(list_sort(string_split(p_name, ' ')), ',')"), "j": ('mvcount(split(p_type, ""))', "strlen(p_type)::DOUBLE"),
    }, "part",
)
expressions(
    "fn_math", "customer", "c_custkey",
    {
        "a": ("abs(c_acctbal)", "abs(c_acctbal)"), "b": ("ceil(c_acctbal)", "ceil(c_acctbal)"), "c": ("floor(c_acctbal)", "floor(c_acctbal)"), "d": ("round(c_acctbal / 7, 2)", "sign(c_acctbal / 7) * floor(abs(c_acctbal / 7) * 100 + 0.5) / 100"),
        "e": ("round(sqrt(c_acctbal), 6)", "CASE WHEN c_acctbal >= 0 THEN floor(sqrt(c_acctbal) * 1000000 + 0.5) / 1000000 END"), "f": ("pow(c_nationkey, 2)", "(c_nationkey * c_nationkey)::DOUBLE"),
        "g": ("round(log(c_acctbal), 4)", "CASE WHEN c_acctbal > 0 THEN sign(ln(c_acctbal)) * floor(abs(ln(c_acctbal)) * 10000 + 0.5) / 10000 END"), "h": ("log(c_nationkey, 1)", "NULL::DOUBLE"),
        "i": ("round(exp(c_nationkey / 10), 4)", "floor(exp(c_nationkey / 10) * 10000 + 0.5) / 10000"), "j": ("clamp(c_acctbal, 0, 5000)", "least(greatest(c_acctbal, 0.0), 5000.0)"), "k": ("clamp(c_acctbal, 5, 0)", "NULL::DOUBLE"),
        "l": ("sign(c_nationkey - 12)", "CASE WHEN c_nationkey < 12 THEN -1.0 ELSE 1.0 END::DOUBLE"), "m": ("trunc(c_acctbal)", "trunc(c_acctbal)"), "n": ("is_finite(c_acctbal)", "TRUE"), "o": ("exp(1000)", "NULL::DOUBLE"),
        "p": ("round(c_acctbal, -2)", "sign(c_acctbal) * floor(abs(c_acctbal) * 0.01 + 0.5) / 0.01"),
    }, "customer",
)
expressions(
    "fn_time", "events", "event_id",
    {
        "a": ('strftime(ts, "%Y-%m-%d %H:%M:%S")', "strftime(ts, '%Y-%m-%d %H:%M:%S')"), "b": ('strftime(time_bucket(ts, 3600), "%FT%T")', "strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S')"),
        "c": ('time_diff(ts, strptime("2024-01-01", "%Y-%m-%d"))', "abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"), "d": ('strftime(strptime("2024-02-03 04:05:06", "%Y-%m-%d %H:%M:%S"), "%j/%y")', "'034/24'"),
        "e": ('isnull(strptime("nonsense", "%Y-%m-%d"))', "TRUE"), "f": ("isnull(time_bucket(ts, 0))", "TRUE"), "g": ('ts >= strptime("2024-01-15", "%Y-%m-%d")', "ts >= TIMESTAMP '2024-01-15'"),
    }, "events",
)
expressions(
    "fn_null_and_if", "events", "event_id",
    {
        "a": ('coalesce(mvindex(split(event_type, "i"), 1), event_type)', "coalesce(string_split(event_type, 'i')[2], event_type)"), "b": ('isnull(mvindex(split(event_type, "i"), 1))', "NOT contains(event_type, 'i')"),
        "c": ("isnotnull(value)", "value IS NOT NULL"), "d": ("if value > 20 then value else 0 - value", "CASE WHEN value > 20 THEN value ELSE -value END"), "e": ("isnull(if sqrt(0 - 1) > 0 then 1 else 2)", "TRUE"),
        "f": ("value % 7", "value % 7"), "g": ("value / (user_id - user_id)", "NULL::DOUBLE"), "h": ("-value * 2 + 1", "-value * 2 + 1"), "i": ('coalesce(sqrt(0 - 1), "none")', "'none'"),
    }, "events",
)
expressions(
    "compare_guard", "events", "event_id",
    {
        "a": ('event_type == value', "FALSE"), "b": ('event_type != value', "FALSE"), "c": ("value >= 10 && value < 20", "value >= 10 AND value < 20"), "d": ('event_type > "m"', "event_type > 'm'"),
        "e": ('event_type in ("click", 3)', "event_type = 'click'"), "f": ("user_id not in (1, 2)", "user_id NOT IN (1, 2)"), "g": ("isnull(sqrt(0 - 1) in (1, 2))", "TRUE"), "h": ("isnull(sqrt(0 - 1) > 0 && true)", "TRUE"),
        "i": ("sqrt(0 - 1) > 0 || value > 0", "TRUE"), "j": ("sqrt(0 - 1) > 0 && false", "FALSE"),
    }, "events", strict=True,
)
expressions("compare_output", "events", "event_id", {"a": ("event_type == value", "FALSE"), "b": ("event_type != value", "TRUE"), "c": ("true > false", "TRUE")}, "events")
expressions("has_expression", "events", "event_id", {"a": ('customer.has(user_id, "c_custkey")', "user_id IN (SELECT c_custkey FROM customer)"), "b": ("isnull(nowhere.has(user_id))", "TRUE")}, "events")

# Operators by themselves.

_BASE = "event_id, user_id"


@query(
    "baseline_mean",
    """SELECT event_id, CASE WHEN coalesce(sd, 0) = 0 THEN 0.0 ELSE round((value - m) / sd, 6) END AS z FROM (SELECT *, avg(value) OVER x AS m, stddev_pop(value) OVER x AS sd FROM events
    WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def baseline_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(engine(spark, sf_dir).tables["events"], "value", ["user_id"], ["ts", "event_id"], "mean", "z").select("event_id", F.round("z", 6).alias("z"))


@query(
    "baseline_median",
    """SELECT event_id, CASE WHEN coalesce(m, 0) = 0 THEN 0.0 ELSE round((value - m) / abs(m), 6) END AS z FROM (SELECT *, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS m FROM events)""",
)
def baseline_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(engine(spark, sf_dir).tables["events"], "value", ["user_id"], ["ts", "event_id"], "median", "z").select("event_id", F.round("z", 6).alias("z"))


@query(
    "baseline_ewma",
    """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, 0.0::DOUBLE AS z, value AS m FROM o WHERE rn = 1 UNION ALL
      SELECT o.user_id, o.event_id, o.rn, CASE WHEN f.m = 0 THEN 0.0 ELSE (o.value - f.m) / abs(f.m) END, 0.3 * o.value + 0.7 * f.m FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT event_id, round(z, 6) AS z FROM f""",
)
def baseline_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(engine(spark, sf_dir).tables["events"], "value", ["user_id"], ["ts", "event_id"], "ewma", "z").select("event_id", F.round("z", 6).alias("z"))


rule(
    "baseline_guard",
    """events { e : events } match<user_id:1d:fixed> { on event { e | count >= 1; } and close { odd: e && baseline(value, 1d) > 1 | count >= 1; } } -> score(1) entity(user, user_id) yield alerts (n = odd)""",
    f"{ALERT}; n",
    f"""WITH {ev()}, z AS (SELECT *, avg(value) OVER x AS m, stddev_pop(value) OVER x AS sd FROM e WINDOW x AS (PARTITION BY user_id, b ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT user_id, b, count(*) FILTER (coalesce(sd, 0) > 0 AND (value - m) / sd > 1) AS n FROM z GROUP BY ALL HAVING n >= 1)
    SELECT user_id::VARCHAR AS entity_id, 1.0::DOUBLE AS score, {closing()}, n FROM g, w""",
)

_LATE = """WITH a AS (SELECT *, event_id + CASE WHEN event_id % 7 = 0 THEN 40 ELSE 0 END AS arrival FROM events),
    s AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).tables["events"].withColumn("arrival", F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 40).otherwise(0))


@query("late_drop", f"{_LATE} SELECT event_id FROM s WHERE NOT coalesce(ts < seen - INTERVAL 10 MINUTE, FALSE)")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_late(_arrivals(spark, sf_dir), "ts", ["arrival", "event_id"], 600)[0].select("event_id")


@query("late_side_output", f"{_LATE} SELECT event_id FROM s WHERE ts < seen - INTERVAL 15 MINUTE")
def late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_late(_arrivals(spark, sf_dir), "ts", ["arrival", "event_id"], 600, 300)[1].select("event_id")


@query("snapshot_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).tables["events"]
    return retained(df, "ts", 5 * 86400).select("event_id")


@query("number_texts", "SELECT event_id, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS t FROM events")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).tables["events"].select("event_id", number_text(F.col("value")).alias("t"))


@query(
    "asof_operator",
    """SELECT o.o_orderkey, p.o_orderkey AS prev_key FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate + INTERVAL 1 MICROSECOND AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) p ON o.o_custkey = p.o_custkey AND o.o_orderdate >= p.t""",
)
def asof_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = engine(spark, sf_dir).tables["orders"]
    left = o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    right = o.select("o_custkey", "o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 MICROSECOND")).alias("t"))
    got = joins.asof(left, right, [(F.col("o_custkey"), "o_custkey")], "at", "t", "p.", order="o_orderkey")
    return got.select("o_orderkey", F.col("`p.o_orderkey`").alias("prev_key"))


@query("sink_routes", "SELECT CASE WHEN event_type LIKE 'e%' OR event_type LIKE '%up' THEN 'security' WHEN event_type = 'view' THEN 'reading' ELSE 'default' END AS sink, count(*) AS n FROM events GROUP BY ALL")
def sink_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = sinks.Routes([("security", ["e*", "*up"]), ("reading", ["vie?"])], "default")
    df = engine(spark, sf_dir).tables["events"].withColumn("yield_target", F.col("event_type"))
    return routes.tagged(df).groupBy("sink").agg(F.count("*").alias("n"))


@query("gen_traffic", "SELECT i AS seq, 1704067200000000 + i * 6000000 AS at_us, 'u' || ((i * 7919 + 42) % 50) AS who, ((i * 104729 + 42) % 1000) / 10.0::DOUBLE AS amount FROM range(500) t(i)")
def gen_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.spaced(spark, 500, 3000, 1_704_067_200).select("seq", F.unix_micros("ts").alias("at_us"), traffic.pooled(F.col("seq"), "u", 50, 7919, 42).alias("who"), traffic.ranged(F.col("seq"), 1000, 10.0, 104729, 42).alias("amount"))


@query(
    "gen_faults",
    """SELECT event_id, copy, CASE WHEN event_id % 11 = 3 THEN event_id + 5 ELSE event_id END AS arrival FROM events, range(2) t(copy) WHERE event_id % 13 <> 4 AND (copy = 0 OR event_id % 17 = 5)""",
)
def gen_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).tables["events"]
    e = F.col("event_id")
    return faults.inject(df, arrival=e, out_of_order=(e % 11 == 3, 5), duplicate=e % 17 == 5, drop=e % 13 == 4).select("event_id", F.col("copy").cast("bigint").alias("copy"), "arrival")


@query(
    "verify_alerts",
    """WITH a AS (SELECT event_id, user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT user_id, event_type, ts, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value, event_id FROM events WHERE event_id % 3 <> 0)
    SELECT CASE WHEN event_id % 3 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'field_mismatch' ELSE 'matched' END AS status, count(*) AS n FROM a GROUP BY ALL""",
)
def verify_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).tables["events"]
    base = df.select(F.lit("r").alias("rule_name"), F.lit("user").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.col("event_type").alias("origin"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("score"), "event_id")
    actual = base.where("event_id % 3 <> 0").withColumn("score", F.when(F.col("event_id") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return verify.compare(base, actual).groupBy("status").agg(F.count("*").alias("n"))


from . import tool_queries as _tool_queries  # noqa: E402, F401  registers the queries of sources, sinks, tools and generators
