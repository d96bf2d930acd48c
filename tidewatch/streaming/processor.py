"""Rules over streams: the same matching as in batch, with the open windows in Spark's state store.

Bound events are dealt by a hash of their key to ``SHARDS`` groups, each with a stateful processor: to speak with the state store and to
make a table takes some milliseconds, which must not be spent on each key.  A group keeps the open windows of its keys together (those of
anchored and session windows in one piece, those of fixed ones in a piece for each beginning) in a map of the state store, of which a batch
reads only the pieces that its events or timers touch, and one timer at the first end of its windows, which closes what has ended by the watermark then.
Events of a batch are sorted by time; what is older than the watermark was dropped before.  Rules with ``max_instances`` or ``max_memory`` count
the windows of all keys, so one processor holds them all, as in batch.

What needs the emissions of a batch together (``conv``, ``max_throttle``, as-of joins, stages after the first) is done by
``write_batches`` on each micro-batch: ``conv`` needs fixed windows, and those that end together close together, when the watermark passes their end.  ``stream_alerts``
refuses such rules.  ``drain`` closes what a stopped stream has left open.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..engine import Engine
from ..lang.ast import Rule
from ..lang.tokens import RuleError
from ..operators import bind, match, output
from ..operators.machine import Instance, Machine
from ..plans.plan import StagePlan, stage_plans

WINDOWS, ENDS = "windows", "ends"
#: Groups that keys are dealt to.  A checkpoint holds windows by group, so this can't change under it.
SHARDS = 1024
#: Emissions that go on together.
ROWS = 5000
TIMES = ("fired", "last", "created", "end")


def _same(v: Any) -> Any:
    """One object for all that is no number, so that keys of it are equal."""
    return match.NAN if v != v else v


def _times(us: Iterable[int]) -> pd.Series:
    return pd.Series(np.array(us, "datetime64[us]")).dt.tz_localize("UTC")


def _first(ends: Mapping[int, int]) -> int | None:
    """The time of the timer for these ends."""
    return _millis(min(ends.values())) if ends else None


def _millis(us: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-us // 1000)


class _Processor(StatefulProcessor):
    """Reads the rows of a batch in order and writes emissions."""

    def __init__(self, plan: StagePlan, out: list[str]) -> None:
        self.plan, self.out = plan, out
        self.names: dict[str, int] = {}
        self.keys: list[int] = []

    def ordered(self, parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """The rows in order; ``names`` and ``keys`` are the places of their columns from then on."""
        some = list(parts)
        events = some[0] if len(some) == 1 else pd.concat(some, ignore_index=True)
        read = [i for i, c in enumerate(events.columns) if c not in ("ts", "shard")]
        self.names = {events.columns[i]: k for k, i in enumerate(read)}
        self.keys = [self.names[f"k{i}"] for i in range(len(self.plan.key_names))]
        rows = list(zip(*[events.iloc[:, i].tolist() for i in read]))
        order = np.lexsort([events[c].to_numpy() for c in ("grp", "seq", "us")])
        return (rows[i] for i in order.tolist())

    def key(self, row: tuple) -> tuple:
        return tuple([_same(row[i]) for i in self.keys])

    def rows(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame({c: _times(v) if c in TIMES else pd.Series(v) for c, v in zip(self.out, zip(*found))})

    def close(self) -> None:
        pass


class Matcher(_Processor):
    """The windows of a group's keys, in pieces by their beginning (one piece, 0, where a key has one window at most)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = Machine(self.plan)
        self.state = handle.getMapState(WINDOWS, "at bigint", "data binary")
        self.ends = handle.getValueState(ENDS, "data binary")

    def pieces(self) -> dict[int, int]:
        """The first end of each piece that there is."""
        got = self.ends.get() if self.ends.exists() else None
        return pickle.loads(bytes(got[0])) if got else {}

    def keep(self, before: int | None, ends: dict[int, int]) -> None:
        """Keeps what pieces there are; the timer moves from ``before`` if the first end has."""
        due = _first(ends)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if ends:
            self.ends.update((pickle.dumps(ends),))
        else:
            self.ends.clear()

    def load(self, at: int, ends: dict[int, int]) -> dict[tuple, Instance]:
        """A piece: windows by key."""
        if at not in ends:
            return {}
        held = pickle.loads(bytes(self.state.getValue((at,))[0]))
        return {tuple([_same(v) for v in key]): Instance.of_plain(w) for key, w in held.items()}

    def save(self, at: int, ends: dict[int, int], windows: dict[tuple, Instance]) -> None:
        """Keeps a piece, or forgets it if there is nothing in it."""
        held = {key: w for key, w in windows.items() if not self.machine.idle(w)}
        if held:
            self.state.updateValue((at,), (pickle.dumps({key: w.plain() for key, w in held.items()}),))
            ends[at] = min(map(self.machine.end, held.values()))
        elif at in ends:
            self.state.removeKey((at,))
            del ends[at]

    def closed(self, key: tuple, w: Instance) -> list[tuple]:
        e = self.machine.close(w, "timeout", self.machine.end(w))
        return [(0, *match.emission_row(self.plan, key, e, int))] if e else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        fixed, at = self.machine.kind == "fixed", None
        windows: dict[tuple, Instance] = {}
        ends = self.pieces()
        before = _first(ends)
        for row in self.ordered(rows):
            ts = row[self.names["us"]]
            own = ts - ts % self.machine.length if fixed else 0
            if own != at:
                if at is not None:
                    self.save(at, ends, windows)
                at, windows = own, self.load(own, ends)
            k = self.key(row)
            w = windows.get(k)
            if w is not None and not fixed and self.machine.expired(w, ts):  # fixed ones close by the watermark, as others' events may still come for them
                found += self.closed(k, w)
                del windows[k]
                w = None
            for offer in match.offers_of(self.plan, row, self.names):
                if w is None:
                    w = windows[k] = self.machine.open(ts)
                e = self.machine.offered(w, ts, offer)
                if e:
                    found.append((0, *match.emission_row(self.plan, k, e, int)))
            if len(found) >= ROWS:
                yield from self.rows(found)
                found = []
        if at is not None:
            self.save(at, ends, windows)
        self.keep(before, ends)
        yield from self.rows(found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        ends = self.pieces()
        for at in sorted(at for at, end in ends.items() if end <= now):
            windows, left = self.load(at, ends), {}
            for k, w in windows.items():
                if self.machine.expired(w, now):
                    found += self.closed(k, w)
                else:
                    left[k] = w
            self.save(at, ends, left)
            if len(found) >= ROWS:
                yield from self.rows(found)
                found = []
        self.keep(None, ends)  # the timer that went off is taken away by the caller
        yield from self.rows(found)


class Crew(_Processor):
    """All keys' windows together; the limits bound what is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(WINDOWS, "data binary")

    def load(self) -> match.Fleet:
        fleet = match.Fleet(self.plan)
        if self.state.exists():
            fleet.restore(pickle.loads(bytes(self.state.get()[0])))
        return fleet

    def save(self, fleet: match.Fleet) -> None:
        self.state.update((pickle.dumps(fleet.plain()),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if fleet.open:
            self.handle.registerTimer(_millis(min(fleet.machine.end(w) for w in fleet.open.values())))

    def emitted(self, got: Iterator[tuple[tuple, Any]]) -> list[tuple]:
        return [(0, *match.emission_row(self.plan, key, e, int)) for key, e in got]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fleet, found = self.load(), []
        for row in self.ordered(rows):
            ts = row[self.names["us"]]
            found += self.emitted(fleet.due(ts))
            if not fleet.failed:
                found += self.emitted(fleet.offer(self.key(row), ts, match.offers_of(self.plan, row, self.names)))
        self.save(fleet)
        yield from self.rows(found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fleet = self.load()
        found = self.emitted(fleet.due(expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self.save(fleet)
        yield from self.rows(found)


def _all_together(plan: StagePlan) -> bool:
    return plan.strategy == "global_fold"


def _shape(plan: StagePlan, events: DataFrame) -> str:
    """The schema of what a processor yields."""
    types = dict(events.dtypes)
    return ", ".join(["shard int", *[f"k{i} {types[f'k{i}']}" for i in range(len(plan.key_names))], match.BASE_COLUMNS, *[f"n{i} {t}" for i, t in enumerate(match.need_types(plan, events))]])


def emissions(engine: Engine, plan: StagePlan, tables: Mapping[str, DataFrame], delay: str) -> DataFrame:
    """The stream of a stage's emissions."""
    events = bind.bind(plan, tables, engine.schemas, engine.order).withWatermark("ts", delay)
    keys, schema = [f"k{i}" for i in range(len(plan.key_names))], _shape(plan, events)
    alone = not keys or _all_together(plan)
    # Names must not begin with an underscore: Spark gives such columns others on the way to Python.
    stamped = events.withColumn("us", F.unix_micros("ts")).withColumn("shard", F.lit(0) if alone else F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int"))
    out = [c.split(" ")[0] for c in schema.split(", ")]
    processor = (Crew if _all_together(plan) else Matcher)(plan, out)
    df = stamped.groupBy("shard").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return df.drop("shard")


def stream_alerts(engine: Engine, rule: Rule, delay: str = "0 seconds") -> DataFrame:
    """The alerts of a rule whose bound windows are streaming DataFrames (with a timestamp time field).

    Joined windows must be tables.  The session needs the RocksDB state store.  Rules that need the emissions of a batch together are refused.
    """
    plans = stage_plans(rule)
    asks = [what for what, there in (
        ("conv", rule.conv), ("max_throttle", rule.limits and rule.limits.max_throttle), ("stages after the first", len(plans) > 1), ("as-of joins", any(j.mode != "snapshot" for p in plans for j in p.match.joins)),
    ) if there]
    if asks:
        raise RuleError(f"rule {rule.name}: a stream of single alerts can't do {' and '.join(asks)}: use write_batches")
    (plan,) = plans
    return engine.told(rule, plan, engine.joined(rule, plan, emissions(engine, plan, engine.tables, delay)))


def _throttled(df: DataFrame, plan: StagePlan, folder: str, batch: int) -> DataFrame:
    """What ``max_throttle`` lets pass of a batch, as ``match.marked`` gives it, persisted.  The state after each batch is a small table named by its number, so a batch that is done again begins as it did."""
    spark = df.sparkSession
    state = match.UNTHROTTLED
    if batch:
        r = spark.read.parquet(f"{folder}/throttle/{batch - 1}").first()
        state = (r["_start"], r["_count"], r["_failed"])
    rows = match.marked(df, plan.limits, state).persist()  # those that pass, and a few more
    last = rows.agg(F.max_by(F.struct("_start", "_count", "_failed"), "_at").alias("s")).first()["s"]
    spark.createDataFrame([tuple(last or state)], "_start bigint, _count bigint, _failed boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/throttle/{batch}")
    return rows


def write_batches(engine: Engine, rule: Rule, write: Callable[[DataFrame, int], None], folder: str, delay: str = "0 seconds", trigger: Mapping[str, Any] | None = None) -> list[StreamingQuery]:
    """Runs any rule over streams: ``write`` gets the alerts of each micro-batch and its number, which is the same if a batch is done again.

    ``folder`` is shared by driver and executors, and holds the checkpoints of the stages, the rows that go from one to the next and the state of the throttle.
    Without a ``trigger`` each stage reads what is there, one after another, and the call returns when all are done; with one
    (such as {"processingTime": "10 seconds"}) all are started and keep running.  A stage's watermark allows for the length of the windows before it.
    """
    spark = next(iter(engine.tables.values())).sparkSession
    plans, tables, queries = stage_plans(rule), dict(engine.tables), []
    for k, plan in enumerate(plans):
        last = k == len(plans) - 1
        found = emissions(engine, plan, tables, delay)

        def each(df: DataFrame, batch: int, k: int = k, plan: StagePlan = plan, last: bool = last) -> None:
            kept, held = df, [df.persist()]
            try:
                if plan.limits and plan.limits.max_throttle:
                    held.append(_throttled(df, plan, folder, batch))
                    kept = match.kept(held[-1])
                rows = engine.joined(rule, plan, kept)
                if last:
                    write(engine.told(rule, plan, engine.conversed(rule, plan, rows)), batch)
                else:
                    output.stage_rows(plan, rows).write.mode("overwrite").parquet(f"{folder}/stage{k}/batch={batch}")
            finally:
                for one in held:
                    one.unpersist()

        started = found.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint{k}").trigger(**(trigger or {"availableNow": True})).start()
        queries.append(started)
        if trigger is None:
            started.awaitTermination()
        if not last:
            shape = output.stage_rows(plan, engine.joined(rule, plan, found)).schema
            spark.createDataFrame([], shape).write.mode("ignore").parquet(f"{folder}/stage{k}/batch=-1")
            tables[f"_{rule.name}_{k + 1}"] = spark.readStream.schema(shape).option("basePath", f"{folder}/stage{k}").parquet(f"{folder}/stage{k}")
            delay = f"{delay} {math.ceil(plan.match.window.seconds)} seconds"
    return queries


def drain(engine: Engine, rule: Rule, checkpoint: str, final: str = "flush") -> DataFrame:
    """The alerts of closing all windows that a stopped stream of a one-stage rule has left open in the state under ``checkpoint``.

    ``engine`` is that of the stream.  Windows close at the latest event's time of those that are open, by timeout if their end has come by then.
    """
    (plan,) = stage_plans(rule)
    spark = next(iter(engine.tables.values())).sparkSession
    schema = _shape(plan, bind.bind(plan, engine.tables, engine.schemas, engine.order)).removeprefix("shard int, ")
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", WINDOWS).load()
    fleet = _all_together(plan)
    flat = state.select(F.col("value.data" if fleet else "user_map_value.data").alias("data"))
    out = [c.split(" ")[0] for c in schema.split(", ")]

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Instance]]:
        for p in parts:
            for data in p["data"]:
                got = pickle.loads(bytes(data))
                for key, w in (got["open"] if fleet else got).items():
                    yield key, Instance.of_plain(w)

    def latest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = max((w.last for _, w in windows(parts)), default=None)
        yield pd.DataFrame({"last": [] if last is None else [last]}, dtype="int64")

    now = flat.mapInPandas(latest, "last bigint").agg(F.max("last")).first()[0]

    def shut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, found = Machine(plan), []
        for key, w in windows(parts):
            found += [match.emission_row(plan, key, e) for key, e in match._finish(machine, key, w, now, final)]
            if len(found) >= ROWS:
                yield pd.DataFrame(found, columns=out)
                found = []
        yield pd.DataFrame(found, columns=out)

    df = flat.mapInPandas(shut, schema)
    return engine.told(rule, plan, engine.conversed(rule, plan, engine.joined(rule, plan, df)))


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
