"""Matching: bound events to emissions, by the strategy of the stage's plan.

An emission has k0.. (the keys), origin, fired, last, created and end (times), s_branch and s_value (the winning branch and
measure of each event step), c_branch and c_value (of each close step), and n0.. (what the output needs).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.compile import constant, truth
from ..lang.ast import Branch, Limits
from ..plans.plan import StagePlan, crossing
from .machine import Emission, Instance, Machine, Offer

BASE_COLUMNS = "origin string, fired timestamp, last timestamp, created timestamp, end timestamp, s_branch array<int>, s_value array<double>, c_branch array<int>, c_value array<double>"


def _keys(plan: StagePlan) -> list[str]:
    return [f"k{i}" for i in range(len(plan.key_names))]


def watermark(events: DataFrame, clock: int | None = None) -> Column:
    """The latest event time, as a scalar subquery, or the given clock (microseconds)."""
    return events.agg(F.max("ts").alias("wm")).scalar() if clock is None else F.timestamp_micros(F.lit(clock))


def need_types(plan: StagePlan, events: DataFrame) -> list[str]:
    types = dict(events.dtypes)
    got = []
    for i, need in enumerate(plan.needs):
        own = types[f"n{i}"]
        got.append(f"array<{own}>" if need.kind == "list" else own if need.kind in ("min", "max") else "double")
    return got


def run(plan: StagePlan, events: DataFrame, final: str | None = "eos", clock: int | None = None) -> DataFrame:
    """The stage's emissions.  ``final`` is how windows close that are open at the end; none leaves them open.

    The end is the latest event's time, or ``clock``.
    """
    strategy = plan.strategy
    plain = all(not b.distinct or b.measure == "count" for b in plan.branches)
    if strategy == "close_agg" and plain:
        return close_agg(plan, events, final, clock)
    if strategy == "count_or_close" and plain:
        return modular(plan, events, once=True).unionByName(close_agg(plan, events, final, clock))
    if strategy == "modular":
        return modular(plan, events)
    return fold(plan, events, final, strategy == "global_fold", clock)


# Grouped aggregate.


def _bucket(seconds: float) -> Column:
    length = round(seconds * 1_000_000)
    us = F.unix_micros("ts")
    return F.timestamp_micros(us - us % F.lit(length))


def _accepted(b: Branch, i: int) -> Column:
    """Whether a close step takes a row."""
    return F.col(f"in_{b.source}") & ~F.col(f"ok{i}").eqNullSafe(False)


def _in_order(plan: StagePlan, events: DataFrame) -> DataFrame:
    """``events`` of fixed windows (by ``created``) with running sums in order of events, _r<i> of measures and _rn<i> of needs, and each row's place.

    The last of these is the sum.  Sums of parts, as an aggregate of many tasks makes them, differ in their last digits with the number and order of tasks.
    """
    w = Window.partitionBy(*_keys(plan), "created").orderBy("ts", "seq", "grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {f"_r{i}": F.when(_accepted(b, i), F.col(f"v{i}")) for i, b in enumerate(plan.branches[1:], 1) if b.measure in ("sum", "avg") and not b.distinct}
    own |= {f"_rn{i}": F.col(f"n{i}") for i, need in enumerate(plan.needs) if need.kind in ("sum", "avg")}
    return events.withColumns({**{c: F.sum(v).over(w) for c, v in own.items()}, "_place": F.row_number().over(w)}) if own else events


def _sum(v: Column, running: str | None) -> Column:
    return F.sum(v) if running is None else F.max_by(running, "_place")


def _measure(b: Branch, i: int, accepted: Column, session: bool) -> Column:
    if b.distinct:
        one = F.when(accepted, F.col(f"t{i}"))
        return (F.size(F.collect_set(one)) if session else F.count_distinct(one)).cast("double")
    if b.measure == "count":
        return F.coalesce(F.sum(F.when(accepted, 1.0)), F.lit(0.0))
    v = F.when(accepted, F.col(f"v{i}"))
    if b.measure in ("min", "max"):
        f = F.min if b.measure == "min" else F.max
        return f(F.when(accepted, F.col(f"t{i}"))) if isinstance(constant(b.threshold), str) else F.coalesce(f(v), F.lit(float("inf") if b.measure == "min" else float("-inf")))
    total = _sum(v, None if session else f"_r{i}")
    return F.coalesce(total if b.measure == "sum" else total / F.count(v), F.lit(0.0))


def _holds(b: Branch, measure: Column) -> Column:
    limit = constant(b.threshold)
    if limit is None or isinstance(limit, bool) or (isinstance(limit, str) and b.measure not in ("min", "max")):
        return F.lit(False)
    x = F.lit(limit)
    hit = {"==": measure == x, "!=": measure != x, "<": measure < x, "<=": measure <= x, ">": measure > x, ">=": measure >= x}[b.cmp]
    return F.coalesce(hit, F.lit(False))


def _need(plan: StagePlan, i: int, session: bool) -> Column:
    need, c = plan.needs[i], F.col(f"n{i}")
    if need.kind == "count":
        return F.coalesce(F.sum(F.when(F.col(f"in_{need.alias}"), 1.0)), F.lit(0.0))
    if need.kind == "list":
        rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("ts", "seq", "grp", c.alias("x")))))
        return F.transform(rows, lambda r: r["x"])
    if need.kind in ("sum", "avg"):
        total = _sum(c, None if session else f"_rn{i}")
        return total if need.kind == "sum" else total / F.count(c)
    return {"min": F.min, "max": F.max, "distinct": lambda x: F.size(F.collect_set(x)).cast("double")}[need.kind](c)


def close_agg(plan: StagePlan, events: DataFrame, final: str | None, clock: int | None = None) -> DataFrame:
    m, keys = plan.match, _keys(plan)
    session, length = m.window.kind == "session", m.window.seconds
    first = plan.branches[0]
    least = crossing(first)
    assert least is not None
    enter = F.col(f"in_{first.source}") & F.coalesce(F.col("ok0"), F.lit(False))
    aggs = [_measure(first, 0, enter, session).alias("_e"), F.max("ts").alias("last"), F.min("ts").alias("_first")]
    for i, b in enumerate(plan.branches[1:], 1):
        aggs.append(_measure(b, i, _accepted(b, i), session).alias(f"_c{i}"))
    aggs += [_need(plan, i, session).alias(f"n{i}") for i in range(len(plan.needs))]
    if session:  # Spark joins events that are just the gap apart, which are two sessions here
        window = F.session_window("ts", f"{round(length * 1_000_000) - 1} microseconds")
        grouped = events.groupBy(window.alias("_w"), *keys).agg(*aggs).withColumn("created", F.col("_first")).drop("_w")
        grouped = grouped.withColumn("end", F.col("last") + F.expr(f"INTERVAL {length} SECOND"))
    else:
        grouped = _in_order(plan, events.withColumn("created", _bucket(length))).groupBy("created", *keys).agg(*aggs)
        grouped = grouped.withColumn("end", F.col("created") + F.expr(f"INTERVAL {length} SECOND"))
    met = F.col("_e") >= least
    grouped = (grouped.where(met) if m.close_mode == "and" else grouped).withColumn("_wm", watermark(events, clock))
    timeout = F.col("end") <= F.col("_wm")
    if final is None:
        grouped = grouped.where(timeout)
    origin = F.when(timeout, F.lit("close:timeout")).otherwise(F.lit(f"close:{final}"))
    picked_branch, picked_value, good = [], [], F.lit(True)
    for step in range(len(m.close_steps)):
        which, value = F.lit(None).cast("int"), F.lit(None).cast("double")
        for j in reversed(range(len(m.close_steps[step].branches))):
            i = plan.number(step, j, True)
            b = plan.branches[i]
            late, end = (b.guard is None or truth(b.guard, {"close_reason": r}) is not False for r in ("timeout", final or "eos"))
            hit = _holds(b, F.col(f"_c{i}")) & F.when(timeout, F.lit(late)).otherwise(F.lit(end))
            which, value = F.when(hit, i).otherwise(which), F.when(hit, F.col(f"_c{i}").try_cast("double")).otherwise(value)
        picked_branch.append(which)
        picked_value.append(value)
        good = good & which.isNotNull()
    return grouped.where(good).select(
        *keys, origin.alias("origin"), F.least("end", "_wm").alias("fired"), "last", "created", "end",
        F.when(met, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("s_branch"), F.when(met, F.array(F.lit(float(least)))).otherwise(F.array().cast("array<double>")).alias("s_value"),
        F.array(*picked_branch).cast("array<int>").alias("c_branch"), F.array(*picked_value).cast("array<double>").alias("c_value"),
        *[f"n{i}" for i in range(len(plan.needs))],
    )


# Every n-th accepted event of a fixed window.


def modular(plan: StagePlan, events: DataFrame, once: bool = False) -> DataFrame:
    """``once``: the first match of a window only."""
    b, keys = plan.branches[0], _keys(plan)
    n = crossing(b)
    length = plan.match.window.seconds
    own = events.where(F.col(f"in_{b.source}") & F.col("ok0")).withColumn("created", _bucket(length))
    place = F.row_number().over(Window.partitionBy(*keys, "created").orderBy("ts", "seq", "grp"))
    hits = own.withColumn("_n", place).where(F.col("_n") == n if once else F.col("_n") % n == 0)
    none = F.array().cast("array<int>")
    return hits.select(
        *keys, F.lit("event").alias("origin"), F.col("ts").alias("fired"), F.col("ts").alias("last"), "created", (F.col("created") + F.expr(f"INTERVAL {length} SECOND")).alias("end"),
        F.array(F.lit(0)).alias("s_branch"), F.array(F.lit(float(n or 1))).alias("s_value"), none.alias("c_branch"), none.cast("array<double>").alias("c_value"),
    )


# Ordered fold.


def _stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def emission_row(plan: StagePlan, key: tuple, e: Emission, stamp: Callable[[int], Any] = _stamp) -> tuple:
    """An emission as a row; ``stamp`` makes its times of microseconds."""
    final = []
    for need, v in zip(plan.needs, e.needs):
        if need.kind == "list":
            final.append(v or [])
        elif need.kind == "distinct":
            final.append(float(len(v or ())))
        elif need.kind == "avg":
            final.append(v[0] / v[1] if v else None)
        elif need.kind == "count":
            final.append(v or 0.0)
        else:
            final.append(v)
    return (
        *key, e.origin, stamp(e.fired), stamp(e.last), stamp(e.created), stamp(e.end), [i for i, _ in e.steps], [x for _, x in e.steps], [i for i, _ in e.close],
        [x if abs(x) != float("inf") else None for _, x in e.close], *final,
    )


def offers_of(plan: StagePlan, row: Any, names: dict[str, int]) -> list[Offer]:
    """The event of a row as each accepting alias sees it, in order of declaration."""
    whole = range(len(plan.branches))
    clean = lambda v: None if v is None or v != v else v
    ok = [None if (v := row[names[f"ok{i}"]]) is None or v != v else bool(v) for i in whole]
    numbers, words = [clean(row[names[f"v{i}"]]) for i in whole], [clean(row[names[f"t{i}"]]) for i in whole]
    needs = [clean(row[names[f"n{i}"]]) for i in range(len(plan.needs))]
    return [Offer(a, ok, numbers, words, needs) for a in plan.aliases if row[names[f"in_{a}"]]]


def fold(plan: StagePlan, events: DataFrame, final: str | None, one: bool = False, clock: int | None = None) -> DataFrame:
    """Keys, and with fixed windows each key's windows, are dealt over partitions and read in order; only open windows are held.

    ``one`` reads all keys in one partition, as limits that count all keys' windows together must.
    """
    keys = _keys(plan)
    stamped = events.withColumn("_wm", F.unix_micros(watermark(events, clock))).withColumn("_us", F.unix_micros("ts"))
    fixed = plan.match.window.kind == "fixed"
    length = round(plan.match.window.seconds * 1_000_000)
    stamped = stamped.withColumn("_bucket", F.col("_us") - F.col("_us") % length if fixed else F.lit(0).cast("bigint"))
    apart = [*keys, "_bucket"] if fixed else keys
    if apart and not one:
        stamped = stamped.repartition(*apart).sortWithinPartitions(*apart, "_us", "seq", "grp")
    else:
        stamped = stamped.repartition(1).sortWithinPartitions("_us", "seq", "grp")
    stamped = stamped.drop("ts")
    types = dict(events.dtypes)
    schema = T.StructType.fromDDL(", ".join([*[f"{k} {types[k]}" for k in keys], BASE_COLUMNS, *[f"n{i} {t}" for i, t in enumerate(need_types(plan, events))]]))
    shape = to_arrow_schema(schema)
    names = {c: i for i, c in enumerate(stamped.columns)}
    real = [i for c, i in names.items() if c in keys and types[c] in ("double", "float")]
    walk = _all_keys if one else _by_key

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            cols = [c.to_pylist() for c in b.columns]
            for i in real:  # one object for all that is no number, so that keys of it are equal
                cols[i] = [NAN if v != v else v for v in cols[i]]
            yield from zip(*cols)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, e in walk(plan, rows(parts), names, len(keys), final):
            out.append(emission_row(plan, key, e, int))
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return stamped.mapInArrow(work, schema)


NAN = float("nan")
Emissions = Iterator[tuple[tuple, Emission]]


def _finish(machine: Machine, key: tuple, w: Instance | None, wm: int, final: str | None) -> Emissions:
    """What an open window yields at the end of all events."""
    if w is None:
        return
    late = machine.expired(w, wm)
    if late or final:
        e = machine.close(w, "timeout" if late else str(final), machine.end(w) if late else wm)
        if e:
            yield key, e


def _by_key(plan: StagePlan, rows: Iterator[tuple], names: dict[str, int], n_keys: int, final: str | None) -> Emissions:
    machine = Machine(plan)
    at = [*[names[f"k{i}"] for i in range(n_keys)], names["_bucket"]]
    key: tuple | None = None
    w, wm = None, 0
    for row in rows:
        place = tuple(row[i] for i in at)
        own, ts = place[:-1], row[names["_us"]]
        if place != key:
            if key is not None:
                yield from _finish(machine, key[:-1], w, wm, final)
            key, w = place, None
        wm = row[names["_wm"]]
        if w is not None and machine.expired(w, ts):
            e = machine.close(w, "timeout", machine.end(w))
            if e:
                yield own, e
            w = None
        for offer in offers_of(plan, row, names):
            w = w or machine.open(ts)
            e = machine.offered(w, ts, offer)
            if e:
                yield own, e
    if key is not None:
        yield from _finish(machine, key[:-1], w, wm, final)


def memory(text: str) -> int:
    """Bytes of a size such as 50MB."""
    digits = text.rstrip("KMGBkmgb ")
    return int(float(digits) * {"": 1, "B": 1, "KB": 1 << 10, "K": 1 << 10, "MB": 1 << 20, "M": 1 << 20, "GB": 1 << 30, "G": 1 << 30}[text[len(digits) :].strip().upper()])


class Fleet:
    """The open windows of all keys, for limits that count them together.  Those that end are closed in order before each event.

    Ends and ages are kept in heaps and sizes in a running total, so an event costs the logarithm of the open windows.
    """

    def __init__(self, plan: StagePlan) -> None:
        self.plan, self.machine, self.limits = plan, Machine(plan), plan.limits or Limits()
        self.most_bytes = memory(self.limits.max_memory) if self.limits.max_memory else None
        self.empty = 128 + 80 * len(plan.branches)
        self.open: dict[tuple, Instance] = {}
        self.ends: list[tuple[int, int, str, tuple]] = []
        self.ages: list[tuple[int, str, tuple]] = []
        self.sizes: dict[tuple, int] = {}
        self.total, self.failed = 0, False

    def plain(self) -> dict[str, Any]:
        """What is to be kept, as built-in types."""
        return {"open": {k: w.plain() for k, w in self.open.items()}, "failed": self.failed}

    def restore(self, held: dict[str, Any]) -> None:
        self.failed = held["failed"]
        for key, w in held["open"].items():
            self.open[key] = Instance.of_plain(w)
            self.noted(key, self.open[key])
            self.sized(key)

    def noted(self, key: tuple, w: Instance) -> None:
        heapq.heappush(self.ends, (self.machine.end(w), w.created, str(key), key))
        heapq.heappush(self.ages, (w.created, str(key), key))

    def sized(self, key: tuple) -> None:
        """Brings a window's estimated size up to date."""
        w = self.open[key]
        now = self.empty + sum(t.held for t in (*w.tallies.values(), *w.close.values()))
        self.total += now - self.sizes.get(key, 0)
        self.sizes[key] = now

    def gone(self, key: tuple) -> None:
        del self.open[key]
        self.total -= self.sizes.pop(key, 0)

    def drop_oldest(self) -> None:
        while True:
            created, _, key = heapq.heappop(self.ages)
            if key in self.open and self.open[key].created == created:
                return self.gone(key)

    def due(self, now: int) -> Emissions:
        """Closes what ends by ``now``."""
        while self.ends and self.ends[0][0] <= now:
            _, created, _, key = heapq.heappop(self.ends)
            w = self.open.get(key)
            if w is None or w.created != created or not self.machine.expired(w, now):
                if w is not None and self.machine.kind != "fixed":
                    heapq.heappush(self.ends, (max(self.machine.end(w), now + 1), w.created, str(key), key))
                continue
            e = self.machine.close(w, "timeout", self.machine.end(w))
            self.gone(key)
            if e:
                yield key, e

    def room(self, new: bool) -> bool:
        """Whether an event may be looked at, after what the limits ask for is done."""
        act = self.limits.on_exceed
        if new and self.limits.max_instances is not None and len(self.open) >= self.limits.max_instances:
            if act != "drop_oldest":
                self.failed |= act == "fail_rule"
                return False
            self.drop_oldest()
        if self.most_bytes is not None and self.total + (self.empty if new else 0) >= self.most_bytes:
            if act != "drop_oldest":
                self.failed |= act == "fail_rule"
                return False
            while self.open and self.total + self.empty >= self.most_bytes:
                self.drop_oldest()
        return True

    def offer(self, key: tuple, ts: int, offers: list[Offer]) -> Emissions:
        for offer in offers:
            if self.failed:
                return
            if not self.room(key not in self.open):
                continue
            w = self.open.get(key)
            if w is None:
                w = self.open[key] = self.machine.open(ts)
                self.noted(key, w)
            e = self.machine.offered(w, ts, offer)
            if self.most_bytes is not None:
                self.sized(key)
            if e:
                if self.machine.kind == "sliding":
                    self.noted(key, w)
                yield key, e

    def finish(self, now: int, final: str | None) -> Emissions:
        for key, w in sorted(self.open.items(), key=lambda x: (x[1].created, str(x[0]))):
            yield from _finish(self.machine, key, w, now, final)


def _all_keys(plan: StagePlan, rows: Iterator[tuple], names: dict[str, int], n_keys: int, final: str | None) -> Emissions:
    """The same with limits on all windows together."""
    fleet, wm = Fleet(plan), 0
    for row in rows:
        ts, wm = row[names["_us"]], row[names["_wm"]]
        yield from fleet.due(ts)
        if not fleet.failed:
            yield from fleet.offer(tuple(row[names[f"k{i}"]] for i in range(n_keys)), ts, offers_of(plan, row, names))
    yield from fleet.finish(wm, final)


Throttle = tuple[int, int, bool]
UNTHROTTLED: Throttle = (-(1 << 62), 0, False)


def marked(emissions: DataFrame, limits: Limits, state: Throttle = UNTHROTTLED) -> DataFrame:
    """The ``emissions`` that pass (``_keep``) in order of time, with _start, _count and _failed after each, and some that don't, the last one among them; ``state`` is that before the first.

    At most so many are kept in a span that begins with the first one after the span before.  Only emissions pass through the one
    partition, not events, and of these only the time is looked at.  With fail_rule nothing is kept after the first that is too many.
    """
    most, span = limits.throttle()[0], round(limits.throttle()[1] * 1_000_000)
    stop = limits.on_exceed == "fail_rule"
    keys = [c for c in emissions.columns if c.startswith("k") and c[1:].isdigit()]
    rank = F.when(F.col("origin") == "event", 1).otherwise(0)
    ordered = emissions.withColumn("_us", F.unix_micros("fired")).repartition(1).sortWithinPartitions("_us", rank, "created", *keys)

    added = "_keep boolean, _start bigint, _count bigint, _failed boolean, _at bigint"
    schema = T.StructType([*emissions.schema.fields, *T.StructType.fromDDL(added).fields])
    marks = to_arrow_schema(T.StructType.fromDDL(added))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (start, count, failed), at = state, 0
        for b in parts:
            places, rows = [], []
            for i, us in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if us - start >= span:
                    start, count = us, 0
                full = count >= most
                failed |= stop and full
                count += not full
                keep = not full and not failed
                if keep or i == b.num_rows - 1:  # the last one, for the state after it
                    places.append(i)
                    rows.append((keep, start, count, failed, at))
                at += 1
            if rows:
                own = b.take(pa.array(places, pa.int64()))
                columns = [*own.columns[:-1], *[pa.array(c, f.type) for c, f in zip(zip(*rows), marks)]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ordered.mapInArrow(work, schema)


def kept(rows: DataFrame) -> DataFrame:
    """The rows of ``marked`` that pass."""
    return rows.where("_keep").drop("_keep", "_start", "_count", "_failed", "_at")


def throttled(emissions: DataFrame, limits: Limits) -> DataFrame:
    """The emissions of one rule that its ``max_throttle`` lets pass."""
    if limits.throttle() is None:
        return emissions
    return kept(marked(emissions, limits))
