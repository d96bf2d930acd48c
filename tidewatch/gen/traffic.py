"""Traffic: events spaced over a scenario's time, with fields made from the row's number and a seed.

Everything is a column expression of the row number, so a scenario of any size is made by as many tasks as wanted, and
again the same way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import WindowSchema


@dataclass(frozen=True)
class Rate:
    """Events a second: const, wave, burst, or timeline (segments of start, end, rate)."""

    kind: str
    base: float = 0.0
    amp: float = 0.0
    period: float = 1.0
    shape: str = "sine"
    peak: float = 0.0
    hold: float = 0.0
    segments: tuple[tuple[float, float, float], ...] = ()

    def at(self, t: float) -> float:
        if self.kind == "wave":
            x = (t % self.period) / self.period
            swing = {"sine": math.sin(2 * math.pi * x), "square": 1.0 if x < 0.5 else -1.0, "triangle": 1 - 4 * abs(((x + 0.75) % 1.0) - 0.5)}[self.shape]
            return max(0.0, self.base + self.amp * swing)
        if self.kind == "burst":
            return self.peak if t % self.period < self.hold else self.base
        if self.kind == "timeline":
            return next((r for a, b, r in self.segments if a <= t < b), 0.0)
        return self.base

    def counts(self, duration: float) -> list[int]:
        """Events in each second; the fraction left over is carried on."""
        out, carried = [], 0.0
        for s in range(math.ceil(duration)):
            carried += self.at(s + 0.5) * min(1.0, duration - s)
            out.append(int(carried + 1e-9))
            carried -= out[-1]
        return out

    def total(self, duration: float) -> int:
        return sum(self.counts(duration))


def spaced(spark: SparkSession, n: int, duration: float, start: float) -> DataFrame:
    """``n`` rows, seq and ts, evenly spaced over ``duration`` seconds from ``start`` (seconds since 1970)."""
    step = round(duration * 1_000_000 / max(n, 1))
    return spark.range(n).select(F.col("id").alias("seq"), F.timestamp_micros(F.lit(round(start * 1_000_000)) + F.col("id") * step).alias("ts"))


def shaped(spark: SparkSession, rate: Rate, duration: float, start: float) -> DataFrame:
    """Rows seq and ts that follow the rate: in each second its count, evenly spaced."""
    if rate.kind == "const":
        return spaced(spark, rate.total(duration), duration, start)
    counts, before = rate.counts(duration), 0
    seconds = []
    for s, n in enumerate(counts):
        if n:
            seconds.append((s, n, before))
        before += n
    df = spark.createDataFrame(seconds or [(0, 0, 0)], "s bigint, n bigint, before bigint").where("n > 0")
    df = df.select("s", "n", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    us = F.lit(round(start * 1_000_000)) + F.col("s") * 1_000_000 + F.floor(F.col("i") * 1_000_000 / F.col("n"))
    return df.select((F.col("before") + F.col("i")).alias("seq"), F.timestamp_micros(us.cast("bigint")).alias("ts"))


def mixed(seq: Column, seed: int, salt: int = 0) -> Column:
    """A number from 0 up that looks random, the same for the same row, seed and salt."""
    return F.xxhash64(seq, F.lit(seed), F.lit(salt)).bitwiseAND(F.lit((1 << 62) - 1))


def pooled(seq: Column, prefix: str, size: int, factor: int, seed: int) -> Column:
    """One of ``size`` names."""
    return F.concat(F.lit(prefix), ((seq * factor + seed) % size).cast("string"))


def ranged(seq: Column, steps: int, divisor: float, factor: int, seed: int) -> Column:
    return ((seq * factor + seed) % steps) / F.lit(divisor)


def ipv4(x: Column, pool: int = 256) -> Column:
    """An address of a pool of private ones."""
    k = x % pool
    return F.concat_ws(".", F.lit("10"), (F.floor(k / 65536) % 256).cast("string"), (F.floor(k / 256) % 256).cast("string"), (k % 256).cast("string"))


def pattern(x: Column, form: str) -> Column:
    """A text in which {} is a number."""
    parts = form.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [x.cast("string"), F.lit(p)]
    return F.concat(*out)


def choice(x: Column, values: list[object]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (x % len(values)).cast("int") + 1)


def of_type(kind: str, x: Column, ts: Column) -> Column:
    """A value of a declared type from a random number."""
    if kind.startswith("array/"):
        return F.array(of_type(kind[6:], x, ts))
    return {
        "ip": lambda: ipv4(x), "chars": lambda: pattern(x % 1000, "v{}"), "hex": lambda: F.lower(F.lpad(F.hex(x), 16, "0")), "digit": lambda: x % 100_000,
        "float": lambda: (x % 1_000_000) / F.lit(1000.0), "bool": lambda: x % 2 == 0, "time": lambda: ts,
    }[kind]()


def filled(df: DataFrame, schema: WindowSchema, seed: int, given: dict[str, Column] | None = None) -> DataFrame:
    """The rows (seq, ts) with every field of the window; ``given`` ones as they are given."""
    out = []
    for k, (name, kind) in enumerate(schema.fields):
        made = F.col("ts") if name == schema.time else (given or {}).get(name, of_type(kind, mixed(F.col("seq"), seed, k), F.col("ts")))
        out.append(made.alias(name))
    return df.select("seq", F.col("ts").alias("_ts"), *out)
