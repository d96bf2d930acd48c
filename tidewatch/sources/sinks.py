"""Sinks: alerts as JSON lines or tables, routed by the names of their targets."""

from __future__ import annotations

import fnmatch
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A pattern of * and ? as a regular expression for whole names."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in pattern) + "$"


def matches(pattern: str, name: str) -> bool:
    return fnmatch.fnmatchcase(name, pattern.replace("[", "[[]"))


@dataclass
class Sink:
    """Where a group's alerts are written, by as many tasks as they were made by, or dealt out to ``parallel`` ones."""

    name: str
    path: str = ""
    format: str = "json"
    tags: dict[str, str] = field(default_factory=dict)
    required: bool = False
    parallel: int | None = None

    def rows(self, df: DataFrame) -> DataFrame:
        """What is written.  The rows are dealt out by an exchange, so that what makes them keeps all its tasks."""
        if self.tags:
            df = df.withColumn("tags", F.array(*[F.lit(f"{k}:{v}") for k, v in sorted(self.tags.items())]))
        return df if self.parallel is None else df.repartition(self.parallel)

    def write(self, df: DataFrame, batch: int | None = None) -> None:
        """Adds to what is there; a numbered ``batch`` has a folder of its own, and takes the place of itself if it is written again."""
        path, mode = (self.path, "append") if batch is None else (f"{self.path}/batch={batch}", "overwrite")
        self.rows(df).write.mode(mode).format(self.format).save(path)


@dataclass
class Routes:
    """Target names to sink groups: every group one of whose patterns fits; the default one for what fits none."""

    groups: list[tuple[str, list[str]]]
    default: str | None = None
    error: str | None = None

    def fits(self, patterns: Iterable[str], column: str = "yield_target") -> Column:
        got = F.lit(False)
        for p in patterns:
            got = got | F.col(column).rlike(glob_regex(p))
        return F.coalesce(got, F.lit(False))

    def tagged(self, df: DataFrame, column: str = "yield_target") -> DataFrame:
        """``df`` with the ``sink`` group of each row, a row for each group that it goes to."""
        names = [F.when(self.fits(patterns, column), F.lit(name)) for name, patterns in self.groups]
        found = F.filter(F.array(*names) if names else F.array().cast("array<string>"), lambda x: x.isNotNull())
        return df.withColumn("sink", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(self.default))))).where(F.col("sink").isNotNull())

    def write(self, df: DataFrame, sinks: Mapping[str, Sink], batch: int | None = None) -> list[str]:
        """Writes each group's alerts, which are made once for all groups; what sinks refuse goes to the error group, once.  The names of sinks that failed come back.

        A sink's files appear when all its tasks are done, so one that fails leaves nothing behind.
        """
        tagged = self.tagged(df).persist(StorageLevel.MEMORY_AND_DISK)
        failed = []
        try:
            for name in dict.fromkeys([*[n for n, _ in self.groups], *([self.default] if self.default else [])]):
                try:
                    sinks[name].write(tagged.where(F.col("sink") == name).drop("sink"), batch)
                except Exception:
                    failed.append(name)
                    if self.error is None or self.error not in sinks:
                        raise
            if failed:
                sinks[self.error].write(tagged.where(F.col("sink").isin(failed)).drop("sink"), batch)
        finally:
            tagged.unpersist()
        return failed


def load_config(text: str) -> tuple[Routes, dict[str, Sink]]:
    """Routes and sinks of a TOML text: [defaults], [[connector]], [[route]] (name, windows, sink), default and error.

    Tags of defaults, connector and route are merged, the later ones winning; a route may only override what its connector allows.
    """
    spec = tomllib.loads(text)
    defaults = spec.get("defaults", {})
    connectors = {c["id"]: c for c in spec.get("connector", [])}
    groups, sinks = [], {}
    tags = lambda d: dict(t.split(":", 1) for t in d.get("tags", []))

    def sink(name: str, entry: Mapping) -> Sink:
        base = connectors[entry["connect"]]
        params = dict(base.get("params", {}))
        for k, v in entry.get("params", {}).items():
            if k not in base.get("allow_override", []):
                raise ValueError(f"sink {name}: {k} can't be overridden")
            params[k] = v
        merged = tags(defaults) | tags(base) | tags(entry)
        parallel = min(max(int(entry["parallel"]), 1), 10) if "parallel" in entry else None
        return Sink(name, params.get("path", ""), params.get("format", "json"), merged, bool(entry.get("required", False)), parallel)

    for r in spec.get("route", []):
        groups.append((r["name"], list(r["windows"])))
        sinks[r["name"]] = sink(r["name"], r)
    for name in ("default", "error"):
        if name in spec:
            sinks[name] = sink(name, spec[name])
    return Routes(groups, "default" if "default" in sinks else None, "error" if "error" in sinks else None), sinks


def uncovered(routes: Routes, targets: Iterable[str]) -> list[str]:
    """Targets that no route takes, where there is no default."""
    return [] if routes.default else [t for t in targets if not any(matches(p, t) for _, ps in routes.groups for p in ps)]


def write_stream(alerts: DataFrame, routes: Routes, sinks: Mapping[str, Sink], checkpoint: str):  # noqa: ANN201
    """Starts writing a stream of alerts, a batch at a time, as far as its source has come; a batch that is done again replaces itself."""
    return alerts.writeStream.foreachBatch(lambda df, batch: routes.write(df, sinks, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
