"""Comparing alerts: what should have been found with what was."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["rule_name", "entity_type", "entity_id", "origin"]


def read(alerts: DataFrame) -> DataFrame:
    """Alerts with their time, ``at``: when they fired, else the time of their last event."""
    known = [F.try_to_timestamp(F.col(c).cast("string")) for c in ("fired_at", "event_time") if c in alerts.columns]
    return alerts.withColumn("at", F.coalesce(*known))


def compare(expected: DataFrame, actual: DataFrame, seconds: float = 1.0, score: float = 0.01) -> DataFrame:
    """A row for each alert of either side (``KEY``, at, score): matched, missing, unexpected or field_mismatch.

    Alerts of one key are paired in order of time: those of both sides that are within ``seconds`` of each other form a run,
    and the n-th of one side in a run goes with the n-th of the other.
    """
    cols = [*KEY, F.col("at").cast("timestamp").alias("at"), F.col("score").cast("double").alias("score")]
    both = expected.select(*cols, F.lit(0).alias("side")).unionByName(actual.select(*cols, F.lit(1).alias("side")))
    w = Window.partitionBy(*KEY).orderBy("at", "side", "score")
    gap = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(w) > round(seconds * 1_000_000)
    runs = both.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    n = F.row_number().over(Window.partitionBy(*KEY, "_run", "side").orderBy("at", "score"))
    runs = runs.withColumn("_n", n)
    pairs = runs.groupBy(*KEY, "_run", "_n").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("at", "score")])
    near = F.abs(F.unix_micros("at0") - F.unix_micros("at1")) <= round(seconds * 1_000_000)
    found = F.array(F.when(F.col("at1").isNull(), "missing").when(F.col("at0").isNull(), "unexpected").when(~near, "missing").when(F.abs(F.col("score0") - F.col("score1")) > score, "field_mismatch").otherwise("matched"))
    apart = F.col("at0").isNotNull() & F.col("at1").isNotNull() & ~near
    found = F.when(apart, F.array(F.lit("missing"), F.lit("unexpected"))).otherwise(found)
    return pairs.select(*KEY, F.col("at0").alias("expected_at"), F.col("at1").alias("actual_at"), F.col("score0").alias("expected_score"), F.col("score1").alias("actual_score"), F.explode(found).alias("status"))


def report(result: DataFrame) -> dict[str, int | str]:
    """Counts of a comparison, and whether all is well."""
    got = {r["status"]: r["n"] for r in result.groupBy("status").agg(F.count("*").alias("n")).collect()}
    counts = {s: got.get(s, 0) for s in ("matched", "missing", "unexpected", "field_mismatch")}
    bad = counts["missing"] + counts["unexpected"] + counts["field_mismatch"]
    return {"status": "fail" if bad else "pass", "oracle_total": counts["matched"] + counts["missing"] + counts["field_mismatch"], "actual_total": counts["matched"] + counts["unexpected"] + counts["field_mismatch"], **counts}


def markdown(result: DataFrame, got: dict[str, int | str], most: int = 20) -> str:
    """A comparison as a table of counts, and the first of the alerts that differ."""
    lines = [f"# Verification: {got['status']}", "", "| What | Count |", "|-|-|", *[f"| {k} | {v} |" for k, v in got.items() if k != "status"]]
    other = result.where("status <> 'matched'").orderBy("status", *KEY, F.coalesce("expected_at", "actual_at")).limit(most).collect()
    if other:
        lines += ["", "| Status | Rule | Entity | Origin | Expected | Actual |", "|-|-|-|-|-|-|"]
        shown = lambda at, score: "-" if at is None else f"{at:%Y-%m-%dT%H:%M:%S} ({score:g})"
        lines += [f"| {r.status} | {r.rule_name} | {r.entity_type} {r.entity_id} | {r.origin} | {shown(r.expected_at, r.expected_score)} | {shown(r.actual_at, r.actual_score)} |" for r in other]
    return "\n".join(lines)


def quality(alerts: DataFrame, cases: DataFrame) -> dict[str, float | None]:
    """Shares of the injected entities (entity_id, label: hit, near_miss or miss) that have an alert, precision and recall, and, with the cases' times ``at``, seconds from the last injected event to the alert."""
    found = alerts.select("entity_id").distinct().withColumn("_found", F.lit(1))
    joined = cases.select("entity_id", "label").distinct().join(found, "entity_id", "left")
    rows = {r["label"]: (r["n"], r["k"]) for r in joined.groupBy("label").agg(F.count("*").alias("n"), F.count("_found").alias("k")).collect()}
    share = lambda label: rows[label][1] / rows[label][0] if label in rows and rows[label][0] else None
    true, false = rows.get("hit", (0, 0))[1], sum(k for label, (_, k) in rows.items() if label != "hit")
    late = None
    if "at" in cases.columns:
        ends = cases.where("label = 'hit'").groupBy("entity_id").agg(F.max(F.unix_micros("at")).alias("_end"))
        first = alerts.groupBy("entity_id").agg(F.min(F.unix_micros(F.try_to_timestamp("fired_at"))).alias("_fired"))
        late = ends.join(first, "entity_id").agg(F.percentile_approx(F.greatest(F.col("_fired") - F.col("_end"), F.lit(0)) / 1e6, 0.95)).first()[0]
    negatives = sum(n for label, (n, _) in rows.items() if label != "hit")
    return {
        "hit": share("hit"), "near_miss": share("near_miss"), "miss": share("miss"), "recall": share("hit"),
        "precision": true / (true + false) if true + false else None, "fpr": false / negatives if negatives else None, "latency_p95": late,
    }
