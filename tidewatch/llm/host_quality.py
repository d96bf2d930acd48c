"""Quality rules for documents and for their hosts.

Each whole text is measured once (words, symbols, lines and three-word windows that repeat).  A document
fails at once if it has under 50 words or if over half of its words are in repeated windows.  Softer rules (``RULES``)
are no more than evidence, and the host tells what it is worth:

* failures of each rule, and documents that fail any rule, are counted by host in grouped sums; a beta prior for each is
  fitted to all hosts by the method of moments, and each host's rate is shrunk to it;
* the verdicts on the host are joined back: its odds (of a document that fails some rule), and for each rule how many times
  as often as all hosts it fails it;
* a document that fails softer rules has the host's odds, times for each failed rule ``EVIDENCE`` and the host's
  multiple.  It goes if these odds pass ``ODDS``.

So the same failure is let pass on a host of good record and not on one where it is common, and a document that fails no rule is
kept wherever it is from.

Edge cases: a null text counts as empty, has no words and fails; a null source is a host; a text is measured whole, however long;
odds of just ``ODDS`` are let pass; repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_group, own_columns

LEAST_WORDS = 50
ODDS = 1.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: name: whether a document that has words fails.
RULES: dict[str, Column | str] = {
    "symbols": "n_symbols * 10 > n_words",
    "lines": "n_dup_lines * 10 > n_lines * 3",
    "repeats": "n_repeat_words * 10 > n_words * 3",
    "lengths": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
}
#: By how much a failed rule raises the odds; lines and repeats mostly fail together.
EVIDENCE = {"symbols": 10.0, "lines": 2.0, "repeats": 2.0, "lengths": 4.0}
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    pairs = a[:-1] * k + a[1:]
    if k > 2_000_000:  # else the numbers of windows could pass 63 bits
        pairs, k = np.unique(pairs, return_inverse=True)[1], len(number)
    windows = pairs[:-1] * k + a[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= hit
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """``MEASURES`` of one text."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, 0
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``MEASURES`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t.as_py()) for t in b.column(2)]
            cols = [pa.array(c, pa.int64()) for c in zip(*got)] if got else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "source", *MEASURES])

    own = own_columns(docs, ("doc_id", "source", "text")).withColumn("text", F.col("text").cast("binary"))
    return own.mapInArrow(run, "doc_id bigint, source string, " + ", ".join(f"{m} bigint" for m in MEASURES))


def shrunk(hosts: DataFrame, names: list[str]) -> tuple[dict[str, Column], dict[str, float]]:
    """Each host's rate of failing (column _f_<name> of _n), shrunk to a beta prior, and the rate of all."""
    sums = [F.sum(f"_f_{x}").alias(f"f_{x}") for x in names] + [F.sum(F.col(f"_f_{x}") * F.col(f"_f_{x}") / F.col("_n")).alias(f"q_{x}") for x in names]
    got = hosts.agg(F.sum("_n").alias("n"), F.count("*").alias("h"), *sums).first()
    n, rates, means = max(got["n"] or 0, 1), {}, {}
    for x in names:
        f = got[f"f_{x}"] or 0
        m = min(max(f / n, 1e-6), 1 - 1e-6)
        between = max(((got[f"q_{x}"] or 0.0) - f * f / n) / n - m * (1 - m) * got["h"] / n, m * (1 - m) * 1e-4)
        strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4)
        rates[x], means[x] = (F.col(f"_f_{x}") + F.lit(m * strength)) / (F.col("_n") + F.lit(strength)), m
    return rates, means


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept, n_failed (softer rules), host_rate (of failing any rule, shrunk) and odds (null if no softer rule fails) for each row."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measures(docs).withColumn("base_failed", base)
    rows = rows.select("*", *[(F.expr(rule) if isinstance(rule, str) else rule).cast("int").alias(f"_{name}") for name, rule in RULES.items()])
    rows = cut(rows.withColumn("_any", F.greatest(F.col("base_failed").cast("int"), *[F.col(f"_{name}") for name in RULES])))
    hosts = cut(rows.groupBy("source").agg(F.count("*").alias("_n"), *[F.sum(f"_{name}").alias(f"_f_{name}") for name in ("any", *RULES)]))
    rates, means = shrunk(hosts, ["any", *RULES])
    odds = rates["any"] / (1 - rates["any"])
    verdict = hosts.select("source", rates["any"].alias("host_rate"), odds.alias("_odds"), *[(rates[x] / F.lit(means[x])).alias(f"_m_{x}") for x in RULES])
    out = join_by_group(rows, verdict, "source", "doc_id")
    failed = sum((F.col(f"_{name}") for name in RULES), F.lit(0))
    odds = F.col("_odds")
    for name in RULES:
        odds = odds * F.when(F.col(f"_{name}") == 1, EVIDENCE[name] * F.col(f"_m_{name}")).otherwise(1.0)
    out = out.withColumn("n_failed", failed).withColumn("odds", F.when(F.col("n_failed") > 0, F.round(odds, 6)))
    kept = ~F.col("base_failed") & (F.coalesce("odds", F.lit(0.0)) <= ODDS)
    return out.select("doc_id", *MEASURES[:5], "base_failed", kept.alias("kept"), "n_failed", F.round("host_rate", 6).alias("host_rate"), "odds")
