"""Counters, gauges and histograms of streaming queries, their text for scraping, and a server for it."""

from __future__ import annotations

import http.server
import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper ends, in seconds, of a histogram's buckets.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
#: Parts of a batch that are timed: our name for each of the engine's.
PHASES = {"batch": "triggerExecution", "read": "latestOffset", "plan": "queryPlanning", "process": "addBatch", "commit": "walCommit"}
Labels = tuple[tuple[str, str], ...]


class Metrics(StreamingQueryListener):
    """Gathers what each streaming query reports.

    Counters add up; gauges hold the latest value; histograms count observations up to each of ``BUCKETS``.  All carry labels.
    """

    def __init__(self) -> None:
        self.counters: dict[tuple[str, Labels], float] = {}
        self.gauges: dict[tuple[str, Labels], float] = {}
        self.histograms: dict[tuple[str, Labels], list[float]] = {}
        self.names: dict[str, str] = {}
        self.lock = threading.Lock()

    def add(self, name: str, value: float = 1, **labels: str) -> None:
        with self.lock:
            key = (name, tuple(sorted(labels.items())))
            self.counters[key] = self.counters.get(key, 0.0) + value

    def put(self, name: str, value: float, **labels: str) -> None:
        with self.lock:
            self.gauges[name, tuple(sorted(labels.items()))] = value

    def observe(self, name: str, value: float, **labels: str) -> None:
        with self.lock:
            held = self.histograms.setdefault((name, tuple(sorted(labels.items()))), [0.0] * (len(BUCKETS) + 2))
            for i, end in enumerate(BUCKETS):
                held[i] += value <= end
            held[-2] += 1
            held[-1] += value

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        name = self.names[str(event.id)] = event.name or "query"
        self.add("queries_started_total", query=name)
        self.put("query_active", 1, query=name)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        p = event.progress
        name = p.name or "query"
        self.add("batches_total", query=name)
        self.add("rows_total", p.numInputRows, query=name)
        self.put("rows_per_second", p.processedRowsPerSecond or 0.0, query=name)
        for phase, own in PHASES.items():
            if own in p.durationMs:
                self.observe(f"{phase}_seconds", p.durationMs[own] / 1000, query=name)
        for i, s in enumerate(p.sources):
            self.add("source_rows_total", s.numInputRows, query=name, source=str(i))
        for i, s in enumerate(p.stateOperators):
            self.put("state_rows", s.numRowsTotal, query=name, operator=str(i))
            self.put("state_bytes", s.memoryUsedBytes, query=name, operator=str(i))
            self.add("state_rows_updated_total", s.numRowsUpdated, query=name, operator=str(i))
            self.add("late_rows_total", s.numRowsDroppedByWatermark, query=name, operator=str(i))
        if p.sink.numOutputRows is not None and p.sink.numOutputRows >= 0:
            self.add("alerts_total", p.sink.numOutputRows, query=name)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        self.add("idle_total", query=self.names.get(str(event.id), "query"))

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        name = self.names.get(str(event.id), "query")
        self.add("queries_ended_total", query=name)
        self.put("query_active", 0, query=name)
        if event.exception:
            self.add("queries_failed_total", query=name)

    def watched(self, df: DataFrame, name: str, by: Mapping[str, str]) -> tuple[DataFrame, Observation]:
        """``df`` that counts its rows as it is read, all and those where each condition of ``by`` holds; ``counted`` takes the counts in."""
        seen = Observation(name)
        counts = [F.count(F.when(F.expr(condition), 1)).alias(label) for label, condition in by.items()]
        return df.observe(seen, F.count(F.lit(1)).alias("all"), *counts), seen

    def counted(self, name: str, seen: Observation) -> None:
        for label, n in seen.get.items():
            self.add(f"{name}_total", n, of=label)

    def text(self) -> str:
        """All metrics, a line each; histograms by their buckets, count and sum."""
        shown = lambda labels, *more: "{" + ",".join(f'{k}="{v}"' for k, v in (*labels, *more)) + "}" if (*labels, *more) else ""
        lines = []
        with self.lock:
            for kind, held in (("counter", self.counters), ("gauge", self.gauges)):
                for k, ((name, labels), value) in enumerate(sorted(held.items())):
                    if k == 0 or name != last:  # noqa: F821
                        lines.append(f"# TYPE {name} {kind}")
                    last = name  # noqa: F841
                    lines.append(f"{name}{shown(labels)} {value:g}")
            for (name, labels), held in sorted(self.histograms.items()):
                lines.append(f"# TYPE {name} histogram")
                lines += [f"{name}_bucket{shown(labels, ('le', f'{end:g}'))} {held[i]:g}" for i, end in enumerate(BUCKETS)]
                lines += [f"{name}_bucket{shown(labels, ('le', '+Inf'))} {held[-2]:g}", f"{name}_count{shown(labels)} {held[-2]:g}", f"{name}_sum{shown(labels)} {held[-1]:g}"]
        return "".join(f"{x}\n" for x in lines)

    def serve(self, host: str = "127.0.0.1", port: int = 0) -> http.server.ThreadingHTTPServer:
        """Starts a server of ``text`` at /metrics in a thread of its own; its ``server_port`` tells the port, ``shutdown`` ends it."""
        metrics = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                found = self.path == "/metrics"
                body = metrics.text().encode() if found else b""
                self.send_response(200 if found else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args: object) -> None:
                pass

        server = http.server.ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
