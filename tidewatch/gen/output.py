"""Writing generated events: JSON lines, Arrow frames over TCP, or tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.ast import WindowSchema
from ..sources import tcp

#: Rows of a frame, at most.
FRAME = 5000


def lines(events: Mapping[str, DataFrame], schemas: Mapping[str, WindowSchema]) -> DataFrame:
    """A column ``value`` of JSON lines of all windows' events, with _stream, _window and _timestamp (nanoseconds), by arrival."""
    out: DataFrame | None = None
    for name, df in events.items():
        w = schemas[name]
        fields = [(F.unix_micros(f"`{f}`") * 1000 if kind == "time" else F.col(f"`{f}`")).alias(f) for f, kind in w.fields]
        at = F.unix_micros(f"`{w.time}`") * 1000 if w.time else F.lit(None).cast("bigint")
        one = df.select("arrival", F.to_json(F.struct(F.lit(w.streams[0]).alias("_stream"), F.lit(name).alias("_window"), at.alias("_timestamp"), *fields)).alias("value"))
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out


def write_lines(events: Mapping[str, DataFrame], schemas: Mapping[str, WindowSchema], path: str) -> None:
    lines(events, schemas).orderBy("arrival").select("value").write.mode("overwrite").text(path)


def send(events: Mapping[str, DataFrame], schemas: Mapping[str, WindowSchema], host: str, port: int) -> int:
    """Sends each window's events to a receiver that all executors can reach, from the tasks that make them; the number of frames comes back.

    Nothing passes through the driver.  A task that is done again sends its frames again.
    """

    def sent(stream: str, batches: Iterator[pa.RecordBatch]) -> int:
        return tcp.send(host, port, ((stream, b) for b in batches))

    return _by_task(events, schemas, sent)


def land(events: Mapping[str, DataFrame], schemas: Mapping[str, WindowSchema], folder: str) -> int:
    """Sends each window's events to receivers that land them in a folder which all executors see; the number of frames comes back.

    Each task has a receiver on its own machine, so neither the driver nor any one machine gets all events.  Files are named by
    task and place, so a task that is done again replaces what it landed.
    """

    def landed(stream: str, batches: Iterator[pa.RecordBatch]) -> int:
        part = TaskContext.get().partitionId()
        receiver = tcp.Receiver(folder, names=(f"{part:05d}-{k:06d}" for k in itertools.count()))
        try:
            n = tcp.send("127.0.0.1", receiver.port, ((stream, b) for b in batches))
            receiver.wait(n)
        finally:
            receiver.close()
        if receiver.errors:
            raise ValueError(f"{receiver.errors} of {n} frames could not be landed")
        return n

    return _by_task(events, schemas, landed)


def _by_task(events: Mapping[str, DataFrame], schemas: Mapping[str, WindowSchema], do: Callable[[str, Iterator[pa.RecordBatch]], int]) -> int:
    """The sum of what ``do`` gives for a stream's name and the batches, of ``FRAME`` rows at most, of each task that has any."""
    n = 0
    for name, df in events.items():
        own, stream = df.select(*[f"`{f}`" for f, _ in schemas[name].fields]), schemas[name].streams[0]
        if own.limit(FRAME + 1).count() <= FRAME:
            own = own.coalesce(1)

        def work(parts: Iterator[pa.RecordBatch], stream: str = stream) -> Iterator[pa.RecordBatch]:
            cut = (b.slice(i, FRAME) for b in parts for i in range(0, b.num_rows, FRAME))
            first = next(cut, None)
            if first is not None:
                yield pa.RecordBatch.from_pydict({"n": pa.array([do(stream, itertools.chain([first], cut))], pa.int64())})

        n += own.mapInArrow(work, "n bigint").agg(F.sum("n")).first()[0] or 0
    return n
