"""Events over TCP: frames of Arrow batches, landed as files that a stream reads.

A frame is its length (32 bits, big-endian), the length of the stream's name (16 bits), the name in UTF-8, and an Arrow IPC
stream.  The receiver runs on one machine of any cluster and writes to a folder that all see, one file for each frame, so that
reading starts again where it was after a failure.
"""

from __future__ import annotations

import itertools
import os
import socket
import struct
import threading
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa


def encode(stream: str, batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write(batch)
    name = stream.encode()
    body = struct.pack(">H", len(name)) + name + sink.getvalue().to_pybytes()
    return struct.pack(">I", len(body)) + body


def decode(body: bytes) -> tuple[str, pa.Table]:
    """The stream's name and rows of a frame without its length."""
    (n,) = struct.unpack(">H", body[:2])
    return body[2 : 2 + n].decode(), pa.ipc.open_stream(body[2 + n :]).read_all()


def frames(read: Iterator[bytes]) -> Iterator[bytes]:
    """Whole frames from pieces of a connection; a last one that is cut off is left out."""
    held = b""
    for piece in read:
        held += piece
        while len(held) >= 4 and len(held) >= (size := struct.unpack(">I", held[:4])[0] + 4):
            yield held[4:size]
            held = held[size:]


class Receiver:
    """Accepts connections and lands each frame as <folder>/<stream>/<id>.arrow; bad frames are counted.  ``names`` gives ids, else they are random."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, names: Iterator[str] | None = None) -> None:
        self.folder = folder
        self.names = names or (uuid.uuid4().hex for _ in itertools.count())
        self.rows = self.frames = self.errors = 0
        self.lock = threading.Lock()
        self.socket = socket.create_server((host, port))
        self.port = self.socket.getsockname()[1]
        self.open = True
        self.workers: list[threading.Thread] = []
        self.acceptor = threading.Thread(target=self._accept, daemon=True)
        self.acceptor.start()

    def _accept(self) -> None:
        while self.open:
            try:
                connection, _ = self.socket.accept()
            except OSError:
                return
            worker = threading.Thread(target=self._serve, args=(connection,), daemon=True)
            self.workers.append(worker)
            worker.start()

    def _serve(self, connection: socket.socket) -> None:
        with connection:
            for body in frames(iter(lambda: connection.recv(1 << 16), b"")):
                try:
                    stream, table = decode(body)
                    self._land(stream, table)
                except (pa.ArrowInvalid, UnicodeDecodeError, struct.error, ValueError):
                    with self.lock:
                        self.errors += 1

    def _land(self, stream: str, table: pa.Table) -> None:
        if not stream or "/" in stream or stream.startswith("."):
            raise ValueError(f"bad stream name {stream!r}")
        folder = os.path.join(self.folder, stream)
        os.makedirs(folder, exist_ok=True)
        with self.lock:
            name = next(self.names)
        part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}.part")
        with pa.OSFile(part, "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
        os.rename(part, os.path.join(folder, f"{name}.arrow"))  # readers see whole files only
        with self.lock:
            self.frames += 1
            self.rows += table.num_rows

    def wait(self, frames: int, seconds: float = 60.0) -> None:
        """Returns when so many frames have come, bad ones too, or raises after some time."""
        end = time.monotonic() + seconds
        while self.frames + self.errors < frames:
            if time.monotonic() > end:
                raise TimeoutError(f"{self.frames + self.errors} of {frames} frames came")
            time.sleep(0.02)

    def close(self) -> None:
        """Takes no more connections and waits for those that are open to end."""
        self.open = False
        self.socket.close()
        for w in self.workers:
            w.join(10)


def send(host: str, port: int, batches: Iterable[tuple[str, pa.RecordBatch | pa.Table]]) -> int:
    """Sends each (stream, batch) as a frame."""
    n = 0
    with socket.create_connection((host, port)) as s:
        for stream, batch in batches:
            s.sendall(encode(stream, batch))
            n += 1
    return n
