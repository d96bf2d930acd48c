"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens.  There is a state for each token (where it was just read) and a
start state; it accepts just the token sequences that the merges make.  It is
built by applying one gadget for each merge (a, b) -> c, in order of the merges:

* the state of ``a`` loses its arc ``b``, as a, b would have been merged;
* the state of ``c`` is forked from that of ``b`` as it is now, and goes its own way from here on;
* each state that still has an arc ``a`` now gets an arc ``c``.

Arcs are kept as these changes, each with the number of its gadget (the forks, the lost arcs and where
an arc came from), not as copied lists, so the tables stay linear in the merges; whether
state q has arc y is found by following the two chains back, and kept.

A pre-split word is read from left to right, longest arc first; the tables tell whether the state has the
arc.  Decoding emits the labels of the arcs, joined as the vocabulary's library does where the file has no
decoder.

The vocabulary is read on the driver from a path that is a parameter, and its merges (of a fixed size)
are sent to the executors; a file whose settings are not those built in is refused.  Texts are handled whole, in Arrow batches; words seen before are looked up in a
table of bounded size.

Edge cases: a null text counts as empty, which has no tokens; repeated rows each get a row; a null doc_id stays
null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import own_columns

#: Words remembered by a Python worker, twice, and pairs of tokens; some 70 MB together.
REMEMBERED, PAIRS = 120_000, 400_000
SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPLIT_SPACE = regex.compile(f"[{SPACE}]+")
#: Characters at which str.split splits though the vocabulary's expressions do not count them as space.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
IDS = "<u4"
#: Rows whose tokens are held at once.
ROWS = 256


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Automaton:
    """The automaton of one vocabulary; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        self.ids = {s: i for s, i in vocab.items() if len(s.removesuffix(suffix)) == 1}  # those that can be read; gadgets add to them
        self.longest = max((len(s.removesuffix(suffix)) for s in vocab), default=1)
        self.born: dict[int, int] = {}  # number of the gadget that made the state
        self.parent: dict[int, int] = {}  # the state it was forked from
        self.came: dict[int, int] = {}  # the arc whose states get this arc
        self.lost: dict[tuple[int, int], int] = {}  # (state, arc): number of the gadget that took it
        self.known: dict[int, bool] = {}  # by state << 20 | arc
        for number, (a, b) in enumerate(merges):
            if a in self.ids and b in self.ids and self.follow(self.ids[a], self.ids[b], number):
                if a + b in self.ids:
                    raise ValueError(f"two merges make {a + b!r}")
                self.gadget(number, vocab[a], vocab[b], vocab[a + b])
                self.ids[a + b] = vocab[a + b]

    def gadget(self, number: int, a: int, b: int, c: int) -> None:
        self.lost[a, b] = number
        self.born[c], self.parent[c], self.came[c] = number, b, a

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether ``arc`` leaves ``state`` after the last gadget."""
        key = state << 20 | arc
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[key] = self.follow(state, arc)
        return found

    def follow(self, state: int, arc: int, when: int = 1 << 60) -> bool:
        """Whether ``state`` has ``arc`` just before gadget ``when``."""
        lost, born = self.lost, self.born
        while True:
            if lost.get((state, arc), when) < when:
                return False
            s, y = born.get(state, -1), born.get(arc, -1)
            if s < 0 and y < 0:
                return True
            if s > y:  # the state was forked when the arc was there already: look at its parent then
                when, state = s, self.parent[state]
            else:  # the arc is newer: it is there if the one it came from was, that gadget's own loss included
                when, arc = y + 1, self.came[arc]

    def encode(self, letters: str) -> list[int]:
        """The path of one pre-split word, given in byte letters.

        The longest arc is tried first.  As a prefix has one accepted path, a position is entered once at most:
        one that led nowhere is dead for good, so the work is linear in the word.
        """
        n, ids, known = len(letters), self.ids, self.known
        path: list[int] = []
        at: list[int] = []
        dead: set[int] = set()
        i, j = 0, min(n, self.longest)
        while i < n:
            while j > i:
                t = ids.get(letters[i:j]) if j < n else ids.get(letters[i:] + self.suffix)
                if t is not None and j not in dead:
                    if not path:
                        break
                    ok = known.get(path[-1] << 20 | t)
                    if ok if ok is not None else self.has_arc(path[-1], t):
                        break
                j -= 1
            if j > i:
                path.append(t)
                at.append(i)
                i, j = j, min(n, j + self.longest)
            else:
                dead.add(i)
                path.pop()
                i, j = at.pop(), i - 1
        return path


#: The settings of vocabulary files that are built in here; files of other settings are refused.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def refuse_others(spec: dict) -> None:
    """Raises if a vocabulary file asks for anything that this module does not do."""
    model = spec["model"]
    other = [k for k, want in (("normalizer", NORMALISER), ("pre_tokenizer", SPLITTING), ("decoder", None)) if spec.get(k) != want]
    other += [k for k, want in (("type", "BPE"), *PLAIN.items()) if model.get(k, want) != want]
    other += ["added_tokens" for t in spec["added_tokens"] if t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if other:
        raise ValueError(f"the vocabulary file has settings that are not built in: {', '.join(dict.fromkeys(other))}")


class Tokenizer:
    """Encodes and decodes as files of the settings above say: special strings, normaliser, pre-splitting, automaton, labels."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        refuse_others(spec)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.pieces = regex.compile(PIECES.replace(r"\s", SPACE))
        labels = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels, default=-1) + 1)]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids, in bytes, of a run of characters without white space, in lower case and composed."""
        got = self.old.get(word)
        if got is None:
            if word.isalpha():
                got = self.path(word)
            elif word[-1] in ",." and word[:-1].isalpha():
                got = (self.new.get(word[:-1]) or self.word(word[:-1])) + self.path(word[-1])
            else:
                got = b"".join([self.path(p) for p in self.pieces.findall(word)])
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        if len(word) < 64:
            self.new[word] = got
        return got

    def path(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isalnum() else "".join([self.letters[b] for b in piece.encode()])
        path = self.automaton.encode(letters)
        return struct.pack(f"<{len(path)}I", *path)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        parts = self.split_special.split(text) if any([s in text for s in self.special]) else [text]
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], IDS).tobytes())
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # each character by itself: no final sigma
            words = [w for w in SPLIT_SPACE.split(part) if w] if NOT_SPACE.search(part) else part.split()
            new, word = self.new, self.word
            for w in words:
                got = new.get(w)
                if got is None:
                    got = word(w)
                    new = self.new
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, between blanks."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, IDS).tolist()])


Row = Callable[[Tokenizer, str], tuple]


def _digest(tok: Tokenizer, text: str) -> tuple[int, str, str]:
    ids = tok.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest()


def _whole(tok: Tokenizer, text: str) -> tuple[np.ndarray, str]:
    ids = tok.encode(text)
    return np.frombuffer(ids, IDS).astype(np.int32), tok.decode(ids)


def _tokens(docs: DataFrame, path: str, kept: Sequence[str], made: dict[str, pa.DataType], row: Row) -> DataFrame:
    """The ``kept`` columns of ``docs`` and those that ``row`` makes of each text."""
    with open(path, "rb") as f:  # on the driver only
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                got = [row(tok, t.as_py() or "") for t in part.column(0)]
                cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(made.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols], [*kept, *made])

    own = own_columns(docs, ("text", *kept))
    schema = T.StructType([*own.drop("text").schema.fields, *from_arrow_schema(pa.schema(list(made.items()))).fields])
    return own.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, other columns of the documents, ids (array of int) and decoded (the text their labels give) for each row."""
    return _tokens(docs, path, ["doc_id", *also], {"ids": pa.list_(pa.int32()), "decoded": pa.string()}, _whole)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row, made where the tokens are."""
    return _tokens(docs, path, ["doc_id"], {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, _digest)
