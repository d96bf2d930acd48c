"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, three-word shingles with repeats,
XXH64 with seed 42; a bit is set if more than half of the shingles have it.

Links: fingerprints at ``RADIUS`` = 2 or fewer differing bits.  Each bit position has a non-zero vector
of three bits; for each of the seven non-zero vectors v, a table keeps the bits whose vector has an odd
product with v.  Two positions span at most a plane, so some v is orthogonal to both and
that table's masked fingerprints are equal: every pair within the radius collides in a table.

Inside a bucket no pairs are made.  A member sends itself and its one-bit
neighbours outside the mask; two members are within two bits exactly if they share one of
these, and at most 65 fingerprints can share one.  So a bucket of m members makes 1 + (64 - mask bits)
rows for each of them, not m squared, and each shared neighbour links its members to the least of them.

Components are found by alternating large-star and small-star steps with a checkpoint after each.

``keep_one`` thins out near copies by the same links and by further ones, as an edited word in fifty moves a fingerprint of three-word shingles by more than the
radius.  A fingerprint of single words moves far less; it is too coarse to link by itself, but does to propose: texts within ``WORD_RADIUS`` bits of it,
covered by masks of the same construction, and in each table one of ``MINIMA`` least hashes of the five-word shingles in common.  In each such group
all are proposed to one, and linked if ``SKETCH`` least hashes of five-word shingles put their similarity at ``SIMILAR`` or more.

Edge cases: a null or empty text, or one without words, has the fingerprint zero, which links like any
other; repeated rows each get a row; a null doc_id is kept and never the smallest of its
component unless all are null; texts are read whole, however long; extra columns are ignored; an empty table gives no rows.

Groups of any size: what meets at a fingerprint, a neighbour or a root is summed or made least before it is sent; the joins back to documents
are sort-merge joins, whose hot partitions (the fingerprint of all empty texts, say) adaptive execution splits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own_columns, row_key, rows_again, same, with_row

RADIUS = 2
SEED = 42


def covering(radius: int) -> list[int]:
    """For each table the bits it keeps, so that any ``radius`` bits are all left out by one table or more.

    Bit positions have non-zero vectors of radius + 1 bits; a table is a non-zero vector too, and keeps the positions whose product with it is odd.
    """
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


MASKS = covering(RADIUS)
#: For near copies: the radius of single words' fingerprints, words in a shingle, the least similarity, and the hashes by which texts meet and are compared.
WORD_RADIUS, WORDS, SIMILAR, MINIMA, SKETCH = 3, 5, 0.8, 3, 128
WORD_MASKS = covering(WORD_RADIUS)
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9][:MINIMA], np.uint64)
REMEMBERED = 100_000
BLOCK = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _majority(hashes: Iterator[int], n: int) -> int:
    """The bits that more than half of ``n`` hashes have, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        k = min(BLOCK, n - start)
        block = np.fromiter(itertools.islice(hashes, k), np.uint64, k)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _shingles(words: list[bytes], n: int) -> tuple[Iterator[bytes], int]:
    """The shingles of ``n`` words, and how many; of fewer words the whole sequence."""
    if len(words) < n:
        return iter([b" ".join(words)]), 1
    return map(b" ".join, zip(*(words[i:] for i in range(n)))), len(words) - n + 1


def _of_words(words: list[bytes]) -> int:
    if not words:
        return 0
    shingles, n = _shingles(words, 3)
    return _majority((xxhash.xxh64_intdigest(s, SEED) for s in shingles), n)


def simhash(text: bytes | None) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    return _of_words((text or b"").lower().split())


class Looker:
    """What near copies are found by: a text's fingerprint, that of its single words, its minima and its sketch."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[w] = xxhash.xxh64_intdigest(w, SEED)
        return got

    def look(self, text: bytes | None) -> tuple[int, int, list[int], list[int]]:
        words = (text or b"").lower().split()
        if not words:
            return 0, 0, [], []
        minima, least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64), np.zeros(0, np.uint32)
        shingles, n = _shingles(words, WORDS)
        for start in range(0, n, BLOCK):
            k = min(BLOCK, n - start)
            block = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, k)), np.uint64, k)
            minima = np.minimum(minima, (block[:, None] * _TURNS).min(0))
            least = np.unique(np.concatenate([least, (block >> np.uint64(32)).astype(np.uint32)]))[:SKETCH]
        return _of_words(words), _majority(map(self.word, words), len(words)), minima.view(np.int64).tolist(), least.view(np.int32).tolist()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([simhash(t.as_py()) for t in b.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1), fp], ["doc_id", "fp"])

    own = own_columns(docs, ("doc_id", "text"))
    return own.select(F.col("text").cast("binary").alias("text"), "doc_id").mapInArrow(run, "doc_id bigint, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints ``fp``, edges (u, v), u > v, that connect all within the radius."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("p")) for i, m in enumerate(MASKS)])
    dealt = fps.select("fp", F.inline(tables))
    shared = dealt.groupBy("t", "p").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("t", "p")
    members = dealt.join(shared, ["t", "p"], "left_semi")
    flips = F.element_at(
        F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1] + [F.lit(0).cast("bigint")]) for m in MASKS]),
        F.col("t") + 1,
    )
    near = members.select("fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("near"))
    stars = near.groupBy("near").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # never more than 65
    return stars.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u > v").distinct().select("u", "v")


def looked(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, words_fp, minima and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looker = Looker()
        for b in batches:
            got = [looker.look(t.as_py()) for t in b.column(0)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], ["doc_id", "key", "fp", "words_fp", "minima", "sketch"])

    own = own_columns(docs, ("doc_id", "text"))
    return own.select(F.col("text").cast("binary").alias("text"), "doc_id", row_key().alias("key")).mapInArrow(run, "doc_id bigint, key bigint, fp bigint, words_fp bigint, minima array<bigint>, sketch array<int>")


def similarity(a: Column, b: Column) -> Column:
    """Of two sets, from their sketches: the share of the least hashes of both together that both have; exact if all are there."""
    unsigned = lambda xs: F.transform(xs, lambda x: F.pmod(x.cast("bigint"), F.lit(1 << 32)))
    a, b = unsigned(a), unsigned(b)
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(both, -1)))
    return F.when(F.size(both) > 0, shared / F.size(both)).otherwise(0.0)


def similar_links(texts: DataFrame) -> DataFrame:
    """Of texts (n, fp, words_fp, minima, sketch; ``n`` tells them apart), edges (u, v), u > v, of fingerprints whose texts are similar."""
    masked = [F.xxhash64(F.lit(i), F.col("words_fp").bitwiseAND(F.lit(signed(m))), F.col("minima")[i % MINIMA]) for i, m in enumerate(WORD_MASKS)]
    met = texts.where(F.size("minima") > 0).select("n", F.explode(F.array(*masked)).alias("g"))
    first = met.groupBy("g").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a < b").select("g", "a")
    pairs = met.join(first, "g").where("n > a").select("n", "a").distinct()
    own = texts.select("n", "fp", "sketch")
    pairs = pairs.join(own, "n").join(own.toDF("a", "a_fp", "a_sketch"), "a")
    near = pairs.where((F.col("fp") != F.col("a_fp")) & (similarity(F.col("sketch"), F.col("a_sketch")) >= SIMILAR))
    return near.select(F.greatest("fp", "a_fp").alias("u"), F.least("fp", "a_fp").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of the edges (u, v), u > v: root is the least node of its component."""
    edges = cut(edges.select("u", "v"))
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def _fingerprints_of(marked: DataFrame) -> DataFrame:
    """Each fingerprint of ``marked`` (doc_id, fp) once, with its smallest doc_id, ``least``."""
    return cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))


def _rooted(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component_id (the smallest doc_id) and root of each fingerprint, by the components of ``edges``."""
    roots = components(edges)
    named = cut(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(first, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable, for each row of ``docs``."""
    marked = cut(fingerprints(docs))
    fps = _fingerprints_of(marked)
    return marked.join(_rooted(fps, links(fps.select("fp"))), "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, component_id and root of each row: components of the links of fingerprints and of those of similar texts."""
    marked = cut(looked(docs))
    fps = _fingerprints_of(marked)
    texts = marked.groupBy("fp", "words_fp").agg(F.min(F.struct("minima", "sketch")).alias("s"))
    texts = cut(texts.select(F.xxhash64("fp", "words_fp").alias("n"), "fp", "words_fp", "s.minima", "s.sketch"))
    # Expressions of their own, as Spark fails on a union of columns that it has inferred a comparison of.
    fresh = lambda df: df.select(*[F.col(c).bitwiseXOR(F.lit(0)).alias(c) for c in ("u", "v")])
    edges = fresh(links(fps.select("fp"))).unionByName(fresh(similar_links(texts)))
    return marked.join(_rooted(fps, edges), "fp").select("doc_id", "key", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of near duplicates, all columns: that of the smallest id.

    A null id comes after all others; of rows that share an id that of the lowest hash of its text; of rows alike
    in both, one.
    """
    rows = near_copies(docs)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("first"))
    first = first.select(F.col("first")["key"].alias("_k"), F.col("first")["doc_id"].alias("_d"))
    keyed = with_row(docs, ("doc_id", "text")).select("_row", "doc_id", row_key().alias("_key"))
    # Joined by the key alone, so that the window needs no exchange of its own; ids are compared afterwards, each row has one match at most.
    keyed = keyed.join(first, F.col("_key") == F.col("_k")).where(same(F.col("doc_id"), F.col("_d"))).drop("_k", "_d")
    alike = Window.partitionBy("_key", "doc_id").orderBy(F.xxhash64(F.to_json("_row")))
    return rows_again(keyed.withColumn("_n", F.row_number().over(alike)).where("_n = 1"), docs.columns)
