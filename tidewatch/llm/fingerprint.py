"""Document fingerprints by a homomorphic multiset hash.

DataFrame functions only.  Each paragraph (line) is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, so the order of paragraphs does not matter, and a paragraph is inserted
or deleted by adding or subtracting its vector (``insert``, ``delete``).  The vector has two parts:

* ``WIDE`` lanes of 32 bits, uniform hashes of the paragraph, summed modulo 2^32: equal for equal multisets of
  paragraphs, and else different but for chance;
* ``len(SHIFTS) * HASHES * 2`` lanes of 31 bits, of which each of the paragraph's phrases (a few words, cut where a
  word's ending says so) sets about half, summed modulo powers of 2, two lanes to a long; no text that Spark can hold has phrases
  enough to fill a lane.  With the number of phrases they give the sum of vectors of +1 and -1, whose products estimate the
  multisets' likeness: 2ab / (aa + bb), 0 at least.

The document after each, by ascending id, is found without bringing all rows together: split points of
the id deal documents into buckets, the first document of a bucket goes to the one before as well, and a window runs
in each.  Texts are moved once.

Edge cases: a null text counts as empty, which is one paragraph without words (so the fingerprint of a text and of one put after it, line by line, is
always the sum of theirs); texts are read whole, however long; rows that share an id follow each other by
their text's hash; rows of a null id come last; the last row's next is the first, and a single row is its own next;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import reached, splits
from .common import own_columns, spread

WIDE = 8
HASHES = 2
SHIFTS = range(24)
LANE, LANES = 31, 2
_LOW = 0xFFFFFFFF
_SET = sum(1 << LANE * k for k in range(LANES))
_ALL = (1 << LANES * LANE) - 1
#: A phrase ends at a line's end, after a mark, and after words with these endings.
PHRASE = r"(?<=[^A-Za-z\s]|[ehnEHN])[\x20\t]+|\n"
#: Buckets of ids for each shuffle partition.
BUCKETS = 6


def _keyed(key: int) -> Callable[[Column], Column]:
    return lambda p: F.xxhash64(F.lit(key), p)


def _sum(hashes: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: (acc + of(h)).bitwiseAND(F.lit(_LOW)))


def wide_lanes(text: Column) -> Column:
    """The uniform lanes of a text, two from each hash of its paragraphs."""
    lines = F.split(text, "\n", -1)
    lanes = []
    for k in range(WIDE // 2):
        hashes = F.transform(lines, _keyed(k))
        lanes += [_sum(hashes, lambda h: h.bitwiseAND(F.lit(_LOW))), _sum(hashes, lambda h: F.shiftrightunsigned(h, 32))]
    return F.array(*lanes)


def fingerprinted(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of ``text`` (not null) in its place.  The other columns must tell rows apart.

    The phrases' vectors are summed by a grouped aggregate, so that it is compiled: it needs no exchange where the
    rows are dealt by some of their columns, and else one of sums, as rows of a text come together.
    """
    keys = [c for c in rows.columns if c != text]
    rows = rows.withColumn("_wide", wide_lanes(F.col(text)))
    phrases = rows.select(*keys, "_wide", F.explode_outer(F.split(text, PHRASE, -1)).alias("_p"))
    real = F.coalesce(F.col("_p") != "", F.lit(False))
    phrases = phrases.select(*keys, "_wide", F.when(real, 1).otherwise(0).alias("_1"), *[F.when(real, F.xxhash64(F.lit(100 + k), "_p")).otherwise(F.lit(0).cast("bigint")).alias(f"_f{k}") for k in range(HASHES)])
    sums = [F.sum(F.shiftrightunsigned(f"_f{k}", i).bitwiseAND(F.lit(_SET))).alias(f"_s{k}_{i}") for k in range(HASHES) for i in SHIFTS]
    summed = phrases.groupBy(*keys, "_wide").agg(F.sum("_1").alias("_n"), *sums)
    fine = [F.col(f"_s{k}_{i}").bitwiseAND(F.lit(_ALL)) for k in range(HASHES) for i in SHIFTS]
    return summed.select(*keys, F.concat("_wide", F.array(*fine, F.col("_n"))).alias(name))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of ``a`` and ``b`` together; with ``sign`` -1, of ``a`` without those of ``b``."""
    wide = F.zip_with(F.slice(a, 1, WIDE), F.slice(b, 1, WIDE), lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW)))
    n = HASHES * len(SHIFTS)
    fine = F.zip_with(F.slice(a, WIDE + 1, n), F.slice(b, WIDE + 1, n), lambda x, y: (x + sign * y).bitwiseAND(F.lit(_ALL)))
    return F.concat(wide, fine, F.array(F.element_at(a, -1) + sign * F.element_at(b, -1)))


def insert(a: Column, paragraph: Column) -> Column:
    return combine(a, paragraph, 1)


def delete(a: Column, paragraph: Column) -> Column:
    return combine(a, paragraph, -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints alone."""
    n = HASHES * len(SHIFTS)

    def signs(v: Column) -> Column:
        return F.flatten(F.transform(F.slice(v, WIDE + 1, n), lambda x: F.array(*[(2 * F.shiftrightunsigned(x, LANE * k).bitwiseAND(F.lit((1 << LANE) - 1)) - F.element_at(v, -1)).cast("double") for k in range(LANES)])))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    sa, sb = signs(a), signs(b)
    both = dot(sa, sa) + dot(sb, sb)
    rough = F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(sa, sb) / both))).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(rough)


def text_of(v: Column) -> Column:
    """The fingerprint as lowercase hex: the wide lanes, then the others."""
    wide = F.transform(F.slice(v, 1, WIDE), lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.lower(F.array_join(F.concat(wide, F.transform(F.slice(v, WIDE + 1, HASHES * len(SHIFTS) + 1), lambda x: F.lpad(F.hex(x), 16, "0"))), ""))


def with_next(df: DataFrame, what: list[str], ghosts: bool = False) -> DataFrame:
    """``df`` (doc_id, text and others) and, as next_<column>, the given columns of the next row by ascending doc_id, the first row's after the last.

    With ``ghosts``, also the bucket _b, the place _i in it, and the rows that are there for the row before only (_g = 1).
    """
    cuts = splits(df, F.col("doc_id"), spread(df) * BUCKETS) or [0]
    n = len(cuts)
    bucket, opening = reached(F.col("doc_id"), cuts)
    bucket = F.when(F.col("doc_id").isNull(), n).otherwise(bucket)
    home = F.array(F.struct(bucket.alias("_b"), F.lit(0).alias("_g")))
    also = F.array(F.struct(F.when(bucket > 1, bucket - 1).otherwise(n).alias("_b"), F.lit(1).alias("_g")))
    alone = F.lit(cuts == [0])  # perhaps all ids are null: then the bucket's own first row must follow its last
    opens = F.coalesce(opening == F.col("doc_id"), alone)
    rows = df.select("*", F.xxhash64("text").alias("_h"), F.inline(F.when(opens, F.concat(home, also)).otherwise(home)))
    w = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").asc_nulls_last(), "_h")
    after = F.lead(F.struct(*what)).over(w)
    rows = rows.withColumn("_n", after).withColumn("_i", F.row_number().over(w))
    if ghosts:
        return rows.select("_b", "_g", "_i", *df.columns, *[F.col("_n")[c].alias(f"next_{c}") for c in what])
    return rows.where("_g = 0").select(*df.columns, *[F.col("_n")[c].alias(f"next_{c}") for c in what])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row.

    After the one exchange of texts, all is done where a bucket is: each row and the row it opens the next bucket for are
    numbered, both texts of a row become rows of their own, and their fingerprints are brought together by a window.
    """
    own = own_columns(docs, ("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(own, ["text"], ghosts=True)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("_b", "_g", "_i", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("_e"), F.col("text")), F.struct(F.lit(1).alias("_e"), F.col("edited").alias("text")))
    prints = fingerprinted(rows.select("_b", "_g", "_i", "doc_id", "n_chars", "edited_sha256", F.inline(both)), "text", "fp")
    w = Window.partitionBy("_b").orderBy("_i", "_e")
    prints = prints.withColumn("edited_fp", F.lead("fp", 1).over(w)).withColumn("next_fp", F.lead("fp", 2).over(w)).where("_g = 0 AND _e = 0")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
