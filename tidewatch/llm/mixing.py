"""Mixing sources to target weights by entropy balancing.

DataFrame functions only.  A document's size is its number of words.  Sources, by code point with null
last, weigh 3, 1, 2, repeating, and share 150 % of all sizes; no target exceeds twice its source's size, and
what is over is shared again by weight.

Rates: of all r with 0 <= r <= 2 whose words make each source's target, those of least relative entropy to "each
document once".  They are r = min(2, exp(l * size)), an exponential tilt with one multiplier l for each
source; the convex dual is solved by Newton steps, kept in a bracket (a step that
leaves it is replaced by the middle), until each source's words are at its target or its bracket can't be halved.  A step is one grouped sum
over the counts of (source, size), which are far fewer than the documents.

Copies: documents of a source in order of size, then of a hash of id and text, are rounded systematically: copies are the
increase of the rounded running sum of the rates.  The running sum over a source of any size is made from
sums by (source, size) and places within the same size, which are dealt over tasks by ranges of the hash.  As neighbours have
like sizes, what is left is small; ``MENDS`` times, the document whose size comes nearest to what
is missing (or too much) gets one copy more (or less).

All sums are of whole numbers (rates in units of ``UNIT`` and ``STEP``), so they are the same in whatever order tasks add them up, and so is the mix.

Edge cases: a null text has size 0 and is never taken; a null source is a source; rows that share an id and text are told apart by
a number among them; texts are counted whole, however long; of documents that mend a source equally well that of the least size, then hash, is taken; empty
sources have target 0; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import are_few, cut, join_by_group, own_columns, row_key, rows_again, same, spread, with_row

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
CLOSE = 1e-9
MENDS = 3
#: The units of rates in the sums of a Newton step, and in the running sums (2^24 a copy: room for 10^11 documents of a source).
UNIT, STEP = 1 << 40, 24


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each row, ``h``, a hash that orders rows of one size, and ``part``, the range of the hash that it is in.

    There are as many parts as shuffle partitions or more, in the order of the hash, so their number does not matter to what follows.
    """
    own = own_columns(docs, ("doc_id", "text", "source"))
    h, bits = row_key(), max(6, spread(docs).bit_length())
    return own.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), h.alias("h")).withColumn("part", F.shiftright("h", 64 - bits).cast("int"))


def ranked_sources(totals: DataFrame) -> DataFrame:
    """``totals`` (one row for each source) with ``place``, from 0, in the order of sources, null last.

    Sources are dealt out by range and counted within and before each range, so any number of them will do.
    """
    dealt = cut(totals.repartitionByRange(spread(totals), F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each range
    w = Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())
    return dealt.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(before), "_p").withColumn("place", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def targets(totals: DataFrame) -> DataFrame:
    """source, source_size, n and target; the level at which sources fill is raised until none is over its limit."""
    i = F.col("place") % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i + 1).cast("int"))
    rows = cut(ranked_sources(totals).withColumn("weight", weight))
    level = 0.0
    while True:
        full = MOST * F.col("source_size") <= F.col("weight") * level
        whole, gone, open_weight = rows.agg(
            F.sum("source_size"), F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        new = (SHARE * (whole or 0) - gone) / open_weight if open_weight else level
        if not open_weight or new <= level * (1 + 1e-15):
            break
        level = new
    return rows.withColumn("target", F.least(MOST * F.col("source_size"), F.col("weight") * F.lit(level))).drop("weight", "place")


def rate(tilt: Column, size: Column) -> Column:
    return F.least(F.lit(MOST), F.exp(F.least(tilt * size, F.lit(50.0))))


def tilts(counts: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """``goals`` with the multiplier ``tilt`` of each source, by safeguarded Newton steps on the dual."""
    small = counts.where("size > 0").groupBy("source").agg(F.min("size").alias("least"))
    s = join_by_group(goals, small, "source", "source", few)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    least = F.coalesce("least", F.lit(1))
    # At these ends the words taken are surely below and above the target.
    s = s.withColumn("lo", F.when(ratio < 1, F.log(F.greatest(ratio, F.lit(1e-300))) / least).otherwise(0.0))
    s = s.withColumn("hi", F.when(ratio < 1, 0.0).otherwise(F.log(F.lit(MOST)) / least)).withColumn("tilt", F.when(ratio >= MOST, F.col("hi")).otherwise(0.0)).drop("least")
    s = cut(s)
    r = rate(F.col("tilt"), F.col("size"))
    words = F.floor(r * UNIT + 0.5).cast("decimal(13,0)") * F.col("size").cast("decimal(10,0)") * F.col("n_docs").cast("decimal(13,0)")
    slope = F.when(r < MOST, F.floor(r * UNIT + 0.5)).otherwise(0).cast("decimal(13,0)") * (F.col("size") * F.col("size")).cast("decimal(20,0)") * F.col("n_docs").cast("decimal(13,0)")
    open_ = True
    while open_:
        now = join_by_group(counts, s.select("source", "tilt"), "source", "size", few)
        now = now.select("source", words.alias("words"), slope.alias("slope")).groupBy("source").agg(*[(F.sum(c).cast("double") / UNIT).alias(c) for c in ("words", "slope")])
        now = join_by_group(s, now, "source", "source", few)  # both have one row for each source
        over = F.coalesce("words", F.lit(0.0)) - F.col("target")
        lo = F.when(over < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(over > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope"))
        next_ = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        there = (F.abs(over) / F.greatest(F.col("target"), F.lit(1.0)) <= CLOSE) | (next_ <= lo) | (next_ >= hi)
        s = cut(now.select("source", "source_size", "n", "target", lo.alias("lo"), hi.alias("hi"), F.when(there, F.col("tilt")).otherwise(next_).alias("tilt"), there.alias("_there")))
        open_ = s.where("NOT _there").limit(1).count() > 0
        s = s.drop("_there")
    return s.select("source", "source_size", "target", "tilt")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, h and copies (0, 1 or 2) for each row."""
    rows = cut(sized(docs))
    counts = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n_docs")))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).alias("source_size"), F.sum("n_docs").alias("n"))
    goals = cut(targets(totals))
    few = are_few(goals)
    goals = tilts(counts, goals, few)
    # Running sums: of the rates of all smaller sizes of the source, then within the size over its parts, then within a part.
    parts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("k"))
    step = F.floor(rate(F.col("tilt"), F.col("size")) * (1 << STEP) + 0.5)
    parts = join_by_group(parts, goals, "source", "part", few).withColumn("r", F.when(F.col("size") > 0, step).otherwise(0).cast("bigint"))
    sums = parts.groupBy("source", "size").agg(F.sum(F.col("k") * F.col("r")).alias("_all"))
    by_size = Window.partitionBy("source").orderBy("size")
    sums = sums.select(F.col("source").alias("_s"), F.col("size").alias("_z"), (F.sum("_all").over(by_size) - F.col("_all")).alias("_smaller"))
    by_part = Window.partitionBy("source", "size").orderBy("part")
    parts = parts.withColumn("_before", F.sum("k").over(by_part) - F.col("k"))
    base = parts.join(sums, parts["source"].eqNullSafe(sums["_s"]) & (parts["size"] == sums["_z"])).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_q"), "source_size", "target", "r", (F.col("_smaller") + F.col("_before") * F.col("r")).alias("_from"),
    )
    got = rows.withColumn("_i", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id")))
    got = got.join(base, got["source"].eqNullSafe(base["_s"]) & (got["size"] == base["_z"]) & (got["part"] == base["_q"]))
    upto = F.col("_from") + F.col("_i") * F.col("r") + (1 << STEP - 1)
    k = F.shiftright(upto, STEP) - F.shiftright(upto - F.col("r"), STEP)
    got = cut(got.select("doc_id", "source", "size", "h", "source_size", "target", F.greatest(F.lit(0), F.least(F.lit(2), k)).cast("int").alias("copies"), "_i"))
    for _ in range(MENDS):
        got = mended(got, few)
    return got


def mended(rows: DataFrame, few: bool) -> DataFrame:
    """One document of each source, that whose size comes nearest to what is missing, gets a copy more or less if that helps."""
    left = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    groups = rows.where("size > 0").groupBy("source", "size", "copies").agg(F.min(F.struct("h", "doc_id", "_i")).alias("who"))
    near = join_by_group(groups, left, "source", "size", few)
    fits = F.when(F.col("left") > 0, F.col("copies") < 2).otherwise(F.col("copies") > 0) & (F.abs(F.abs("left") - F.col("size")) < F.abs("left"))
    pick = near.where(fits).groupBy("source").agg(F.min_by(F.struct("who", F.signum("left").cast("int").alias("by")), F.struct(F.abs(F.abs("left") - F.col("size")), "size", "copies")).alias("pick"))
    out = join_by_group(rows, pick, "source", "h", few)
    w = F.col("pick")["who"]
    mine = F.coalesce((F.col("h") == w["h"]) & F.col("doc_id").eqNullSafe(w["doc_id"]) & (F.col("_i") == w["_i"]), F.lit(False))
    return cut(out.withColumn("copies", F.when(mine, F.col("copies") + F.col("pick")["by"]).otherwise(F.col("copies"))).drop("pick"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), F.col("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns."""
    got = copies(docs).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("copies").alias("_k"), F.lit(1).alias("_m"))
    # Rows that share an id and text are numbered, and share out the copies that all of them got.
    got = got.groupBy("_d", "_h").agg(F.sum("_k").alias("_k"), F.sum("_m").alias("_m")).where("_k > 0")
    keyed = with_row(docs, ("doc_id", "text")).select("_row", "doc_id", row_key().alias("_key"))
    keyed = keyed.withColumn("_j", F.row_number().over(Window.partitionBy("_key", "doc_id").orderBy("_key")))
    # By the hash alone, by which the window has dealt the texts already; ids are compared afterwards, each row has one match at most.
    out = keyed.join(got, F.col("_key") == F.col("_h")).where(same(F.col("doc_id"), F.col("_d")))
    times = F.floor(F.col("_k") * F.col("_j") / F.col("_m")) - F.floor(F.col("_k") * (F.col("_j") - 1) / F.col("_m"))
    return rows_again(out.withColumn("_c", F.explode(F.array_repeat(F.lit(1), times.cast("int")))), docs.columns)
