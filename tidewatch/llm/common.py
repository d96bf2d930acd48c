"""Helpers shared by the text operators: shared folders, checked joins, bounded samples."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 20_000
#: Copies of the small side when a join is salted.
SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; only where it names none and runs in one process (tests, a laptop) is a temporary one made."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        named = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def are_few(groups: DataFrame) -> bool:
    """Whether a table (that should be checkpointed) may be broadcast, by its count."""
    return groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, spare: str, few: bool | None = None) -> DataFrame:
    """Left join a table of one row per group (null is a group too) to rows of which one group may hold most.

    ``groups`` is counted first, unless ``few`` says what came of it.  Up to ``BROADCAST_ROWS`` rows it is
    broadcast; beyond that it is copied once per salt, and the rows of a group are dealt
    over the salts by a hash of ``spare``, so that no task gets a whole hot group.
    """
    g = groups.withColumnRenamed(key, "_gk")
    if are_few(g) if few is None else few:
        return rows.join(F.broadcast(g), rows[key].eqNullSafe(g["_gk"]), "left").drop("_gk")
    g = g.withColumn("_gs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = rows.withColumn("_rs", F.pmod(F.xxhash64(spare), F.lit(SALTS)).cast("int"))
    return r.join(g, r[key].eqNullSafe(g["_gk"]) & (r["_rs"] == g["_gs"]), "left").drop("_gk", "_gs", "_rs")


_SPACE = 1 << 52


def rate_limit(count: int, most: int) -> int:
    """The hash below which about one and a half times ``most`` of ``count`` rows fall, all if that is more."""
    return int(min(1.0, (1.5 * most + 50) / max(count, 1)) * _SPACE)


def lowest(df: DataFrame, limit: int | Column, *by: str) -> DataFrame:
    """The rows of ``df`` whose hash by the columns, ``_low``, is below ``limit``.

    A plain filter: no task keeps rows of its own to choose from, so what is collected of it does not grow with the number of
    tasks.  It is cut to size in order of ``_low`` afterwards.
    """
    return df.withColumn("_low", F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(_SPACE))).where(F.col("_low") < limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, longest: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) pairs of each of the labels 0 and 1, those whose id hashes lowest.

    Rows whose crc32(doc_id) mod ``modulus`` is ``held`` are never read, nor those of more than
    ``longest`` characters, so the result is bounded by 2 * per_class * longest characters.
    The ids are chosen from the labels alone, so that only their texts are moved.
    """
    ids = own_columns(labels, ("doc_id", label)).withColumnRenamed(label, "_y").where(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = ids.where(split_of(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen: list[tuple[int, int]] = []
    for y in (0, 1):
        some = lowest(ids.where(F.col("_y") == y), rate_limit(counts.get(y, 0), per_class), "doc_id").select("_low", "doc_id").collect()
        chosen += [(r["doc_id"], y) for r in sorted(some)[:per_class]]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, _y int")  # at most 2 * per_class rows of two numbers
    got = own_columns(docs, ("doc_id", "text")).where(F.length("text") <= longest).join(F.broadcast(wanted), "doc_id")
    rows = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_y").alias("_y")).collect()
    return [(r["text"], r["_y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "url": "string", "html": "string", "page_id": "bigint", "quality": "int", "toxic": "int"}


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called by their places, so that names that are alike but for case, or altogether, can't clash."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def _picked(columns: Sequence[str], names: Sequence[str]) -> list[Column]:
    """The named columns of a ``numbered`` DataFrame, the first of each name, null of the right type where there is none."""
    return [(F.col(f"_c{columns.index(n)}") if n in columns else F.lit(None)).cast(TYPES[n]).alias(n) for n in names]


def own_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, null of the right type where one is missing; extra columns go, those too that differ in case only."""
    return numbered(df).select(*_picked(df.columns, names))


def with_row(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns of ``df``, and the whole row as ``_row``, by places, out of the way of any names used here."""
    return numbered(df).select(*_picked(df.columns, names), F.struct(*[F.col(f"_c{i}") for i in range(len(df.columns))]).alias("_row"))


def rows_again(df: DataFrame, columns: Sequence[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``with_row``, with some columns (the first of their names) ``new``."""
    return df.select(*[(new or {}).get(c, F.col("_row")[f"_c{i}"]).alias(c) if columns.index(c) == i else F.col("_row")[f"_c{i}"].alias(c) for i, c in enumerate(columns)])


def same(a: Column, b: Column) -> Column:
    """Whether two values are equal or both null, as a condition that does not become a key of a join."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


def row_key() -> Column:
    """A number that tells texts and ids apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))
