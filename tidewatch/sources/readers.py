"""Sources: declared windows read from files, streams routed to windows, rows written in tests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import WindowSchema
from ..lang.tokens import RuleError

TYPES = {"chars": T.StringType(), "ip": T.StringType(), "hex": T.StringType(), "digit": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "time": T.TimestampType()}
#: Column of lines that could not be read.
CORRUPT = "_corrupt_record"


def struct_of(schema: WindowSchema) -> T.StructType:
    """The Spark schema of a window."""
    fields = []
    for name, kind in schema.fields:
        t = T.ArrayType(TYPES[kind[6:]]) if kind.startswith("array/") else TYPES[kind]
        fields.append(T.StructField(name, t))
    return T.StructType(fields)


def _as_text(schema: WindowSchema) -> T.StructType:
    """As the window's, but times as text: they may be numbers of nanoseconds or ISO texts."""
    own = struct_of(schema)
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.TimestampType, T.LongType)) else f.dataType) for f in own.fields])


def _time(name: str) -> F.Column:
    c = F.col(f"`{name}`")
    number = c.try_cast("decimal(38,0)")
    return F.when(number.isNotNull(), F.timestamp_micros((number / 1000).cast("bigint"))).otherwise(F.try_to_timestamp(c))


def typed(df: DataFrame, schema: WindowSchema, extra: Iterable[str] = ()) -> DataFrame:
    """``df`` in the window's types: numbers given as text, and times in nanoseconds or ISO, are read."""
    kinds = schema.types
    out = []
    for name, t in ((f.name, f.dataType) for f in struct_of(schema).fields):
        if name not in df.columns:
            out.append(F.lit(None).cast(t).alias(name))
        elif kinds[name] == "time":
            already = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))
            out.append((F.col(f"`{name}`").cast("timestamp") if already else _time(name)).alias(name))
        else:
            out.append(F.col(f"`{name}`").try_cast(t).alias(name) if not isinstance(t, T.ArrayType) else F.col(f"`{name}`").alias(name))
    return df.select(*out, *[c for c in extra if c in df.columns])


def ndjson(spark: SparkSession, path: str, schemas: Mapping[str, WindowSchema]) -> dict[str, DataFrame]:
    """Windows of a file of JSON lines.  A line's _stream says which windows it is for; lines without one are for all.

    Lines that can't be read are left out (``bad_lines`` counts them).
    """
    found = {}
    for name, w in schemas.items():
        if w.is_output:
            continue
        shape = T.StructType([*_as_text(w).fields, T.StructField("_stream", T.StringType()), T.StructField(CORRUPT, T.StringType())])
        df = spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
        mine = F.col("_stream").isNull() | F.col("_stream").isin(*w.streams)
        found[name] = typed(df.where(F.col(CORRUPT).isNull() & mine), w)
    return found


def bad_lines(spark: SparkSession, path: str) -> int:
    """How many lines of a file are no JSON."""
    shape = T.StructType([T.StructField("_stream", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", shape, {"columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).where(F.trim("value") != "").where(parsed[CORRUPT].isNotNull()).count()


def files(spark: SparkSession, path: str, schema: WindowSchema, kind: str = "parquet", stream: bool = False) -> DataFrame:
    """A window from Parquet, ORC, CSV or JSON files, as a table or as a stream of new files."""
    reader = (spark.readStream if stream else spark.read).format(kind)
    shape = _as_text(schema) if kind in ("json", "csv") else None
    if stream and shape is None:
        shape = spark.read.format(kind).load(path).schema
    df = (reader.schema(shape) if shape is not None else reader).options(**({"header": "true"} if kind == "csv" else {})).load(path)
    return typed(df, schema)


def arrow_ipc(spark: SparkSession, path: str, schema: WindowSchema) -> DataFrame:
    """A window from Arrow IPC files (stream or file format), each read by one task."""
    shape = struct_of(schema)
    names = [f.name for f in shape.fields]

    def read(parts: Iterable) -> Iterable:
        import pyarrow as pa

        for b in parts:
            for content in b.column("content"):
                data = pa.py_buffer(content.as_py())
                try:
                    batches = list(pa.ipc.open_stream(data))
                except pa.ArrowInvalid:
                    f = pa.ipc.open_file(data)
                    batches = [f.get_batch(i) for i in range(f.num_record_batches)]
                for batch in batches:
                    t = pa.Table.from_batches([batch])
                    yield from _cast(t, names).to_batches()

    def _cast(t, names):  # noqa: ANN001, ANN202
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
        cols = []
        for f in shape.fields:
            want = kinds.get(f.dataType.simpleString())
            c = t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, want)
            if want is not None and pa.types.is_timestamp(want) and pa.types.is_timestamp(c.type):
                c = c.cast(pa.timestamp("us"), safe=False).cast(want)
            cols.append(c.cast(want) if want is not None else c)
        return pa.table(cols, names=names)

    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(read, shape)


def route(df: DataFrame, schemas: Mapping[str, WindowSchema], column: str = "_stream") -> dict[str, DataFrame]:
    """Rows of all streams to the windows that subscribe to them; streams that none does go nowhere."""
    return {name: typed(df.where(F.col(column).isin(*w.streams)), w) for name, w in schemas.items() if w.streams}


def rows(spark: SparkSession, schema: WindowSchema, values: list[dict[str, object]], clock: list[int]) -> DataFrame:
    """Rows written by hand; ``clock`` gives each the time (microseconds) it has if its own is not given, and their order."""
    own = struct_of(schema)
    made = []
    for k, (v, at) in enumerate(zip(values, clock)):
        unknown = set(v) - set(own.fieldNames())
        if unknown:
            raise RuleError(f"window {schema.name} has no field {', '.join(sorted(unknown))}")
        made.append([None if v.get(n) is None else str(v[n]) if not isinstance(v[n], bool) else str(v[n]).lower() for n in own.fieldNames()] + [at, k])
    shape = T.StructType([*[T.StructField(n, T.StringType()) for n in own.fieldNames()], T.StructField("_at", T.LongType()), T.StructField("_seq", T.LongType())])
    df = spark.createDataFrame(made, shape)
    for name, kind in schema.fields:
        if kind == "digit":  # as numbers may be written with a point
            df = df.withColumn(name, F.col(f"`{name}`").try_cast("double").try_cast("bigint"))
    out = typed(df, schema, ("_seq", "_at"))
    return out.withColumn(schema.time, F.timestamp_micros("_at")).drop("_at") if schema.time else out.drop("_at")
