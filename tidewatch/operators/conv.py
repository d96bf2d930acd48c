"""What is done with the windows that close together: sort, top, dedup, where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compile import Compiler
from ..functions.values import text
from ..lang.ast import ConvOp, Neg


def apply(df: DataFrame, chains: tuple[tuple[ConvOp, ...], ...], compiler: Compiler, scope: list[str], tie: list[str]) -> DataFrame:
    """Runs the chains on each group of rows that share ``scope``; ``rank`` tells the order at the end.

    The order to begin with is that of ``tie``.
    """
    order: list[Column] = [F.col(c) for c in tie]
    for op in (op for chain in chains for op in chain):
        w = Window.partitionBy(*scope).orderBy(*order)
        if op.kind == "sort":
            wanted = []
            for e in op.args:
                down = isinstance(e, Neg)
                c = compiler.value(e.of if down else e).column
                wanted.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            order = [*wanted, *order]
        elif op.kind == "top":
            df = df.withColumn("_top", F.row_number().over(w)).where(F.col("_top") <= op.n).drop("_top")
        elif op.kind == "dedup":
            own = Window.partitionBy(*scope, "_dedup").orderBy(*order)
            df = df.withColumn("_dedup", text(compiler.value(op.args[0]))).withColumn("_first", F.row_number().over(own)).where("_first = 1").drop("_dedup", "_first")
        else:
            df = df.where(F.coalesce(compiler.condition(op.args[0]), F.lit(False)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
