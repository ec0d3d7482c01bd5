"""Bit filters of fixed size, in DataFrame operations only: they keep rows without a match out of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of a filter; of fixed size, whatever the input.
FILTER_BITS = 1 << 24


def marks(values: DataFrame) -> DataFrame:
    """A bit filter of the column `x`: at most FILTER_BITS / 64 rows, whatever the input."""
    bit = F.pmod("x", F.lit(FILTER_BITS))
    return values.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))


def with_mark(rows: DataFrame, column: str, held: DataFrame, how: str = "left") -> DataFrame:
    """The rows with the flag `__hit`: whether their value of `column` may be in the filter, which is broadcast as its size is bounded."""
    found = rows.withColumn("__bit", F.pmod(column, F.lit(FILTER_BITS))).withColumn("__word", F.shiftright("__bit", 6)).join(F.broadcast(held.withColumnRenamed("word", "__word")), "__word", how)
    return found.select(*rows.columns, F.expr("coalesce(shiftright(bits, cast(__bit & 63 as int)) & 1 = 1, false)").alias("__hit"))


def marked(rows: DataFrame, column: str, held: DataFrame) -> DataFrame:
    """The rows whose value of `column` may be in the filter."""
    return with_mark(rows, column, held, "inner").filter("__hit").drop("__hit")
