"""Which intervals hold a point, as an equality join.

Days are cut into blocks of 1, 2, 4, ... days that begin at multiples of their length. An interval is the union of at most two blocks of each
length, and a point lies in exactly one block of each; an interval holds a point if they share one, and they share
at most one. So the join is on (length, block), of hashes like any other: no pair is looked at that does not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Lengths of blocks are 2^0 to 2^(LEVELS - 1) days; the longest ones hold all dates that Spark has.
LEVELS = 23
#: Days are counted from here, so that they are never negative.
ORIGIN = 719_528 + 365


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + ORIGIN


def blocks(start: Column, end: Column) -> Column:
    """ARRAY<STRUCT<level, block>>: the fewest blocks that make up the days from `start` to `end`, both included; null is no bound, and a start after the end has none."""
    low = F.coalesce(_day(start), F.lit(0))
    high = F.coalesce(_day(end), F.lit((1 << LEVELS) - 1)) + 1
    # Half-open [a, b) in units of each length: an odd a leaves its first block, an odd b its last one, the rest goes on at twice the length.
    levels = F.sequence(F.lit(0), F.lit(LEVELS))

    def at(level: Column) -> Column:
        a = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1), level) - 1, level)
        b = F.call_function("shiftright", high, level)
        first = F.when((a < b) & (a % 2 == 1), F.array(F.struct(level.alias("level"), a.alias("block"))))
        last = F.when((a < b) & (b % 2 == 1) & ~((a % 2 == 1) & (b - 1 == a)), F.array(F.struct(level.alias("level"), (b - 1).alias("block"))))
        none = F.array().cast("array<struct<level:int,block:int>>")
        return F.concat(F.coalesce(first, none), F.coalesce(last, none))

    return F.flatten(F.transform(levels, at))


def points(date: Column) -> Column:
    """ARRAY<STRUCT<level, block>>: the block of each length that a day is in."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", _day(date), level).alias("block")))


def holding(rows: DataFrame, start: str, end: str, days: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """Each row of `rows` with each row of `days` whose date lies between its bounds, both included; null bounds are open, and a null date
    matches nothing. `keys` are columns of both that must be equal too (and are kept once). Names must not clash otherwise."""
    own = rows.withColumn("__b", F.explode(blocks(F.col(start), F.col(end))))
    other = days.filter(F.col(date).isNotNull()).withColumn("__b", F.explode(points(F.col(date))))
    return own.join(other, ["__b", *(keys or [])]).drop("__b")
