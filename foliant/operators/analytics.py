"""Offline reports: exact quantiles, distributions, reports by level, counts by language, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

THRESHOLDS = (400, 512, 640, 800, 1024, 1200)
#: Named places of a distribution.
PLACES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Different values between two bounds up to which they are counted one by one.
FEW = 10_000


def quantiles(values: DataFrame, column: str, places: Sequence[float], few: int = FEW, accuracy: int = 10_000) -> tuple[int, list]:
    """How many values there are, without nulls, and the ones at places floor(n p), counted from 0, of the sorted list; None where it has no such place.

    Selection by passes: a sketch names values near each wanted rank, and counts of what lies below them tell which side the rank is on;
    so the open interval that it is in shrinks with each pass, until a value is met or `few` rows are left, which are
    counted one by one. A pass is an aggregation with a row for each task, whatever the number of values."""
    v = F.col("v")
    rows = values.select(F.col(column).alias("v")).filter("v is not null")
    n = rows.count()
    ranks = {p: int(n * p) for p in places}
    found: dict[int, object] = {}
    #: By rank: the values that it lies strictly between (None for no bound), how many values are up to the lower and below the upper one.
    between = {r: (None, None, 0, n) for r in set(ranks.values()) if r < n}

    def inside(r: int) -> Column:
        low, high = between[r][:2]
        return (F.lit(True) if low is None else v > F.lit(low)) & (F.lit(True) if high is None else v < F.lit(high))

    while between:
        for r in [r for r, b in between.items() if b[3] - b[2] <= few]:
            seen = between[r][2]
            for x in rows.filter(inside(r)).groupBy("v").agg(F.count("*").alias("c")).sort("v").collect():
                seen += x["c"]
                if r not in found and seen > r:
                    found[r] = x["v"]
            del between[r]
        if not between:
            break
        order, off = list(between), 2 / accuracy
        share = {r: (r - b[2]) / (b[3] - b[2]) for r, b in between.items()}
        spots = [F.percentile_approx(F.when(inside(r), v), F.array(*[F.lit(min(1.0, max(0.0, share[r] + d))) for d in (-off, 0.0, off)]), accuracy) for r in order]
        cuts = {r: sorted(set(spot)) for r, spot in zip(order, rows.agg(*spots).first(), strict=True)}
        counts = iter(rows.agg(*[F.count_if(c) for r in order for x in cuts[r] for c in (v < F.lit(x), v <= F.lit(x))]).first())
        for r in order:
            low, high, below, upto = between.pop(r)
            for x in cuts[r]:
                under, through = next(counts), next(counts)
                if under <= r < through:
                    found[r] = x
                elif through <= r and (low is None or x > low):
                    low, below = x, through
                elif under > r and (high is None or x < high):
                    high, upto = x, under
            if r not in found:
                between[r] = (low, high, below, upto)
    return n, [found.get(ranks[p]) for p in places]


def _above(weight: Column, v: Column) -> list[Column]:
    """How much of the weight lies above each threshold, and in the band where articles are cut."""
    over = [F.coalesce(F.sum(F.when(v > t, weight)), F.lit(0)).alias(f"over_{t}") for t in THRESHOLDS]
    return [*over, F.coalesce(F.sum(F.when((v > 800) & (v <= 1024), weight)), F.lit(0)).alias("band_800_1024")]


def distribution(values: DataFrame, column: str) -> DataFrame:
    """n, the values at places floor(n p) of the sorted list (p = .5, .9, .95, .99), the maximum, and how many lie above each threshold."""
    n, found = quantiles(values, column, list(PLACES.values()))
    kind = values.schema[column].dataType
    at = [F.lit(x).cast(kind).alias(name) for name, x in zip(PLACES, found, strict=True)]
    return values.agg(F.max(column).alias("max"), *_above(F.lit(1), F.col(column))).select(F.lit(n).cast("long").alias("n"), *at, "max", *[f"over_{t}" for t in THRESHOLDS], "band_800_1024")


def report(chunks: DataFrame, levels: Sequence[Sequence[str]], value: str = "token_count") -> DataFrame:
    """Chunks, their tokens and the distribution of these, at several levels of detail in one pass over the chunks.

    `levels` are lists of columns, [] for the whole; the result names the level ("lang+source", "all") and is null in the columns that it does
    not use. Chunks are counted by level and value first (grouping sets); values are token counts, of which a level has
    no more than the longest chunk has tokens, so the running sums that give the exact quantiles stay short."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    rows = chunks.select(*columns, F.col(value).cast("long").alias("v"))
    used = F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]))
    counts = rows.groupingSets([[*[F.col(c) for c in level], F.col("v")] for level in levels], *columns, "v").agg(F.count("*").alias("c"), F.when(F.size(used) > 0, F.array_join(used, "+")).otherwise("all").alias("level"))
    group = ["level", *columns]
    # Chunks without a token count are counted, but have no place in the distribution.
    known = F.when(F.col("v").isNotNull(), F.col("c"))
    running = counts.withColumns({"upto": F.sum(known).over(Window.partitionBy(*group).orderBy(F.asc_nulls_last("v")).rowsBetween(Window.unboundedPreceding, 0)), "n": F.coalesce(F.sum(known).over(Window.partitionBy(*group)), F.lit(0))})
    places = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v"))).alias(name) for name, p in PLACES.items()]
    return running.groupBy(*group).agg(F.sum("c").alias("chunks"), F.coalesce(F.sum(F.col("v") * F.col("c")), F.lit(0)).alias("tokens"), *places, F.max("v").alias("max"), *_above(F.col("c"), F.col("v")))


def by_language(chunks: DataFrame) -> DataFrame:
    """Chunks of each document, in all and by language."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), *[F.count_if(F.col("language") == x).alias(x) for x in ("es", "eu")])


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; each task keeps its own first n before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("nth") <= n)
