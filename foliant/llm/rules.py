"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose statistic lies above a cutoff. Each stratum (language) gets
its own cutoffs from labelled rows, split in two by the crc32 of their id:

* One half designs a path: the (rule, cutoff) pairs ordered by the share of good texts they
  reject, without those that reject no bad text beyond the ones before. Walking the path
  tightens the verdict step by step.
* The other half is held out. For each prefix of the path the exact binomial
  (Clopper-Pearson) upper bound on the share of good texts that the *whole verdict* rejects
  must be at most `risk`. Prefixes are tested in order and the walk stops before the first
  that fails (fixed-sequence testing), and the error level is divided by the number of
  strata with labels (Bonferroni), so that with probability `confidence` every stratum's false rejection
  is limited at once.

The bound needs independent trials. So of the labelled rows of a stratum with equal texts one counts, that of the smallest id (none if
their labels differ), and copies never stand in both halves. Near copies do count as trials of their own.

The bound needs no inversion: it is at most r exactly if P(Binomial(n, r) <= k) <= delta
for k rejected among n good texts.

Strata are as many as there are: their paths and cutoffs are tables, made by aggregations and windows over rows of
(stratum, step), and joined. A stratum without labelled rows has no cutoff, so that only the base test rejects there.

Defined cases: a null or empty text has zero for every statistic and fails the base test.
Labels that are null, contradict each other or belong to no document are left out, as are
null ids. A null stratum is the stratum "". Without
labels no cutoff is admissible and only the base test rejects. Repeated rows are each
judged.
"""

from __future__ import annotations

import math
from itertools import count
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.llm.batches import map_texts, remainder
from foliant.llm.marks import marked, marks
from foliant.llm.storage import materialise

#: Statistic and its cutoffs. A text is rejected when its statistic is above.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "shout_share": (0.1, 0.2, 0.35, 0.5, 0.7),
    "repeat_share": (0.1, 0.2, 0.3, 0.4, 0.5),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "word_length": (8.0, 10.0, 12.0, 16.0),
    "echo_share": (0.1, 0.2, 0.3, 0.5),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_echo")

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of `size` words that occur twice or more."""
    n = len(words)
    if n <= size:
        return 0
    number = dict(zip(dict.fromkeys(words), count()))
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    # Windows are numbered by adding one word at a time: equal numbers mean equal windows.
    key = ids[: n - size + 1]
    for k in range(1, size):
        key = np.unique(key * len(number) + ids[k : n - size + 1 + k], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    hit = np.zeros(n, bool)
    for k in range(size):
        hit[k : n - size + 1 + k] |= again
    return int(hit.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The COUNTS of one text. Words are runs without ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        len(words),
        len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))),
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        len(raw) - len(raw.translate(None, _UPPER + _LOWER)),
        sum(map(eq, words, words[1:])),
    )


def _counted(rows: DataFrame, column: str, field: str | None = None) -> DataFrame:
    """The rows with the struct column `__counts` of a text, which is a column or a field of one; one pass, no shuffle."""
    kind = StructType([StructField(c, LongType()) for c in COUNTS])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(column) if field is None else pc.struct_field(batch.column(column), [field])
        columns = list(zip(*(statistics(t or "") for t in texts.to_pylist()), strict=True)) or [[]] * len(COUNTS)
        made = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))
        return pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "__counts"])

    return map_texts(rows, column, run, StructType([*rows.schema.fields, StructField("__counts", kind)]))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with `__counts` and a hash of the text, `__seen`."""
    return _counted(docs.withColumn("__seen", F.xxhash64(F.col(text_col).cast("string"))), text_col)


def _share(above: str, below: str, counts: str) -> Column:
    a, b = F.col(f"{counts}.{above}"), F.col(f"{counts}.{below}")
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rule_statistics(counts: str = "__counts") -> dict[str, Column]:
    return {
        "symbol_share": _share("n_symbols", "word_chars", counts),
        "shout_share": _share("n_upper", "n_letters", counts),
        "repeat_share": _share("n_repeat_words", "n_words", counts),
        "dup_line_share": _share("n_dup_lines", "n_lines", counts),
        "word_length": _share("word_chars", "n_words", counts),
        "echo_share": _share("n_echo", "n_words", counts),
    }


def base_failed(counts: str = "__counts") -> Column:
    n = F.col(f"{counts}.n_words")
    return (n < 50) | (100 * F.col(f"{counts}.n_repeat_words") > 50 * n)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly term by term."""
    if k >= n:
        return 1.0
    at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(at(i)) for i in range(k + 1)))


def admissible(rejected: int, good: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound, at level delta, on the false rejection is at most risk."""
    if not good or rejected > risk * good:  # the bound is never below the observed share
        return False
    return binomial_cdf(rejected, good, risk) <= delta


STEPS: list[tuple[str, float]] = [(rule, c) for rule, ladder in RULES.items() for c in ladder]


def _trials(counted: DataFrame, labels: DataFrame, stratum: str, id_col: str) -> DataFrame:
    """(s, q, design, one column for each rule): the labelled rows that pass the base test, those of equal text once."""
    known = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("q"), F.max("quality").alias("__q")).filter("__id is not null and q = __q").select("__id", "q")
    stats = rule_statistics()
    rows = counted.filter(~base_failed()).select(F.col(id_col).alias("__id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s"), "__seen", F.struct(*[v.alias(k) for k, v in stats.items()]).alias("stats"))
    rows = rows.join(known, "__id").groupBy("s", "__seen").agg(F.min("q").alias("q"), F.max("q").alias("__q"), F.min(F.struct("__id", "stats")).alias("r")).filter("q = __q")
    return materialise(rows.select("s", "q", (remainder("r.__id", 2) == 0).alias("design"), "r.stats.*"), "calibration")


def calibrate(counted: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", risk: float = 0.03, confidence: float = 0.95) -> DataFrame:
    """(s, one column for each rule): the cutoff of each stratum and rule, null where none is admissible; a row for each stratum that has one."""
    rows = _trials(counted, labels, stratum, id_col)
    rejects = F.array(*[F.col(rule) > c for rule, c in STEPS])
    hits = rows.select("s", "q", "design", F.monotonically_increasing_id().alias("row"), F.posexplode(rejects).alias("j", "hit")).filter("hit")
    hits = materialise(hits.drop("hit"), "rejections")
    by = Window.partitionBy("s")
    path = hits.filter("design").groupBy("s", "j").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad")).filter("bad > 0")
    path = path.withColumn("pos", F.row_number().over(by.orderBy("good", F.desc("bad"), "j"))).select("s", "j", "pos")
    first = lambda on, steps: hits.filter(on).join(steps, ["s", "j"]).groupBy("s", "row").agg(F.min("pos").alias("pos"))
    # A step that rejects no bad text beyond those before it could only cost good ones.
    useful = path.join(first("design and q = 0", path).select("s", "pos").distinct(), ["s", "pos"])
    walk = materialise(useful.withColumn("pos", F.row_number().over(by.orderBy("pos"))), "walk")
    lost = first("not design and q = 1", walk).groupBy("s", "pos").agg(F.count("*").alias("lost"))
    sizes = rows.groupBy("s").agg(F.count_if("design").alias("designed"), F.count_if(~F.col("design") & (F.col("q") == 1)).alias("n"))
    strata = F.broadcast(sizes.filter("designed > 0").agg(F.count("*").alias("strata")))
    tested = walk.join(lost, ["s", "pos"], "left").join(sizes, "s").crossJoin(strata)
    tested = tested.withColumn("k", F.sum(F.coalesce("lost", F.lit(0))).over(by.orderBy("pos")))

    @F.pandas_udf("boolean")
    def holds(k: pd.Series, n: pd.Series, strata: pd.Series) -> pd.Series:
        return pd.Series([admissible(int(a), int(b), risk, (1 - confidence) / c) for a, b, c in zip(k, n, strata, strict=True)], dtype=bool)

    tested = tested.withColumn("ok", holds("k", "n", "strata")).withColumn("all_ok", F.min("ok").over(by.orderBy("pos")))
    number = {j: c for j, (_, c) in enumerate(STEPS)}
    cutoff = F.get(F.array(*[F.lit(c) for c in number.values()]), F.col("j"))
    of = lambda rule: F.min(F.when(F.get(F.array(*[F.lit(r) for r, _ in STEPS]), F.col("j")) == rule, cutoff)).alias(rule)
    return tested.filter("all_ok").groupBy("s").agg(*map(of, RULES))


def with_verdict(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang", counts: str = "__counts") -> DataFrame:
    """The rows with the flag `__kept`: whether they pass the base test and every cutoff of their stratum."""
    own = materialise(cutoffs.select(F.col("s").alias("__s"), F.struct(*RULES).alias("__cut")), "cutoffs")
    stats = rule_statistics(counts)
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | F.coalesce(stats[rule] > F.col(f"__cut.{rule}"), F.lit(False))
    joined = counted.join(own, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("__s"), "left")
    return joined.withColumn("__kept", ~base_failed(counts) & ~bad).drop("__s", "__cut")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = 0.03, confidence: float = 0.95) -> DataFrame:
    """The documents' ids, counts, `base_failed` and `kept`."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = materialise(with_counts(ids).drop("text"), "counts")
    cutoffs = calibrate(counted, labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality"), risk=risk, confidence=confidence)
    return with_verdict(counted, cutoffs).select("doc_id", "lang", *[F.col(f"__counts.{c}").alias(c) for c in COUNTS], base_failed().alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = 0.03, confidence: float = 0.95) -> DataFrame:
    """The documents, all columns as they were, that pass. For the calibration only texts with a label are counted: those are found
    by their ids alone, and no other text is shuffled or read twice by Python."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality is not null")
    held = marks(known.select(F.xxhash64("doc_id").alias("x")))
    labelled = marked(ids.withColumn("__h", F.xxhash64("doc_id")), "__h", materialise(held, "marks")).drop("__h")
    cutoffs = calibrate(with_counts(labelled).drop("text"), known, risk=risk, confidence=confidence)
    # The caller's row travels as one column, so that no name of its own can meet one of these.
    rows = docs.select(F.struct("*").alias("own"), F.col(stratum).cast("string").alias("lang"))
    return with_verdict(_counted(rows, "own", text_col), cutoffs).filter("__kept").select("own.*")
