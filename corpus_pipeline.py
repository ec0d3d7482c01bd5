"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame, which is written and read again as the next one's documents. All but the
last return the columns of documents.

Defined cases, at every stage: a null or empty text fails the base test and goes at the first stage; later stages
given one keep it (line dedup, decontamination), keep one of each id (near duplicates: they are no copies of each other), and encode it to no ids.
Repeated rows (equal id and text) are judged alike, and near duplicates leaves one of them, defined by the other columns. Rows with a null id
come after all others. Ties go to the smaller id, then the smaller hash of the text. Empty tables stay empty; extra columns are
kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, jaccard, linededup, pieces, rules
from foliant.llm.queries import table, tokenizer_file
from foliant.llm.storage import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a risk-controlled rule of their language rejects go."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go, short ones if they equal one, as do documents left without any line."""
    return linededup.drop_repeats(docs, short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more one document stays."""
    return jaccard.one_of_each(docs, percent=80, size=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def sentencepiece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text that is left, and the text decoded from them."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_coding", sentencepiece_coding),
]

#: Backtracking merges, exact binomial bounds and edit distances are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
