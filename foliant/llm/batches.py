"""Arrow-batch plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from foliant.llm.session import prepare

#: Rows that one call of a batch function sees at most; bounds what a Python worker holds.
SLICE_ROWS = 2048
#: Bytes of text in one slice, beyond which it is cut further (a single text is never cut).
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds few rows and few bytes of `column`."""
    step = SLICE_ROWS
    if batch.num_rows:
        mean = batch.column(column).nbytes / batch.num_rows
        step = max(1, min(SLICE_ROWS, int(most / max(mean, 1))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


#: What worker processes keep between tasks, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str, held: dict | None = None) -> dict:
    """A dict for what an operator keeps between the tasks of a worker process; one with several names them operator:what."""
    return _KEPT.setdefault(operator, {} if held is None else held)


def keep_only(operator: str) -> None:
    """Drops what other operators keep in this process, so that the stages of a pipeline do not add up their memory."""
    others = [held for name, held in _KEPT.items() if name.partition(":")[0] != operator and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        tidy()


def tidy() -> None:
    """Gives what was freed back to the system, where the C library can do so: a worker stays after its task, and what it holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def python_stage(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, operator: str = "") -> DataFrame:
    """`mapInArrow` for workers that have this package, wherever the driver found it; of what workers keep only the operator's own stays."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(operator)
        yield from run(batches)
        tidy()

    prepare(df.sparkSession)
    return df.mapInArrow(alone, schema)


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, operator: str = "", most: int = SLICE_BYTES) -> DataFrame:
    """Runs `fn` over slices of Arrow batches. No shuffle, nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                yield fn(part)

    return python_stage(df, run, schema, operator)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that most operators need, under fixed names and types."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)
