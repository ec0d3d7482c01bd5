"""Workbooks (.xlsx) as a Spark data source: one row for each cell.

    ship(spark)
    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load(path)

A workbook is a zip of XML parts; cached values are read, formulas are not. Rows hold all cells up
to the last one that is written, empty ones with null, so that a row's length is known.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from io import BytesIO
from typing import IO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from foliant.shipping import ship

CELL_SCHEMA = "wb_id long, sheet_no int, sheet string, row_no int, col_no int, v string, v_type string"
# The namespaces of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(node: ET.Element) -> str:
    """The text of an item, of all its runs but not of phonetic hints."""
    return "".join(t.text or "" for r in node if r.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([r] if r.tag == f"{_MAIN}t" else r.findall(f"{_MAIN}t")))


class Workbook:
    """An open workbook: its sheets by name, and the cells of each, read row by row."""

    def __init__(self, file: IO[bytes]):
        self.zip = zipfile.ZipFile(file)
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        #: (name, part of the zip, bytes of it) of each sheet, in order.
        self.sheets = []
        for sheet in ET.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            part = target if target.startswith("xl/") else f"xl/{target}"
            self.sheets.append((sheet.get("name"), part, self.zip.getinfo(part).file_size))

    @cached_property
    def shared(self) -> list[str]:
        """Texts that cells name by number; read when a sheet is."""
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        with self.zip.open("xl/sharedStrings.xml") as f:
            return [_texts(si) for si in _items(f, "si")]

    def cells(self, sheet_no: int) -> Iterator[tuple[int, str, int, int, str | None, str | None]]:
        """(sheet_no, sheet, row_no, col_no, value, type) of one sheet; a row at a time is in memory, besides the shared texts."""
        name, part, _ = self.sheets[sheet_no]
        following = 0
        with self.zip.open(part) as f:
            for row in _items(f, "row"):
                row_no = int(row.get("r", following + 1)) - 1
                following = row_no + 1
                at = 0
                for c in row.iter(f"{_MAIN}c"):
                    col = _column(c.get("r")) if c.get("r") else at
                    for k in range(at, col):
                        yield sheet_no, name, row_no, k, None, None
                    at = col + 1
                    yield (sheet_no, name, row_no, col, *_value(c, self.shared))


def _items(file: IO[bytes], name: str) -> Iterator[ET.Element]:
    """The elements of a name that follow each other in a part, each forgotten after its use."""
    above: list[ET.Element] = []
    for event, node in ET.iterparse(file, ("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if node.tag == f"{_MAIN}{name}":
            yield node
            above[-1].clear()


def cells(content: bytes) -> Iterator[tuple[int, str, int, int, str | None, str | None]]:
    """(sheet_no, sheet, row_no, col_no, value, type) in workbook order."""
    book = Workbook(BytesIO(content))
    for sheet_no in range(len(book.sheets)):
        yield from book.cells(sheet_no)


def _value(c: ET.Element, shared: list[str]) -> tuple[str | None, str | None]:
    kind, raw = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return _texts(c.find(f"{_MAIN}is")), "string"
    if raw is None or kind == "e":
        return None, None
    if kind == "s":
        return shared[int(raw)], "string"
    if kind == "b":
        return str(raw == "1"), "bool"
    if kind == "n":
        number = float(raw)
        return (str(int(number)), "int") if re.fullmatch(r"-?\d+", raw) else (repr(number), "float")
    return raw, "string"


class WorkbookSource(DataSource):
    """Workbooks under `path` (a file, or a folder of .xlsx files); wb_id numbers them in order of name.

    Each sheet is a task of its own. With the option pushdown=true, for sessions with spark.sql.python.filterPushdown.enabled, a filter
    on `sheet` (= or IN) keeps other sheets from being opened."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (_PushingReader if pushing else _Reader)(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = self._store()
        files = [base] if store.get_file_info(base).is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".xlsx"))

        def sheets(file: str) -> list[str]:
            """Only the list of sheets is read, from the end of the file and one small part."""
            with store.open_input_file(file) as f:
                return [name for name, _, _ in Workbook(f).sheets]

        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(sheets, files))
        return [InputPartition((wb, file, n)) for wb, (file, names) in enumerate(zip(files, found, strict=True)) for n, name in enumerate(names) if self.wanted is None or name in self.wanted]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no sheet is wanted
            return
        number, file, sheet_no = partition.value
        with self._store()[0].open_input_file(file) as f:
            for row in Workbook(f).cells(sheet_no):
                yield (number, *row)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("sheet",):
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f


def cells_of(objects: DataFrame) -> DataFrame:
    """The cells of workbooks read as objects (path, content), from any store that Spark reads; wb_id is a hash of the path."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wb, content in zip(batch.column("wb_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(wb, *r) for r in cells(content)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CELL_SCHEMA.split(", ")])

    ship(objects.sparkSession)
    return objects.select(F.xxhash64("path").alias("wb_id"), "content").mapInArrow(run, CELL_SCHEMA)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def salary_tables(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From workbooks as objects (path, content) to typed salary rows and to what was done with each sheet, both with the workbook's path."""
    from pyspark.sql import functions as F

    from foliant.operators import salary

    found, paths = cells_of(objects), objects.select(F.xxhash64("path").alias("wb_id"), "path")
    return salary.rows(found).join(paths, "wb_id"), salary.warnings(found).join(paths, "wb_id")
