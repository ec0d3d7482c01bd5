"""Ports for what the library does not contain: embedding models, answer models, document parsers.

A provider is made in the worker from a picklable factory, once for each process. The stubs
are deterministic and only serve wiring and tests; their vectors say nothing about quality.
"""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from foliant.config import DEFAULT, Settings
from foliant.shipping import ship


class Embedder(ABC):
    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """One unit vector for each text."""


class StubEmbedder(Embedder):
    """Hashed character trigrams at unit length."""

    def __init__(self, dim: int = DEFAULT.embed_dim):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for k in range(max(1, len(t) - 2)):
                row[int.from_bytes(hashlib.blake2b(t[k : k + 3].encode(), digest_size=4).digest(), "little") % self.dim] += 1
            size = np.linalg.norm(row)
            row /= size or 1
        return out


class AnswerProvider(ABC):
    """Three calls; the key is passed each time and never kept."""

    @abstractmethod
    def synthesise(self, prompt: str, api_key: str, max_tokens: int) -> str: ...

    @abstractmethod
    def classify(self, prompt: str, api_key: str, max_tokens: int) -> str: ...

    @abstractmethod
    def ground(self, prompt: str, api_key: str, max_tokens: int) -> tuple[str, str]:
        """The raw text and why it stopped."""


class StubProvider(AnswerProvider):
    """Cites the first source, calls everything prose, and finds every claim grounded."""

    def synthesise(self, prompt: str, api_key: str, max_tokens: int) -> str:
        return json.dumps({"answer": "Según la fuente [Fuente 1].", "cited_sources": [1] if "[Fuente 1]" in prompt else [], "confidence": 0.5})

    def classify(self, prompt: str, api_key: str, max_tokens: int) -> str:
        return json.dumps({"label": "prose", "confidence": 0.5, "subqueries": []})

    def ground(self, prompt: str, api_key: str, max_tokens: int) -> tuple[str, str]:
        return json.dumps({"claims": [{"claim": "x", "tipo": "sustantiva", "grounded": True, "supporting_source": 1}]}), "end_turn"


_MADE: dict[Callable, object] = {}


def made(factory: Callable):
    """What the factory makes, once for each worker process."""
    if factory not in _MADE:
        _MADE[factory] = factory()
    return _MADE[factory]


def embedded(rows: DataFrame, text_col: str = "content", factory: Callable[[], Embedder] = StubEmbedder, settings: Settings = DEFAULT) -> DataFrame:
    """The rows with the column `embedding`, in batches of the configured size."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(factory)
        for batch in batches:
            for at in range(0, batch.num_rows, settings.embed_batch):
                part = batch.slice(at, settings.embed_batch)
                v = model.embed([t or "" for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(v), pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def embed_query(text: str, factory: Callable[[], Embedder] = StubEmbedder) -> list[float]:
    """The vector of one query text, made where it is called."""
    return [float(x) for x in made(factory).embed([text])[0]]


def asked(prompts: DataFrame, call: str, api_key: str, factory: Callable[[], AnswerProvider] = StubProvider, settings: Settings = DEFAULT) -> DataFrame:
    """Rows (turn_id, prompt) answered: turn_id, raw_text, stop_reason, error.

    A claim check that stops at its token limit is asked once more with a larger one. A failing call gives
    the error `provider_error` and no text, and does not fail the query."""

    def one(model: AnswerProvider, prompt: str) -> tuple[str | None, str | None, str | None]:
        try:
            if call == "ground":
                text, stop = model.ground(prompt, api_key, settings.ground_tokens)
                if stop == "max_tokens":
                    text, stop = model.ground(prompt, api_key, settings.ground_tokens_retry)
                return text, stop, None
            ask = {"synthesise": (model.synthesise, settings.synthesis_tokens), "classify": (model.classify, settings.router_tokens)}[call]
            return ask[0](prompt, api_key, ask[1]), None, None
        except Exception:
            return None, None, "provider_error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(factory)
        for batch in batches:
            out = [one(model, p) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("turn_id"), *(pa.array([r[k] for r in out], pa.string()) for k in range(3))], ["turn_id", "raw_text", "stop_reason", "error"])

    if call not in ("synthesise", "classify", "ground"):
        raise ValueError(f"unknown call {call}")
    ship(prompts.sparkSession)
    return prompts.select("turn_id", "prompt").mapInArrow(run, "turn_id long, raw_text string, stop_reason string, error string")


class PageParser(ABC):
    """Reads one document's bytes: glyphs and boxes of its pages, and page images."""

    @abstractmethod
    def pages(self, content: bytes) -> Iterator[dict]:
        """Of each page: page_number, text, image (bytes or None), boxes and glyphs (lists of dicts)."""


class TextParser(PageParser):
    """Plain text in UTF-8: a form feed begins a page, each line is a block of one line across the page, below the margin."""

    def pages(self, content: bytes) -> Iterator[dict]:
        for number, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
            lines = page.split("\n")
            step = 500.0 / max(1, len(lines))
            boxes = [{"block_no": n, "pw": 600.0, "ph": 800.0, "x0": 40.0, "x1": 560.0, "y0": 150.0 + step * n, "y1": 150.0 + step * (n + 0.9)} for n in range(len(lines))]
            # White space is left out and found again from the gaps that it leaves.
            glyphs = [{"block_no": n, "line_no": 0, "glyph_no": g, "c": c, "x0": 5.0 * g, "x1": 5.0 * g + 5} for n, line in enumerate(lines) for g, c in enumerate(line) if not c.isspace()]
            yield {"page_number": number, "text": page, "image": None, "boxes": boxes, "glyphs": glyphs}


def parsed_pages(objects: DataFrame, factory: Callable[[], PageParser]) -> DataFrame:
    """A row (path, page_number, text, image) for each page of each object; a page without text stays, with the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = made(factory)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(path, p["page_number"], (p.get("text") or "").strip(), p.get("image")) for p in parser.pages(content)]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "page_number", "text", "image"])

    ship(objects.sparkSession)
    return objects.select("path", "content").mapInArrow(run, "path string, page_number int, text string, image binary")


#: Boxes and glyphs of pages that go out at once; as Python objects they take many times their Arrow form. A page goes out whole.
PARTS = 50_000


def parsed_layout(objects: DataFrame, factory: Callable[[], PageParser]) -> DataFrame:
    """A row (path, page, boxes, glyphs) for each page, as lists for the layout operators to explode."""
    boxes = "array<struct<block_no:int,pw:double,ph:double,x0:double,x1:double,y0:double,y1:double>>"
    glyphs = "array<struct<block_no:int,line_no:int,glyph_no:int,c:string,x0:double,x1:double>>"
    schema = f"path string, page int, boxes {boxes}, glyphs {glyphs}"
    numbers = lambda kind, *names: [(n, kind) for n in names]
    box = pa.struct([*numbers(pa.int32(), "block_no"), *numbers(pa.float64(), "pw", "ph", "x0", "x1", "y0", "y1")])
    glyph = pa.struct([*numbers(pa.int32(), "block_no", "line_no", "glyph_no"), ("c", pa.string()), *numbers(pa.float64(), "x0", "x1")])
    kinds = {"path": pa.string(), "page": pa.int32(), "boxes": pa.list_(box), "glyphs": pa.list_(glyph)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, held = made(factory), [], 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
            rows.clear()
            return batch

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for p in parser.pages(content.as_py()):
                    row = (path.as_py(), p["page_number"], p.get("boxes", []), p.get("glyphs", []))
                    rows.append(row)
                    held += 1 + len(row[2] or ()) + len(row[3] or ())
                    if held >= PARTS:
                        yield out()
                        held = 0
        if rows:
            yield out()

    ship(objects.sparkSession)
    return objects.select("path", "content").mapInArrow(run, schema)
