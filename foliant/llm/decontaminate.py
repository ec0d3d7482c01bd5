"""Benchmark decontamination by Wu-Manber search over words.

The alphabet of the search is the word. A window is `window` consecutive words of a
benchmark item (a shorter item is one window). For each window length there is one
matcher with

* a shift table over blocks of two words, which tells how far the search may jump
  because no window can end before,
* buckets of windows under their last block, split by their first block, and
* a comparison of the whole window, which confirms an occurrence.

A word that no window holds lets the search jump over the whole window length, so that
clean text is read at about one word in ten.

Defined cases: a null or empty text has no words, no spans and no items. A null or
wordless item has no windows. Items with a null id are left out. Repeated rows are each
reported. Extra columns are ignored (`scan`) or kept (`drop_contaminated`).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.batches import bytes_of, id_and_text, kept, map_texts

#: Bytes of benchmark text behind one broadcast; a larger benchmark is searched in several passes.
SHARD_BYTES = 8 << 20

# A-Z become a-z; what is neither a digit, a letter nor beyond ASCII separates words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

SCAN_SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Matcher:
    """Wu-Manber tables for windows that all have `length` words, given as tuples of word numbers."""

    def __init__(self, length: int, windows: Iterable[tuple[int, ...]], base: int):
        self.length, self.base = length, base
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[int, ...]]]] = defaultdict(lambda: defaultdict(list))
        for w in windows:
            for end in range(self.block, length + 1):
                key = self._key(w, end - 1)
                jump = length - end
                if jump < self.shift.get(key, self.default):
                    self.shift[key] = jump
            self.buckets[self._key(w, length - 1)][self._key(w, self.block - 1)].append(w)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def _key(self, w, at: int) -> int:
        return w[at] if self.block == 1 else w[at - 1] * self.base + w[at]

    def find(self, words: list[bytes], number: dict[bytes, int]) -> list[tuple[int, tuple[int, ...]]]:
        """(first position, window) of every occurrence."""
        m, n, base, shift, default, buckets = self.length, len(words), self.base, self.shift, self.default, self.buckets
        get, found, at = number.get, [], self.length - 1
        while at < n:
            b = get(words[at])
            if b is None:
                at += m
                continue
            if m > 1:
                a = get(words[at - 1])
                if a is None:
                    at += m - 1
                    continue
                key = a * base + b
            else:
                key = b
            jump = shift.get(key, default)
            if jump:
                at += jump
                continue
            first = at - m + 1
            head = get(words[first])
            if head is not None:
                if m > 1:
                    second = get(words[first + 1])
                    head = -1 if second is None else head * base + second
                for w in buckets[key].get(head, ()):
                    if all(get(x) == y for x, y in zip(words[first : at + 1], w, strict=True)):
                        found.append((first, w))
            at += 1
        return found


class Windows:
    """The windows of some benchmark items, one matcher for each length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number)) for x in words_of(text))
            for at in range(max(1, len(w) - window + 1) if w else 0):
                self.items[w[at : at + window]].add(item)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in self.items:
            by_length[len(w)].append(w)
        self.matchers = [Matcher(k, v, len(self.number) + 1) for k, v in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that some window covers, merged, and the items they come from."""
        raw, items = [], set()
        for m in self.matchers:
            for first, w in m.find(words, self.number):
                raw.append((first, first + m.length - 1))
                items |= self.items[w]
        return merged(raw), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_BUILT: dict[str, Windows] = kept("decontaminate")


def _windows(token: str, items, window: int) -> Windows:
    """One set of tables for each worker process and broadcast; an older one is dropped."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Windows(items.value, window)
    return _BUILT[token]


def _shards(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcasts of (item, text) with about SHARD_BYTES of text each."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + total // SHARD_BYTES
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield context.broadcast([(r["item"], r["text"].encode()) for r in part.collect()])


def _pass(df: DataFrame, items, window: int) -> DataFrame:
    """Adds the occurrences of one broadcast of items to the columns spans and items."""
    token = uuid.uuid4().hex
    names = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = _windows(token, items, window)
        n_words, spans, found = [], [], []
        for text, old, had in zip(bytes_of(batch), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            words = words_of(text)
            s, i = tables.search(words)
            n_words.append(len(words))
            spans.append([{"first": a, "last": b} for a, b in merged(s + [(x["first"], x["last"]) for x in old])])
            found.append(sorted(i.union(had)))
        new = {
            "n_words": pa.array(n_words, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            "items": pa.array(found, pa.list_(pa.string())),
        }
        return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return map_texts(df, "text", run, df.schema, "decontaminate")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each document its number of words, the merged word ranges (0-based, both ends included)
    covered by benchmark windows, and the items they belong to, sorted as strings.

    The benchmark is read in shards of bounded size, each broadcast for one pass over the
    documents; passes follow each other row by row without a shuffle.
    """
    out = id_and_text(docs, id_col, text_col).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<first:long,last:long>>"), "items": F.array().cast("array<string>")})
    for items in _shards(benchmark, item_col, item_text_col):
        out = _pass(out, items, window)
    return out.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, in which no benchmark window occurs."""
    for items in _shards(benchmark, item_col, item_text_col):
        token = uuid.uuid4().hex

        def run(batch: pa.RecordBatch, token=token, items=items) -> pa.RecordBatch:
            tables = _windows(token, items, window)
            return batch.filter(pa.array([not tables.search(words_of(t))[1] for t in bytes_of(batch, text_col)], pa.bool_()))

        docs = map_texts(docs, text_col, run, docs.schema, "decontaminate")
    return docs
