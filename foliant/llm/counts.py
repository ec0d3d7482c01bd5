"""Token counts by a two-tier lookup on the map side.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then encodes each alone,
so the count of a text is the sum of its pre-tokens' counts. The first tier is a broadcast
table of the most frequent pre-tokens and their counts, of bounded size: a pre-token is two
numbers of eight bytes, so that the table is three arrays. Misses go to the second tier, a bounded
table in each worker process, filled by the tokenizer itself in batches.

The table is made from all rows: each task keeps a Misra-Gries summary of bounded size
(after a prune every count is lowered by the largest one dropped) and the summaries, not the
pre-tokens, are merged in a tree. It only decides what is fast, never a result.

Defined cases: a null or empty text has no bytes and no tokens. Strings of special tokens
inside a text count as the library counts them by default. Texts with characters on whose
class the pattern library and the tokenizer may differ, or with special strings, are given
whole to the tokenizer. Repeated rows are each counted; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm import words as W
from foliant.llm.batches import bytes_of, id_and_text, kept, map_texts, python_stage, slices

#: Pre-tokens in the broadcast table.
FREQUENT = 32_768
#: Pre-tokens that a worker keeps; beyond, half of them go, those not used for longest.
CACHE = 250_000
#: Words that are encoded in one text.
JOINED = 128

# What the split pattern of byte-level BPE vocabularies of this kind calls letters, numbers and white
# space, and the characters outside which Unicode versions of the two libraries may disagree.
_LETTER, _NUMBER, _BLANK = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\s"))
_UNSURE = re.compile("[^\x00-\u0557\u0590-\u088e\u0890-\u0c5b\u0c5d-\u0cdb\u0cdd-\u208e\u2090-\u209c\u20a0-\ua7cd\ua7f2-\uab6b\uab6e-\ud7ff\ue000-\uffff\U0001f000-\U0002b738]").match


def character_class(c: str) -> int:
    if _UNSURE(c):
        return W.UNSURE
    return W.SPACE if c == " " else W.BLANK if _BLANK(c) else W.LETTER if _LETTER(c) else W.NUMBER if _NUMBER(c) else W.OTHER


class ByteBpe:
    """A byte-level BPE tokenizer file and the caches of one worker process."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normaliser or a leading space is known")
        self.tokenizer = Tokenizer.from_file(file)
        m = spec["model"]
        if not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            # The model without its own cache, which only costs where each word is encoded once.
            self.tokenizer.model = BPE(m["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]], cache_capacity=0)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: By id, whether the token begins with a space.
        self.leads = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.leads[[i for t, i in spec["model"]["vocab"].items() if t[0] == "\u0120"]] = True
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        special = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        self.special = re.compile(b"|".join(special) if special else rb"(?!)").search
        self.classes = W.class_table(character_class)
        self.table, self.ids = W.WordTable(CACHE), W.Payload(np.int32)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, texts: list[bytes]) -> tuple[W.Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts joined, the first places and sizes of their pre-tokens, how many each has, and which must be given whole to the tokenizer."""
        batch = W.Batch(texts, self.classes)
        flags = batch.unsure() | np.fromiter((self.special(t) is not None for t in texts), bool, len(texts))
        return batch, *batch.words(W.byte_bpe_runs(batch), flags), flags

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pre-tokens, one after the other, and how many each has.

        Many are encoded in one text. Those that begin with a space follow each other: where a token begins with a
        space, the next begins. Others are put on lines of their own, and white space is encoded alone."""
        kinds = np.fromiter((2 if w.isspace() else w[0] != " " for w in words), np.int64, len(words))
        flats, sizes, owners = [], [], []
        rest = np.flatnonzero(kinds == 2).tolist()
        for kind, after in ((0, ""), (1, "\n")):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            parts = [own[k : k + JOINED] for k in range(0, len(own), JOINED)]
            found = self.encode_all([after.join([words[k] for k in p.tolist()] + [""]) for p in parts])
            width = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(width.sum()))
            marks = ids == self.newline if kind else self.leads[ids]
            part = np.repeat(np.arange(len(parts)), width)
            good = np.bincount(part, marks, len(parts)) == [len(p) for p in parts]
            rest += chain.from_iterable(parts[k].tolist() for k in np.flatnonzero(~good))
            ids, marks = ids[good[part]], marks[good[part]]
            at = np.flatnonzero(marks)
            flats.append(ids[~marks] if kind else ids)
            sizes.append(np.diff(at, prepend=-1) - 1 if kind else np.diff(np.append(at, len(ids))))
            owners.append(np.concatenate([p for p, g in zip(parts, good) if g] or [own[:0]]))
        found = self.encode_all([words[k] for k in rest])
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        flats.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        flat, size, owner = np.concatenate(flats), np.concatenate(sizes), np.concatenate([*owners, np.array(rest, np.int64)])
        back = np.argsort(owner)
        return flat[W.ragged((np.cumsum(size) - size)[back], size[back])], size[back]

    def numbers(self, batch: W.Batch, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of pre-tokens in this worker's table, into which new ones come. They hold until the next `prune`."""
        out, new = self.table.place(batch, first, size)
        if new:
            self.ids.append(*self.encode_words([w.decode() for w in new]))
        return out

    def prune(self) -> None:
        kept = self.table.prune()
        if kept is not None:
            self.ids.keep(kept)

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has."""
        self.prune()
        batch, first, size, counts, flags = self.cut(texts)
        flat, sizes = self.ids.take(self.numbers(batch, first, size))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        if flags.any():
            parts = np.split(flat, ends[:-1])
            for k, ids in zip(np.flatnonzero(flags).tolist(), self.encode_all([texts[k].decode() for k in np.flatnonzero(flags)]), strict=True):
                parts[k] = np.asarray(ids, np.int32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, np.diff(ends, prepend=0)


_MODELS: dict[str, ByteBpe] = kept("counts")


def model(file: str) -> ByteBpe:
    """The tokenizer, read once by each worker process."""
    if file not in _MODELS:
        _MODELS[file] = ByteBpe(file)
    return _MODELS[file]


class Summary:
    """Counts of words of at most 16 bytes, as two numbers each."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, counts: np.ndarray):
        self.k1, self.k2, self.counts = k1, k2, counts

    def pruned(self, size: int) -> Summary:
        """A Misra-Gries summary: the `size` largest counts, lowered by the largest count left out."""
        if len(self.counts) <= size:
            return self
        order = np.lexsort((self.k2, self.k1, -self.counts))
        top, floor = order[:size], self.counts[order[size]]
        top = top[self.counts[top] > floor]
        return Summary(self.k1[top], self.k2[top], self.counts[top] - floor)

    def plus(self, other: Summary) -> Summary:
        k1, k2, counts = (np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("k1", "k2", "counts"))
        order = np.lexsort((k2, k1))
        k1, k2 = k1[order], k2[order]
        head = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[: len(k1)])
        return Summary(k1[head], k2[head], np.add.reduceat(counts[order], head) if len(head) else counts)

    def words(self) -> list[str]:
        return [w.decode() for w in np.stack([self.k1, self.k2], axis=1).astype("<u8").reshape(-1).view("S16").tolist()]


def _summary(bpe: ByteBpe, batches: Iterator[pa.RecordBatch], size: int) -> Summary:
    """Of all pre-tokens of at most 16 bytes of some batches, in bounded memory."""
    table, counts, total = W.WordTable(8 * size), np.zeros(0, np.int64), Summary(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)))
    for batch in batches:
        for part in slices(batch, "text"):
            joined, first, length, *_ = bpe.cut(bytes_of(part))
            short = length <= W.SHORT
            numbers, _ = table.place(joined, first[short], length[short])
            counts = np.append(counts, np.zeros(table.size - len(counts), np.int64)) + np.bincount(numbers, minlength=table.size)
            if table.size > table.most:
                k1, k2, number = table.short_words()
                total = total.plus(Summary(k1, k2, counts[number])).pruned(size)
                table, counts = W.WordTable(8 * size), counts[:0]
    k1, k2, number = table.short_words()
    return total.plus(Summary(k1, k2, counts[number])).pruned(size)


def frequent(texts: DataFrame, file: str, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pre-tokens of all rows, at most `size`, as two numbers each, with their token counts."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _summary(model(file), batches, size)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (s.k1, s.k2, s.counts)], ["k1", "k2", "counts"])

    rows = python_stage(texts.select("text"), summary, "k1 binary, k2 binary, counts binary", "counts").rdd
    parts = rows.map(lambda r: Summary(np.frombuffer(r["k1"], np.uint64), np.frombuffer(r["k2"], np.uint64), np.frombuffer(r["counts"], np.int64)))
    total = parts.treeReduce(lambda a, b: a.plus(b).pruned(size), depth=3)
    return total.k1, total.k2, model(file).encode_words(total.words())[1]


_FIRST: dict[str, W.WordTable] = kept("counts:first")


def _first_tier(token: str, k1: np.ndarray, k2: np.ndarray) -> W.WordTable:
    """The broadcast table, built once by each worker process."""
    if token not in _FIRST:
        _FIRST.clear()
        _FIRST[token] = W.WordTable(len(k1))
        _FIRST[token].enter(k1, k2)
    return _FIRST[token]


COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", frequent_size: int = FREQUENT) -> DataFrame:
    """The bytes (UTF-8) and tokens of each text, without added begin or end tokens."""
    texts = id_and_text(docs, id_col, text_col)
    table, token = docs.sparkSession.sparkContext.broadcast(frequent(texts, file, frequent_size)), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = model(file), bytes_of(batch)
        k1, k2, tokens = table.value
        bpe.prune()
        joined, first, size, counts, flags = bpe.cut(rows)
        found = _first_tier(token, k1, k2).find(joined, first, size)
        missed = found < 0
        n = np.where(missed, 0, tokens[found] if len(tokens) else 0)
        numbers = bpe.numbers(joined, first[missed], size[missed])
        n[missed] = bpe.ids.sizes[numbers]
        n_tokens = np.diff(np.append(0, np.cumsum(n))[np.cumsum(counts)], prepend=0)
        whole = np.flatnonzero(flags)
        n_tokens[whole] = [len(i) for i in bpe.encode_all([rows[k].decode() for k in whole])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, rows)), pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return map_texts(texts, "text", run, COUNT_SCHEMA, "counts")
