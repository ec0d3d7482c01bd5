"""SentencePiece (BPE) encoding and decoding, exact, without the library's merge loop.

Encoding is by backtracking over longest matches. A sequence of pieces is the merge
result of a text if and only if every two neighbours are: merging the characters of two
neighbours together again must give the same two pieces. So the encoder

* finds with an Aho-Corasick automaton the longest piece at each position (words of common characters are read
  backwards, many at once: the longest reversed piece that ends at a place is the longest piece that begins there),
* walks from left to right, taking the longest piece that is compatible with the piece
  before it, else the next shorter prefix of it that is a piece,
* steps back when none fits, and marks the position in a bit field so that it is never
  entered again.

Characters that no piece holds are pieces of their own and are written as byte pieces.
A text is first cut where its characters change between letters, spaces and others; spaces belong to what
follows. Hardly a piece joins two sides (checked when the model is read; texts with a letter of such a
piece are cut at spaces alone), so no merge crosses a cut. The different words of many texts are encoded
side by side, with array operations, and kept in a bounded table of each worker process.

Defined cases: a null or empty text has no ids and decodes to the empty text. Repeated
rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm import words as W
from foliant.llm.batches import bytes_of, id_and_text, kept, map_texts

SPACE = "▁"
#: Hardly a piece joins a letter with another character than spaces before it, so that segments can be cut there.
_LETTER = re.compile(r"[^\W\d_]")
_MIXED = re.compile(rf"[^\W\d_][\W\d_]|[^{SPACE}\w][^\W\d_]|[\d_][^\W\d_]")
_CLASSES = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}*[\d_]+(?:[\d_]|[^\w{SPACE}])*|{SPACE}*[^\w{SPACE}](?:[\d_]|[^\w{SPACE}])*|{SPACE}+").findall
#: Words whose ids a worker keeps; segments of texts that are cut at spaces alone.
CACHE_WORDS, CACHE_SEGMENTS = 160_000, 10_000
#: Bytes of text that are encoded together; the numbers in decimal and the bytes take about ten times as much.
SLICE = 1 << 19
#: Bits of the table of pairs of pieces whose compatibility a worker keeps; a later pair takes the place of an earlier one.
PAIR_BITS = 18
#: So few words are finished one by one.
FEW = 24
#: Characters that the table of the automaton knows, those of most pieces, and how long a word is read by it; others are read one by one.
TABLE_CHARS, TABLE_LENGTH = 112, 48

#: Stands for a control id between decoded bytes: never UTF-8, it ends a run of byte pieces.
_CUT = b"\xff\xff"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Pieces:
    """A SentencePiece BPE model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in model.pieces):
            raise ValueError("only BPE models with identity normalisation, a leading space and no user-defined pieces are known")
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece holds a space after another character")
        self.byte = [0] * 256
        #: By id, the bytes that a piece stands for when decoded; None for what is not text.
        self.raw: list[bytes] = []
        self.leads: list[bool] = []
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append(p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else model.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN else _CUT)
            self.leads.append(p.type == _NORMAL and p.piece.startswith(SPACE))
        #: Characters of the few pieces that do join the two classes; segments that hold one are not cut.
        mixed = {c for p in self.id if _MIXED.search(p) for c in p if _LETTER.match(c)}
        self.uncut = re.compile("[" + re.escape("".join(sorted(mixed))) + "]" if mixed else "(?!)").search
        #: Pieces that merging can produce from their own characters.
        reachable = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}
        self.piece = [p.piece for p in model.pieces]
        self.size = [len(p) for p in self.piece]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, self.id[p])
        self.automaton.make_automaton()
        self._tabulate(reachable)
        #: By id, the longest proper prefix that is a piece itself; -1 for none.
        self.shorter = [-1] * len(self.piece)
        for p in reachable:
            self.shorter[self.id[p]] = next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), -1)
        self.pairs, self.fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.sizes, self.shorts = np.array(self.size), np.array(self.shorter)
        #: Holds no piece, so that none is found across it.
        self.gap = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not any(c in p for p in self.id))
        letter = re.compile(r"[^\W\d_]").match
        self.classes = W.class_table(lambda c: W.SPACE if c == " " else W.UNSURE if c in mixed or c == SPACE else W.LETTER if letter(c) else W.OTHER)
        self.table = W.WordTable(CACHE_WORDS)
        self.ids = W.Payload(np.int32)
        #: By id, its number with a comma after it, and the bytes it stands for.
        self.digits, self.bytes = W.Payload(np.uint8), W.Payload(np.uint8)
        for held, of in ((self.digits, [b"%d," % i for i in range(len(self.piece))]), (self.bytes, self.raw)):
            held.append(np.frombuffer(b"".join(of), np.uint8), np.array([len(x) for x in of]))
        #: The same by known word.
        self.word_digits, self.word_bytes = W.Payload(np.uint8), W.Payload(np.uint8)
        self.segment = lru_cache(CACHE_SEGMENTS)(self._segment)

    def _tabulate(self, pieces: set[str]) -> None:
        """The automaton over the reversed pieces of common characters: by state and character the next state, by state the longest piece."""
        common = [c for c, _ in Counter(chain.from_iterable(map(sorted, map(set, sorted(pieces))))).most_common(TABLE_CHARS)]
        self.code = np.full(0x110000, 255, np.uint8)
        self.code[[ord(c) for c in common]] = np.arange(len(common))
        number = {c: k for k, c in enumerate(common)}
        below: list[dict[int, int]] = [{}]
        parent, char, own, levels = [0], [0], [-1], []
        for p in sorted(p for p in pieces if all(c in number for c in p)):
            at = 0
            for depth, c in enumerate(map(number.__getitem__, reversed(p))):
                node = below[at].get(c)
                if node is None:
                    node = below[at][c] = len(parent)
                    parent.append(at)
                    char.append(c)
                    own.append(-1)
                    below.append({})
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(node)
                at = node
            own[at] = self.id[p]
        parent, char, self.longest = np.array(parent), np.array(char), np.array(own)
        self.next, fail = np.zeros((len(parent), len(common)), np.uint16 if len(parent) < 1 << 16 else np.int32), np.zeros(len(parent), np.int64)
        levels = [np.zeros(1, np.int64), *map(np.array, levels)]
        for depth, nodes in enumerate(levels):
            if depth > 1:
                fail[nodes] = self.next[fail[parent[nodes]], char[nodes]]
            if depth:
                # What is next after a node's longest proper suffix is next after the node, unless it has a child there.
                self.next[nodes] = self.next[fail[nodes]]
                self.longest[nodes] = np.where(self.longest[nodes] < 0, self.longest[fail[nodes]], self.longest[nodes])
            for under in levels[depth + 1 : depth + 2]:
                self.next[parent[under], char[under]] = under

    def _longest(self, words: list[str], text: str, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest piece at each place of a text that holds words; -1 for none."""
        out = np.full(len(text) + 1, -1)
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        strange = np.append(0, np.cumsum(codes == 255))
        alone = (strange[stop] > strange[begin]) | (stop - begin > TABLE_LENGTH)
        for k in np.flatnonzero(alone).tolist():
            b = int(begin[k])
            for end, i in self.automaton.iter(words[k]):
                out[b + end - self.size[i] + 1] = i  # a later end at the same start is a longer piece
        order = np.flatnonzero(~alone)
        order = order[np.argsort(begin[order] - stop[order], kind="stable")]
        last, length = stop[order] - 1, stop[order] - begin[order]
        state = np.zeros(len(order), np.int64)
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k))
            at = last[:n] - k
            state = self.next[state[:n], codes[at]].astype(np.int64)
            out[at] = self.longest[state]
        return out

    def merge(self, text: str) -> list[str]:
        """Merges characters as the model orders it: best score first, the leftmost of equals. Slow; for short texts."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces together again gives the same two, for many pairs."""
        pair = left.astype(np.int64) << 20 | right
        at = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, lost = self.fits[at], np.flatnonzero(self.pairs[at] != pair)
        if len(lost):
            new, place, back = np.unique(pair[lost], return_index=True, return_inverse=True)
            names = [(self.piece[p >> 20], self.piece[p & 0xFFFFF]) for p in new.tolist()]
            fits = np.array([self.merge(a + b) == [a, b] for a, b in names], bool)
            at = at[lost[place]]
            self.fits[at], self.pairs[at] = fits, new
            # Two new pairs may have wanted one place.
            self.fits[at] = fits[np.searchsorted(new, self.pairs[at])]
            out[lost] = fits[back]
        return out

    def split(self, text: str) -> list[int]:
        """The ids of a normalised text, by backtracking; a character without a piece is -2 less its code point."""
        n, size, shorter = len(text), self.size, self.shorter
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(text):
            longest[end - size[i] + 1] = i  # a later end at the same start is a longer piece
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, last, take, fresh = 0, -1, longest[0], True
        while at < n:
            while take >= 0:
                end = at + size[take]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or self.fit(np.array([last]), np.array([take]))[0]):
                    break
                take = shorter[take]
            if take >= 0:
                out.append(take)
                last, at = take, end
                take, fresh = longest[at], True
            elif fresh and longest[at] < 0 and not failed[(at + 1) >> 3] >> ((at + 1) & 7) & 1:
                last = -2 - ord(text[at])  # no piece starts here: the character stands alone and joins nothing
                out.append(last)
                at += 1
                take = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last] if last >= 0 else 1
                take, fresh = (shorter[last] if last >= 0 else -1), False
                last = out[-1] if out else -1
        return out

    def split_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What `split` gives for each word, one after the other, and how much each has: all are walked side by side, a step of each at a time."""
        text = self.gap.join([*words, ""])
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begin = np.append(0, stop[:-1] + 1)[: len(stop)]
        longest = self._longest(words, text, begin, stop)
        none = -1
        chosen, ending = np.full(len(text) + 1, none), np.full(len(text) + 1, none)  # by first place, and by the place after
        failed = np.zeros(len(text) // 8 + 1, np.uint8)
        at, last, take, fresh = begin.copy(), np.full(len(words), none), longest[begin], np.ones(len(words), bool)
        live = np.flatnonzero(begin < stop)
        while len(live) > FEW:
            a, l, t = at[live], last[live], take[live]
            has = t >= 0
            end = a + np.where(has, self.sizes[t], 1)
            open_ = failed[end >> 3] >> (end & 7).astype(np.uint8) & 1 == 0
            ok = has & open_
            check = np.flatnonzero(ok & (l >= 0))
            ok[check] = self.fit(l[check], t[check])
            # No piece starts here: the character stands alone and joins nothing.
            alone = ~has & open_ & fresh[live] & (longest[a] < 0)
            go = ok | alone
            i, a1, e1 = live[go], a[go], end[go]
            t1 = np.where(alone[go], -2, t[go])
            chosen[a1] = ending[e1] = last[i] = t1
            at[i], take[i], fresh[i] = e1, longest[e1], True
            less = has & ~ok
            take[live[less]] = self.shorts[t[less]]
            back = ~has & ~alone
            i, a1, l1 = live[back], a[back], l[back]
            np.bitwise_or.at(failed, a1 >> 3, np.uint8(1) << (a1 & 7).astype(np.uint8))
            was = a1 - np.where(l1 >= 0, self.sizes[l1], 1)
            chosen[was] = ending[a1] = none
            at[i], take[i], fresh[i], last[i] = was, np.where(l1 >= 0, self.shorts[l1], -1), False, ending[was]
            live = live[at[live] < stop[live]]
        for i in live.tolist():
            own = np.array(self.split(words[i]))
            chosen[begin[i] : stop[i]] = none
            chosen[begin[i] + np.cumsum(np.append(0, np.where(own >= 0, self.sizes[own], 1)[:-1]))] = own
        marks = np.append(0, np.cumsum(chosen != none))
        places = np.flatnonzero(chosen != none)
        ids = chosen[places]
        for k in np.flatnonzero(ids < none).tolist():
            ids[k] = -2 - ord(text[places[k]])
        return ids, marks[stop] - marks[begin]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `split_many`, characters without a piece written as byte pieces."""
        ids, sizes = self.split_many(words)
        alone = np.flatnonzero(ids < 0)
        if len(alone):
            of = [[self.byte[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")] for i in ids[alone].tolist()]
            width = np.ones(len(ids), np.int64)
            width[alone] = [len(x) for x in of]
            ends, wide = np.append(0, np.cumsum(width)), np.repeat(ids, width)
            wide[W.ragged(ends[alone], width[alone])] = list(chain.from_iterable(of))
            bounds = np.append(0, np.cumsum(sizes))
            ids, sizes = wide, np.diff(ends[bounds])
        return ids, sizes

    def _segment(self, segment: str) -> list[int]:
        parts = [segment] if self.uncut(segment) else _CLASSES(segment)
        return self._ids_of(parts)[0].tolist()

    def encode(self, text: str) -> list[int]:
        """The ids of one text, cut at spaces."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return list(chain.from_iterable(map(self.segment, re.findall(f"{SPACE}+[^{SPACE}]*", text))))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the known words of some texts, one text after the other, how many words each has, and which
        texts were left out because they must be cut at spaces alone. The numbers hold until the next call."""
        kept = self.table.prune()
        if kept is not None:
            for held in (self.ids, self.word_digits, self.word_bytes):
                held.keep(kept)
        batch = W.Batch([b" " + t if t else t for t in texts], self.classes)
        flags = batch.unsure()
        first, size, counts = batch.words(W.class_runs(batch), flags)
        words, new = self.table.place(batch, first, size)
        if new:
            ids, sizes = self._ids_of([w.decode().replace(" ", SPACE) for w in new])
            self.ids.append(ids, sizes)
            bounds = np.append(0, np.cumsum(sizes))
            for held, of in ((self.word_digits, self.digits), (self.word_bytes, self.bytes)):
                flat, widths = of.take(ids)
                held.append(flat, np.diff(np.append(0, np.cumsum(widths))[bounds]))
        return words, counts, flags

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. Bytes that are not UTF-8 become U+FFFD, one for each byte."""
        ids = list(ids)
        # One leading space, that of the first piece that is not a control id, was added by the encoder.
        lead = next((i for i in ids if self.raw[i] != _CUT), None)
        return _text(b"".join(map(self.raw.__getitem__, ids)), lead is not None and self.leads[lead])


def _text(raw: bytes, lead: bool) -> str:
    raw = raw.replace(b" ", b"", 1) if lead else raw
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(map(_lenient, raw.split(_CUT)))


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            out.append("\ufffd")
            at += e.start + 1
    return "".join(out)


_MODELS: dict[str, Pieces] = kept("pieces")


def pieces(model_file: str) -> Pieces:
    """The model, read once by each worker process."""
    if model_file not in _MODELS:
        _MODELS[model_file] = Pieces(model_file)
    return _MODELS[model_file]


ENCODED_SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _bounds(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the arrays of each text begin, and the end of the last, if texts have so many words of such sizes."""
    return np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each text and the text decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = pieces(model_file), bytes_of(batch)
        words, counts, flags = model.words(texts)
        flat, sizes = model.ids.take(words)
        raw, widths = model.word_bytes.take(words)
        at, ends, joined = _bounds(counts, sizes), _bounds(counts, widths).tolist(), raw.tobytes()
        decoded = [_text(joined[a:b], flat[k] >= 0 and model.leads[flat[k]]) if b > a else "" for a, b, k in zip(ends, ends[1:], at)]
        ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
        if flags.any():
            alone = {int(k): model.encode(texts[k].decode()) for k in np.flatnonzero(flags)}
            ids = pa.array([alone.get(k, x) for k, x in enumerate(ids.to_pylist())], pa.list_(pa.int32()))
            decoded = [model.decode(alone[k]) if k in alone else x for k, x in enumerate(decoded)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_texts(id_and_text(docs, id_col, text_col), "text", run, ENCODED_SCHEMA, "pieces", SLICE)


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `encode` gives, as counts and SHA-256 digests made where the ids are: ids never leave the worker."""
    from hashlib import sha256

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = pieces(model_file), bytes_of(batch)
        words, counts, flags = model.words(texts)
        count = np.diff(_bounds(counts, model.ids.sizes[words])).tolist()
        digits, widths = model.word_digits.take(words)
        at, digits = _bounds(counts, widths).tolist(), digits.tobytes()
        left = [sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
        raw, widths = model.word_bytes.take(words)
        at, raw = _bounds(counts, widths).tolist(), raw.tobytes()
        firsts = np.append(0, np.cumsum(counts))[:-1]
        lead = [c > 0 and model.leads[model.ids.flat[model.ids.starts[words[k]]]] for k, c in zip(firsts.tolist(), counts.tolist())]
        right = [sha256(_text(raw[a:b], x).encode()).hexdigest() for a, b, x in zip(at, at[1:], lead)]
        for k in np.flatnonzero(flags).tolist():
            ids = model.encode(texts[k].decode())
            count[k] = len(ids)
            left[k] = sha256(",".join(map(str, ids)).encode()).hexdigest()
            right[k] = sha256(model.decode(ids).encode()).hexdigest()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(id_and_text(docs, id_col, text_col), "text", run, DIGEST_SCHEMA, "pieces", SLICE)
