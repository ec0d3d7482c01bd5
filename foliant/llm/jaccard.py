"""N-gram Jaccard join: which texts share most of their word shingles, and the groups they form.

Two documents link when |A & B| / |A | B| of their sets of shingle hashes (64 bits) is at
least `percent` / 100. The join is exact; documents with equal sets are one class from the
first step on, so copies cost nothing more.

1. One pass makes each text's set. Documents are packed in chunks, written once.
2. A set A can miss at most |A| - T of its shingles in a partner, T = ceil(percent |A| / 100).
   So what matters is which shingles occur in another class at all. Chunks post the hashes
   below a fixed share of the hash space (all of them for small sets) to buckets; a bucket sees
   each shingle once per chunk, however frequent, and answers each chunk with how common
   its shingles are. Documents with more lonely shingles than |A| - T have no partner.
3. The others need to meet only on a prefix of |A| - T + 1 shingles in one common order,
   rarest first. Components over shared prefix shingles are blocks; where a component is large and
   the classes that share one shingle are few beside it, its shingles are blocks instead.
4. Large blocks are cut into sub-blocks of bounded size, by classes of set sizes (only
   neighbouring ones can link) and at random in them. Two sub-blocks meet in a task of their own, where a
   T-occurrence search runs for each document: DivideSkip takes the longest inverted lists
   apart, merges the short ones, and probes the long ones by binary search for candidates
   only. A task returns the links of a spanning forest, never all pairs of a group.
5. Components of all links are the groups.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing. A text with fewer words than a shingle has its whole word sequence as the only
one. Repeated rows are in the same group. A null id is never a group's id unless all ids of the group are null. Extra columns
are ignored (`groups`) or kept (`one_of_each`).
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.batches import bytes_of, kept, python_stage, slices, tidy
from foliant.llm.graph import components
from foliant.llm.marks import marks, with_mark
from foliant.llm.session import prepare
from foliant.llm.storage import materialise

SIZE, PERCENT = 4, 85
#: Share of the hash space whose shingles are posted; sets up to SMALL_POST shingles are posted whole,
#: and those up to SMALL_TEST (whose partners are posted whole) are tested whole.
THETA = np.uint64(int(0.35 * 2**64))
SMALL_TEST = 64
#: Postings in a bucket and in a sub-block, on average.
BUCKET, SUB_BLOCK = 1 << 19, 120_000
#: Bytes of text in a chunk (a single text is never cut); its row stays well below what the JVM treats as huge.
CHUNK_BYTES = 512 << 10
#: Bits of the filter that spares texts without a candidate a second reading; of fixed size.
FILTER_BITS = 1 << 26
#: Words whose hash a worker keeps; a full cache is emptied.
CACHE = 100_000

_M = np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = kept("jaccard", _Hashes())


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = text.translate(_UPPER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    k = min(size, n)
    h = w[: n - k + 1] ^ np.uint64(k)
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _M + w[i : n - k + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * _M
    return np.unique(h ^ (h >> np.uint64(29)))


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n shingles has with any partner, at least."""
    return -(-percent * n // 100)


def _posted(s: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    if n * percent <= SMALL_TEST * 100:
        return s
    low = s[: np.searchsorted(s, THETA)]
    return low if len(low) > n - needed(n, percent) else s


def _chunks(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: its documents' ids, text keys, set sizes, classes (128-bit hash of the set) and posted shingles."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                sets = [shingles(t, size) for t in bytes_of(part)]
                posted = [_posted(s, percent) for s in sets]
                names = ["chunk", "ids", "keys", "n", "posted", "cls", "hashes"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().int >> 65], pa.int64()),
                        pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.column("key").to_pylist()], pa.list_(pa.int64())),
                        pa.array([[len(s) for s in sets]], pa.list_(pa.int32())),
                        pa.array([[len(p) for p in posted]], pa.list_(pa.int32())),
                        pa.array([[xxhash.xxh3_128_digest(s.tobytes()) for s in sets]], pa.list_(pa.binary())),
                        pa.array([np.concatenate([*posted, np.empty(0, np.uint64)]).tobytes()], pa.binary()),
                    ],
                    names,
                )

    return python_stage(rows, run, "chunk long, ids array<long>, keys array<long>, n array<int>, posted array<int>, cls array<binary>, hashes binary", "jaccard")


def _row_by_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows as dicts; a chunk is large, so one of them is in memory at a time."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _postings(row: dict, buckets: int) -> tuple[np.ndarray, ...]:
    """Of a chunk, in order of (bucket, hash): bucket, hash, a class that has it, and whether more than one has.
    Then the place in that order of each shingle as posted."""
    h = np.frombuffer(row["hashes"], np.uint64)
    of = np.frombuffer(b"".join(c[:8] for c in row["cls"]), np.uint64) if row["cls"] else np.empty(0, np.uint64)
    cls = np.repeat(of, row["posted"])
    u, at, inv = np.unique(h, return_index=True, return_inverse=True)
    first = cls[at]
    many = np.bincount(inv, cls != first[inv], len(u)) > 0
    bucket = (u * _M >> np.uint64(33)) % np.uint64(buckets)
    order = np.lexsort((u, bucket))
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return bucket[order].astype(np.int64), u[order], first[order], many[order], place[inv]


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, as six planes of bytes."""
    return x.view(np.uint8).reshape(-1, 8)[:, :6].T


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :6] = raw.T
    return out.reshape(-1).view(np.uint64)


def _post(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _row_by_row(batch):
                bucket, h, cls, many, _ = _postings(row, buckets)
                ids, starts = np.unique(bucket, return_index=True)
                ends = np.append(starts, len(bucket))[1:]
                load = [np.concatenate([_six(h[a:b]), _six(cls[a:b]), many[None, a:b].astype(np.uint8)]).tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([row["chunk"]] * len(ids), pa.int64()), pa.array(load, pa.binary())], ["bucket", "chunk", "load"])

    return python_stage(chunks.select("chunk", "posted", "cls", "hashes"), run, "bucket long, chunk long, load binary", "jaccard")


def _answer(group: pa.Table) -> pa.Table:
    """For each posting of a bucket a byte: 0 if one class alone has the shingle, else how common it is, on a logarithmic scale."""
    raw = [np.frombuffer(x, np.uint8).reshape(13, -1) for x in group.column("load").to_pylist()]
    all_ = np.concatenate(raw, axis=1)
    h, cls, many = _from_six(all_[:6]), _from_six(all_[6:12]), all_[12]
    u, at, inv, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    shared = np.bincount(inv, (many > 0) | (cls != cls[at][inv]), len(u)) > 0
    code = np.where(shared, np.clip(16 * np.log2(count + np.bincount(inv, many, len(u))), 1, 255), 0).astype(np.uint8)[inv]
    ends = np.cumsum([r.shape[1] for r in raw])
    load = [code[e - r.shape[1] : e].tobytes() for r, e in zip(raw, ends, strict=True)]
    tidy()
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "codes": pa.array(load, pa.binary())})


def _candidates(chunks: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """(cls, n, key, keys): the classes that may have a partner, with the size of the set and the shingles of its prefix."""
    joined = chunks.select("chunk", "keys", "n", "posted", "cls", "hashes", "buckets").join(answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("answers")), "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _row_by_row(batch):
                codes = np.frombuffer(b"".join(a["codes"] for a in row["answers"]), np.uint8)
                place = _postings(row, row["buckets"])[4]
                h = np.frombuffer(row["hashes"], np.uint64)
                own, at = codes[place], 0
                cls, sizes, text_keys, keys = [], [], [], []
                for k, (n, m) in enumerate(zip(row["n"], row["posted"], strict=True)):
                    s, c = h[at : at + m], own[at : at + m]
                    at += m
                    if not n:
                        continue
                    may_miss = n - needed(n, percent)
                    low = s < THETA
                    tested = c if n <= SMALL_TEST else c[low]
                    if (tested == 0).sum() > may_miss:
                        continue
                    # Common order: below THETA rarest first, then the rest by hash.
                    order = np.lexsort((s, np.where(low, c, 0), ~low))[: may_miss + 1]
                    order = order[(c[order] > 0) | ~low[order]]
                    cls.append(row["cls"][k])
                    sizes.append(n)
                    text_keys.append(row["keys"][k])
                    keys.append(s[order].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sizes, pa.int32()), pa.array(text_keys, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["cls", "n", "key", "keys"])

    return python_stage(joined, run, "cls binary, n int, key long, keys array<long>", "jaccard")


def _filter_of(keys: DataFrame) -> bytes:
    """A bit filter of fixed size that holds every value of the column `key`."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for at in _bits(batch.column("key").to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)])], ["bits"])

    def both(a: bytes, b: bytes) -> bytes:
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        return zlib.compress((a | b).tobytes(), 1)

    return python_stage(keys, bits, "bits binary", "jaccard").rdd.map(lambda r: bytes(r["bits"])).treeReduce(both, depth=3)


def _bits(keys: np.ndarray) -> list[np.ndarray]:
    k = keys.astype(np.int64).view(np.uint64) * _M
    return [((k >> np.uint64(s)) % np.uint64(FILTER_BITS)).astype(np.int64) for s in (3, 21)]


def _sets(docs: DataFrame, found: DataFrame, size: int, text_col: str) -> DataFrame:
    """(cls, hashes) of the candidate classes, from a second reading of the texts. The filter spares most texts; the join with the classes is what decides."""
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(found.select("key")))
    text = F.col(text_col).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(held.value), np.uint8)
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for at in _bits(batch.column("key").to_numpy(zero_copy_only=False)):
                hit &= bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            for part in slices(batch.filter(pa.array(hit)), "text"):
                sets = [shingles(t, size) for t in bytes_of(part)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "hashes"])

    rows = python_stage(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), run, "cls binary, hashes binary", "jaccard")
    one = rows.groupBy("cls").agg(F.first("hashes").alias("hashes"))
    return one.join(found.select("cls").distinct(), "cls", "left_semi")


class Lists:
    """Inverted lists over the sets of a sub-block."""

    def __init__(self, sets: list[np.ndarray]):
        self.docs = len(sets)
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(self.docs), self.n)
        order = np.argsort(flat, kind="stable")
        self.keys, self.starts, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner = owner[order]
        #: (list, document) as one number, ascending: what binary probes look in.
        self.probe = np.repeat(np.arange(len(self.keys)), self.counts) * max(1, self.docs) + self.owner

    def search(self, s: np.ndarray, least: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """DivideSkip: the allowed documents that share at least `least` elements with s, and how many they share."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.keys, s)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == s)] if len(self.keys) else at[:0]
        if len(at) < least:
            return none
        at = at[np.argsort(self.counts[at], kind="stable")]
        # The longest lists that are left out of the merge: with L of them a document must be in least - L short ones.
        longest = int(self.counts[at[-1]])
        n_long = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        short, long_ = at[: len(at) - n_long], at[len(at) - n_long :]
        sizes = self.counts[short]
        ends = np.cumsum(sizes)
        merged = self.owner[np.repeat(self.starts[short] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        count = np.bincount(merged, minlength=self.docs)
        found = np.flatnonzero((count >= least - n_long) & allowed)
        if not len(found):
            return none
        share = count[found]
        if n_long:
            wanted = (long_[:, None] * self.docs + found[None, :]).ravel()
            place = np.minimum(np.searchsorted(self.probe, wanted), len(self.probe) - 1)
            share = share + (self.probe[place] == wanted).reshape(n_long, -1).sum(0)
        keep = share >= least
        return found[keep], share[keep]


def links(index: list[np.ndarray], queries: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links (document of the index, document of the queries) that connect all that are connected.
    Without queries the documents of the index are searched among each other."""
    lists = Lists(index)
    n = len(index)
    own = queries is None
    group = np.arange(n + (0 if own else len(queries)))
    out = []
    for q, s in enumerate(index if own else queries):
        node = q if own else n + q
        size = len(s)
        least = needed(size, percent)
        allowed = (lists.n >= least) & (percent * lists.n <= 100 * size) & (group[:n] != group[node])
        if own:
            allowed[q:] = False
        if not allowed.any():
            continue
        found, share = lists.search(s, least, allowed)
        for d in found[100 * share >= percent * (size + lists.n[found] - share)]:
            if group[d] != group[node]:
                out.append((int(d), q))
                group[group == group[d]] = group[node]
    return out


def _work(load: Column) -> Column:
    """What a block of so many shingles costs, if its sub-blocks meet."""
    return load * (1 + F.ceil(load / SUB_BLOCK))


def _blocks(found: DataFrame) -> DataFrame:
    """(cls, n, block): the classes that must meet, some in several blocks."""
    keys = materialise(found.select("cls", "n", F.explode("keys").alias("h")).distinct(), "keys")
    lead = keys.groupBy("h").agg(F.min("cls").alias("b"), F.count("*").alias("c")).filter("c > 1").select("h", "b")
    shared = materialise(keys.join(lead, "h"), "shared")
    labels = components(shared.select(F.col("cls").alias("a"), "b")).withColumnRenamed("node", "cls")
    whole = materialise(shared.select("cls", "n").distinct().join(labels, "cls"), "blocks")
    large = materialise(whole.groupBy("label").agg(F.sum("n").alias("load")).filter(F.col("load") > SUB_BLOCK), "large")
    own = whole.select("cls", "n", F.col("label").alias("block"))
    if large.isEmpty():
        return own
    # Large components whose shingles make less work one by one: of a chain of texts with little in common, say.
    held = materialise(shared.join(materialise(whole.join(large, "label").select("cls", "label", "load"), "members"), "cls"), "held")
    single = held.groupBy("label", "load", "h").agg(F.sum("n").alias("own")).groupBy("label", "load").agg(F.sum(_work(F.col("own"))).alias("work"))
    cut = materialise(single.filter(F.col("work") < _work(F.col("load"))).select("label"), "cut")
    return own.join(cut, F.col("block") == cut["label"], "left_anti").unionByName(held.join(cut, "label").select("cls", "n", F.unhex(F.hex("h")).alias("block")))


def _links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked classes."""
    # Sets that link are of the same class of sizes or of neighbouring ones; its width is a little more than the ratio of sizes.
    size = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-9)).cast("long")
    sized, long_ = blocks.withColumn("size", size), lambda x: F.lit(x).cast("long")
    parts = sized.groupBy("block", "size").agg(F.sum("n").alias("load")).groupBy("block").agg(F.sum("load").alias("load"), F.map_from_entries(F.collect_list(F.struct("size", F.ceil(F.col("load") / SUB_BLOCK).cast("long").alias("p")))).alias("parts"))
    cut = F.col("load") > SUB_BLOCK
    parts = materialise(parts.select("block", cut.alias("cut"), F.when(cut, F.col("parts")).otherwise(F.create_map(long_(0), long_(1))).alias("parts")), "parts")
    code = lambda s, part: F.struct(s.alias("s"), part.alias("p"))
    near = lambda s: F.coalesce(F.try_element_at("parts", s), long_(0))
    rows = sized.join(parts, "block").withColumn("size", F.when(F.col("cut"), F.col("size")).otherwise(0))
    dealt = rows.withColumn("own", code(F.col("size"), F.pmod(F.xxhash64("cls"), near(F.col("size")))))

    def others(d: int) -> Column:
        """The sub-blocks of the class of sizes that is d further on."""
        at = F.col("size") + d
        return F.when(near(at) > 0, F.transform(F.sequence(long_(1), near(at)), lambda p: code(at, p - 1))).otherwise(F.array().cast("array<struct<s:bigint,p:bigint>>"))

    dealt = dealt.select("cls", "block", "own", F.explode(F.concat(*map(others, (-1, 0, 1)))).alias("other"))
    dealt = dealt.select("cls", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    dealt = dealt.select("cls", "block", "i", "j", (F.col("own") == F.col("i")).alias("left")).join(sets, "cls")

    def run(group: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for left, cls, raw in sorted(zip(group.column("left").to_pylist(), group.column("cls").to_pylist(), group.column("hashes").to_pylist(), strict=True)):
            sides[not left].append((cls, np.frombuffer(raw, np.uint64)))
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        left, right = (sides[0], sides[0]) if same else sides
        made = links([s for _, s in left], None if same else [s for _, s in right], percent)
        tidy()
        return pa.table({"a": pa.array([left[x][0] for x, _ in made], pa.binary()), "b": pa.array([right[y][0] for _, y in made], pa.binary())})

    # Dealt out by meeting: the join before may have left a block in one partition, which would do for the grouping.
    return dealt.repartition("block", "i", "j").groupBy("block", "i", "j").applyInArrow(run, "a binary, b binary")


def _grouped(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, cls, label) for each document."""
    prepare(docs.sparkSession)
    chunks = materialise(_chunks(docs, percent, size, id_col, text_col), "chunks")
    total = chunks.agg(F.coalesce(F.sum(F.aggregate("posted", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    buckets = 1 + total // BUCKET
    chunks = chunks.withColumn("buckets", F.lit(buckets))
    answers = _post(chunks, buckets).groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, codes binary")
    found = materialise(_candidates(chunks, answers, percent), "candidates")
    labels = components(_links(materialise(_sets(docs, found, size, text_col), "sets"), materialise(_blocks(found), "own"), percent))
    rows = chunks.select(F.explode(F.arrays_zip("ids", "keys", "n", "cls")).alias("r")).select(F.col("r.ids").alias("doc_id"), F.col("r.keys").alias("key"), F.col("r.n").alias("n"), F.col("r.cls").alias("cls"))
    return rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def groups(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the group) of each document."""
    rows = _grouped(docs, percent, size, id_col, text_col)
    heads = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("head"))
    linked = rows.filter("n > 0").join(heads, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("head").alias("component_id"))
    alone = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, without those of a group but its first (smallest id, a null id last; then smallest text key).
    Of repeated rows (id and text) the one whose other columns come first as JSON stays. Only texts that may go are shuffled."""
    rows = materialise(_grouped(docs, percent, size, id_col, text_col).select("doc_id", "key", "n", "label"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")
    heads = rows.filter("n > 0").groupBy("label").agg(F.min(rank).alias("head"))
    gone = rows.filter("n > 0").withColumn("rank", rank).join(heads, "label").filter("rank <> head").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    gone = materialise(gone, "gone")
    again = rows.groupBy("doc_id", "key").count().filter("count > 1").select("key")
    held = materialise(marks(gone.select(F.col("__key").alias("x")).unionByName(again.select(F.col("key").alias("x")))), "marks")
    # The caller's row travels as one column, so that no name of its own can meet one of these.
    own = with_mark(docs.select(F.struct("*").alias("own"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key")), "key", held)
    left = own.filter("__hit").join(gone, own["id"].eqNullSafe(gone["__id"]) & (own["key"] == gone["__key"]), "left_anti")
    others = [F.col("own").getField(c).alias(c) for c in docs.columns if c != text_col]
    left = left.groupBy("id", "key").agg(F.min_by("own", F.to_json(F.struct(*others)) if others else F.lit("")).alias("own"))
    return own.filter("not __hit").select("own.*").unionByName(left.select("own.*"))
