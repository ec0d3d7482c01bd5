"""Which vectors can be among the k nearest of a request, by matrix products over Arrow batches.

Products are computed on a first part of the dimensions; with the lengths of what is left of both vectors they bound the cosine from above
(Cauchy-Schwarz), and only vectors whose bound reaches the k-th best cosine that the task has seen go on to the next part, and to the end. A task
keeps, for each request, all that is within SLACK of its k-th best, so that the last bits of floating point cannot decide; the caller
ranks these few with the same arithmetic as everywhere else. Nothing is approximate.

Of many copies of one vector only the k with the smallest ids are kept, as ties go by id; copies are known by a 64-bit hash of the vector. Vectors that have
no cosine (null, zero, or of another length than the request) come last, by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from foliant.shipping import ship

#: Cosines that differ by less may be told apart only by the caller; rounding errors are far smaller.
SLACK = 1e-9
#: Cells of a product at once, and how many candidates of a request are waited for at most before the worst go.
CELLS, MANY = 2_000_000, 10_000
#: Requests are weighed by scope if there are no more scopes than this; of more requests than FEW hardly a vector is out for all before the end.
SCOPES, FEW = 256, 64
SCOPE = ["convenio_id", "authority_level", "retrieval_status", "validity_start", "validity_end"]


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and which of them are there in the right length."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    good = (sizes == width) & (width > 0)
    out = np.zeros((len(column), width))
    if good.any():
        out[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    good &= np.isfinite(out).all(axis=1)
    return np.where(good[:, None], out, 0.0), good


def _days(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.date32()).cast(pa.int32()), missing).to_numpy(zero_copy_only=False)


class Requests:
    """A block of requests as arrays; without scopes every vector counts for every request."""

    def __init__(self, vectors: list | pa.Array, ks: list[int], scopes: list[dict] | None):
        self.k, self.scoped = np.array(ks, np.int64), scopes is not None
        column = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
        width = pc.max(pc.list_value_length(column)).as_py() or 0
        # Requests of another width than the widest match no vector; they are given by their own block.
        self.unit, _ = _matrix(column, width)
        size = np.linalg.norm(self.unit, axis=1)
        self.good = size > 0
        self.unit /= np.where(self.good, size, 1.0)[:, None]
        #: Where the parts of the dimensions end.
        self.cuts = sorted({width // 2, 3 * width // 4, width} - {0})
        self.rest = {c: np.linalg.norm(self.unit[:, c:], axis=1) for c in self.cuts}
        if scopes is not None:
            far = np.iinfo(np.int32)
            self.convenio = np.array([s["convenio_id"] if s["convenio_id"] is not None else 0 for s in scopes], np.int64)
            self.own = np.array([s["convenio_id"] is not None for s in scopes])
            self.law = np.array([bool(s["include_national_law"]) for s in scopes])
            self.statuses = {x: i for i, x in enumerate(sorted({x for s in scopes for x in s["statuses"] or [] if x is not None}))}
            self.status = np.array([[x in (s["statuses"] or []) for s in scopes] for x in self.statuses] + [[False] * len(scopes)])
            epoch = np.datetime64("1970-01-01")
            day = [None if s["as_of_date"] is None else int((np.datetime64(s["as_of_date"]) - epoch).astype(int)) for s in scopes]
            self.from_day, self.to_day = np.array([far.max if d is None else d for d in day], np.int64), np.array([far.min if d is None else d for d in day], np.int64)
        #: The requests of each scope, and whether one stands for all of them; else all requests together.
        self.groups, self.alike = [np.arange(len(self.k))] if len(self.k) else [], not self.scoped
        if self.scoped and len(self.k):
            keys = np.column_stack([self.convenio, self.own, self.law, self.from_day, self.to_day, np.unique(self.status, axis=1, return_inverse=True)[1].reshape(-1)])
            of = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
            if of.max() < SCOPES:
                self.groups, self.alike = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1]), True

    def places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """The scope of each vector as arrays."""
        if not self.scoped:
            return ()
        column = lambda c: batch.column(c)
        convenio, none = pc.fill_null(column("convenio_id"), 0).to_numpy(zero_copy_only=False), column("convenio_id").is_null().to_numpy(zero_copy_only=False)
        law = pc.fill_null(pc.equal(column("authority_level"), "national_law"), False).to_numpy(zero_copy_only=False)
        status = np.array([self.statuses.get(x, -1) for x in column("retrieval_status").to_pylist()], np.int64)
        far = np.iinfo(np.int32)
        return convenio, none, law, status, _days(column("validity_start"), far.min), _days(column("validity_end"), far.max)

    def eligible(self, places: tuple[np.ndarray, ...], rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether each of these vectors counts for each request of a group."""
        if not self.scoped:
            return np.ones((len(rows), len(group)), bool)
        convenio, none, law, status, start, end = (x[rows] for x in places)
        out = ((convenio[:, None] == self.convenio[group]) & self.own[group] & ~none[:, None]) | (law[:, None] & self.law[group])
        out &= self.status[:, group][status]
        return out & (start[:, None] <= self.from_day[group]) & (end[:, None] >= self.to_day[group])


class Best:
    """The candidates of a task for a block of requests."""

    def __init__(self, requests: Requests):
        self.q, self.least = requests, np.full(len(requests.k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.fresh, self.seen, self.scored = 0, 0, 0
        #: New pairs after which the bar is raised: as many as must be kept, so that sorting them costs little beside finding them.
        self.enough = int(np.minimum(requests.k, MANY).sum())
        self.mix = np.random.default_rng(1).integers(1, 2**63, requests.unit.shape[1], dtype=np.uint64) | np.uint64(1)

    def add(self, batch: pa.RecordBatch) -> None:
        q, ids = self.q, batch.column("id").to_numpy(zero_copy_only=False)
        places, (x, good) = q.places(batch), _matrix(batch.column("embedding"), q.unit.shape[1])
        size = np.linalg.norm(x, axis=1)
        good &= size > 0
        unit = x / np.where(good, size, 1.0)[:, None]
        with np.errstate(over="ignore"):
            name = (x.view(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64) if x.shape[1] else np.zeros(len(x), np.uint64)
        seen, ended = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for group in q.groups:
            rows = np.arange(len(x))
            if q.alike:
                rows = rows[q.eligible(places, rows, group[:1])[:, 0]]
                seen[rows] = True
            step = max(1, CELLS // len(group))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                live = None if q.alike else q.eligible(places, part, group)
                if live is not None:
                    seen[part[live.any(axis=1)]] = True
                self._near(unit, good, part, group, live, ended, ids, name)
                self._rest(good, part, group, live, ids)
                if self.fresh > self.enough:
                    self.sort_out()
        self.seen += int(seen.sum())
        self.scored += int(ended.sum())

    def _near(self, unit: np.ndarray, good: np.ndarray, rows: np.ndarray, group: np.ndarray, live: np.ndarray | None, ended: np.ndarray, ids: np.ndarray, name: np.ndarray) -> None:
        """Holds the pairs whose cosine reaches the bar; live: which pairs count, None for all."""
        q, fine = self.q, good[rows]
        # Requests without a direction are few; all of them together need no copy.
        asked = group if q.good[group].all() else group[q.good[group]]
        live = None if live is None else live[fine][:, q.good[group]]
        rows, at, part = rows[fine], 0, 0.0
        if not len(rows) or not len(asked):
            return
        vectors, least = q.unit[asked], self.least[asked]
        for cut in q.cuts if len(asked) <= FEW else q.cuts[-1:]:
            part = part + unit[rows, at:cut] @ vectors[:, at:cut].T
            at = cut
            if cut < q.cuts[-1]:
                bound = part + np.linalg.norm(unit[rows, cut:], axis=1)[:, None] * q.rest[cut][asked]
                near = bound >= least - SLACK
                on = (near if live is None else near & live).any(axis=1)
                rows, part, live = rows[on], part[on], live if live is None else live[on]
        ended[rows] = True
        most = int(q.k[asked].max(initial=0))
        if live is None and 0 < most < len(rows) and np.isneginf(least).any():
            # The first rows give a bar at once: as many as are asked for reach it.
            least = np.maximum(least, np.partition(part, len(rows) - most, axis=0)[len(rows) - most])
            self.least[asked] = least
        near = part >= least - SLACK
        row, request = np.nonzero(near if live is None else near & live)
        self._hold(asked[request], ids[rows[row]], part[row, request], name[rows[row]])

    def _rest(self, good: np.ndarray, rows: np.ndarray, group: np.ndarray, live: np.ndarray | None, ids: np.ndarray) -> None:
        """Holds the pairs without a cosine, for requests that have no bar."""
        q, open_ = self.q, np.isneginf(self.least[group])
        if not open_.any() or (good[rows].all() and q.good[group[open_]].all()):
            return
        none = ~(good[rows][:, None] & q.good[group[open_]])
        row, request = np.nonzero(none if live is None else none & live[:, open_])
        self._hold(group[open_][request], ids[rows[row]], np.full(len(row), -np.inf), np.zeros(len(row), np.uint64))

    def _hold(self, *found: np.ndarray) -> None:
        self.held.append(found)
        self.fresh += len(found[0])

    def sort_out(self) -> tuple[np.ndarray, ...]:
        """Drops what is not among the best of its request, and raises the bar."""
        request, ids, cosine, name = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
        order = np.lexsort((ids, name, request))
        request, ids, cosine, name = request[order], ids[order], cosine[order], name[order]
        first = np.ones(len(request), bool)
        first[1:] = (request[1:] != request[:-1]) | (name[1:] != name[:-1])
        nth = np.arange(len(request)) - np.maximum.accumulate(np.where(first, np.arange(len(request)), 0)) if len(request) else request
        keep = nth < self.q.k[request]
        request, ids, cosine, name = request[keep], ids[keep], cosine[keep], name[keep]
        order = np.lexsort((-cosine, request))
        counts = np.bincount(request, minlength=len(self.q.k))
        last = np.concatenate([[0], np.cumsum(counts)[:-1]]) + self.q.k - 1
        full = (counts >= self.q.k) & (self.q.k > 0)
        self.least[full] = np.maximum(self.least[full], cosine[order][last[full]])
        keep = (cosine >= self.least[request] - SLACK) | (self.least[request] == -np.inf)
        self.held = [(request[keep], ids[keep], cosine[keep], name[keep])]
        self.fresh = 0
        return self.held[0]


OUT = "request int, id long, cosine double, seen long, scored long"


def candidates(rows: DataFrame, vectors: list | pa.Array, ks: list[int], scopes: list[dict] | None = None) -> DataFrame:
    """(request, id, cosine, seen, scored): all that can be among the k nearest, a few more than that from each task; and from each task a row with null
    id that says how many vectors counted for any request, and how many were computed to the end.

    `rows` has id, embedding and, with scopes, SCOPE. Requests are named by their place in the lists, which go to the workers with the task: the caller
    bounds them."""
    spark = rows.sparkSession
    ship(spark)
    block = spark.sparkContext.broadcast((vectors, ks, scopes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(Requests(*block.value))
        step = max(1, CELLS // max(1, best.q.unit.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                best.add(batch.slice(at, step))
        request, ids, cosine, _ = best.sort_out()
        none = [0] * len(ids)
        columns = [(request.tolist() + [-1], pa.int32()), (ids.tolist() + [None], pa.int64()), (np.where(cosine == -np.inf, np.nan, cosine).tolist() + [None], pa.float64()), ([*none, best.seen], pa.int64()), ([*none, best.scored], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in columns], ["request", "id", "cosine", "seen", "scored"])

    return rows.select("id", "embedding", *(SCOPE if scopes is not None else [])).mapInArrow(run, OUT)


def work(found: DataFrame) -> DataFrame:
    """How many vectors counted for any request, and how many were computed to the end."""
    return found.filter("id is null").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))


#: Cells of a product of two blocks at once.
NEAR_CELLS = 1_000_000


def packed(rows: DataFrame, most: int, parts: int) -> DataFrame:
    """Rows (id, embedding, maybe other) as blocks, dealt evenly over so many partitions: `block` is an Arrow stream of at most so many rows in the order of
    their ids. `first` tells the rows that a search must meet: of rows with equal vectors and equal `other` those of the two smallest ids, as one of the two
    is another row than the one that asks."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                yield _block(table.slice(0, most))
                held = table.slice(most).to_batches()
        if sum(b.num_rows for b in held):
            yield _block(pa.Table.from_batches(held))

    return rows.repartition(parts).mapInArrow(run, "block binary")


def _block(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
    rows = rows.append_column("first", pa.array(_first_two(rows)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def _unblock(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal numbers; null is -1."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _by_width(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By their length the vectors that are there, in the element type of the column: their places and values. A vector with a null in it has no products."""
    column = rows["embedding"].combine_chunks()
    sizes, holes, whole = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False), np.zeros(len(column), bool), column.flatten()
    if whole.null_count:
        holes[pc.list_parent_indices(column).filter(whole.is_null()).to_numpy(zero_copy_only=False)] = True
    out = {}
    for width in np.unique(sizes[(sizes >= 0) & ~holes]).tolist():
        at = np.flatnonzero((sizes == width) & ~holes)
        out[width] = at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
    return out


def _first_two(rows: pa.Table) -> np.ndarray:
    """Of rows in the order of their ids, and with equal vectors and equal `other`, those of the two smallest ids."""
    alike, n = np.full(len(rows), -1), 0
    for width, (at, values) in _by_width(rows).items():
        if width:
            raw = np.ascontiguousarray(values).view(np.dtype((np.void, width * values.itemsize))).reshape(-1)
            alike[at] = np.unique(raw, return_inverse=True)[1].reshape(-1) + n
        else:
            alike[at] = n
        n += len(at)
    # Vectors with a null in them are as good as null ones: nothing has a product with either.
    other = _codes(rows["other"]) if "other" in rows.column_names else np.zeros(len(rows), np.int64)
    ids = _codes(rows["id"])
    name = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]) if len(ids) else ids
    order = np.lexsort((name, other, alike))
    alike, other, name = alike[order], other[order], name[order]
    group = np.ones(len(order), bool)
    group[1:] = (alike[1:] != alike[:-1]) | (other[1:] != other[:-1])
    nth = np.cumsum(group | np.concatenate([[True], name[1:] != name[:-1]])) if len(order) else name
    out = np.zeros(len(order), bool)
    out[order] = nth - np.maximum.accumulate(np.where(group, nth, 0)) < 2
    return out


def nearest(left: DataFrame, right: DataFrame, same_row: bool) -> DataFrame:
    """(id, near_id, similarity): for each row of a block of left and each block of right (both `packed`) the row with the largest dot product, the smallest
    id among equals. Rows of equal `other`, if there is one, do not meet, nor do, unless same_row, rows of equal id.

    A null product, of vectors of different lengths or with a null, comes last, and NaN first, as in SQL."""
    ship(left.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("block"), batch.column("near_block"), strict=True):
                yield _nearest(_unblock(one), _unblock(two), same_row)

    # The hint keeps Spark from sending one side whole to all executors.
    pairs = left.crossJoin(right.withColumnRenamed("block", "near_block").hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, "id long, near_id long, similarity double")


class _Apart:
    """Which rows of one table (asked) may not meet which of another (near, in the order of ids)."""

    def __init__(self, asked: pa.Table, near: pa.Table, same_row: bool):
        self.low = self.high = self.asked = None
        if not same_row:
            ids = near["id"].to_numpy()
            self.low, self.high = (np.searchsorted(ids, asked["id"].to_numpy(), side) for side in ("left", "right"))
        if "other" in asked.column_names:
            codes = _codes(pa.chunked_array([*asked["other"].chunks, *near["other"].chunks], asked["other"].type))
            self.asked, self.near = codes[: len(asked)], codes[len(asked) :]

    def mark(self, cells: np.ndarray, rows: np.ndarray, columns: np.ndarray, value: float | bool) -> np.ndarray:
        """Puts the value into the cells of such pairs."""
        if self.low is not None:
            low, high = (np.searchsorted(columns, x[rows]) for x in (self.low, self.high))
            n = high - low
            row = np.repeat(np.arange(len(rows)), n)
            cells[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]] = value
        if self.asked is not None:
            np.putmask(cells, self.asked[rows][:, None] == self.near[columns], value)
        return cells


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in the order of the dimensions, as `vectors.dot` does."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _nearest(asked: pa.Table, near: pa.Table, same_row: bool) -> pa.RecordBatch:
    near = near.filter(near["first"])
    for c in ([] if same_row else ["id"]) + (["other"] if "other" in asked.column_names else []):
        # Null differs from nothing, as in SQL.
        asked, near = (x.filter(x[c].is_valid()) for x in (asked, near))
    asked, near = asked.combine_chunks(), near.combine_chunks()
    apart, theirs = _Apart(asked, near, same_row), _by_width(near)
    place, value, known = np.full(len(asked), -1), np.zeros(len(asked)), np.zeros(len(asked), bool)
    for width, (rows, x) in _by_width(asked).items():
        if width in theirs:
            columns, y = theirs[width]
            x, y = x.astype(np.float64), y.astype(np.float64)
            step = max(1, NEAR_CELLS // len(columns))
            room, size, longest = np.empty((min(step, len(rows)), len(columns))), *(np.linalg.norm(v, axis=1) for v in (x, y))
            longest = longest[np.isfinite(longest)].max(initial=0.0)
            for at in range(0, len(rows), step):
                own = slice(at, at + step)
                found, best = _nearest_of(x[own], y, rows[own], columns, apart, size[own], longest, room)
                place[rows[own]], value[rows[own]], known[rows[own]] = np.where(found >= 0, columns[found], -1), best, found >= 0
    # Those without any product meet the smallest id.
    late, every = np.flatnonzero(~known), np.arange(len(near))
    step = max(1, NEAR_CELLS // max(1, len(every)))
    for at in range(0, len(late) if len(every) else 0, step):
        some = late[at : at + step]
        live = apart.mark(np.ones((len(some), len(every)), bool), some, every, False)
        place[some] = np.where(live.any(axis=1), live.argmax(axis=1), -1)
    there = np.flatnonzero(place >= 0)
    ids, near_ids = asked["id"].combine_chunks().take(pa.array(there)), near["id"].combine_chunks().take(pa.array(place[there]))
    return pa.RecordBatch.from_arrays([ids, near_ids, pa.array(value[there], pa.float64(), mask=~known[there])], ["id", "near_id", "similarity"])


def _nearest_of(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray, apart: _Apart, size: np.ndarray, longest: float, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of x, of these lengths, the place of its nearest in y (-1: none may be met), and the exact product. Products are put into `room`."""
    with np.errstate(invalid="ignore", over="ignore"):
        cells = apart.mark(np.matmul(x, y.T, out=room[: len(x)]), rows, columns, -np.inf)
        best = cells.max(axis=1)
        # Products of zero vectors need no closer look, nor do NaN and infinite ones.
        plain = ~np.isfinite(best) | (size == 0) | (longest == 0)
        # Rounding errors are far smaller than this share of the lengths; the exact product decides.
        bar = np.where(plain, np.nan, np.maximum(best - SLACK * size * longest, -np.finfo(float).max))
        near = cells >= bar[:, None]
        if np.count_nonzero(near) == len(x) - np.count_nonzero(plain):  # one for each: found sooner
            row = np.flatnonzero(~plain)
            column = near[row].argmax(axis=1)
        else:
            row, column = np.divmod(np.flatnonzero(near), len(columns))
    step = max(1, NEAR_CELLS // max(1, x.shape[1]))
    product = np.concatenate([np.zeros(0), *(_fold(x[row[at : at + step]], y[column[at : at + step]]) for at in range(0, len(row), step))])
    order = np.lexsort((column, -product, row))
    order = order[np.unique(row[order], return_index=True)[1]]
    place, value = np.full(len(x), -1), np.zeros(len(x))
    place[row[order]], value[row[order]] = column[order], product[order]
    some = np.flatnonzero(plain)
    if len(some):
        place[some] = cells[some].argmax(axis=1)
        value[some] = cells[some, place[some]] + 0.0
        least = some[np.isneginf(value[some])]  # products that are so, or no row that may be met
        step = max(1, NEAR_CELLS // len(columns))
        for at in range(0, len(least), step):
            part = least[at : at + step]
            live = apart.mark(np.ones((len(part), len(columns)), bool), rows[part], columns, False)
            place[part] = np.where(live.any(axis=1), live.argmax(axis=1), -1)
    return place, value
