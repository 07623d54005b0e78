"""Product codes of vectors: integer k-means of every part, with adaptive bounds kept for every part.

A vector is cut into equal parts; every part position has a codebook. With each part its row keeps
what the last round has proved: the entry it belongs to with an upper bound of the distance, its b
closest other entries with lower bounds in ascending order, and one outer bound for all entries beyond
those. When entries move, bounds widen by how far. A part whose upper bound stays below all lower
bounds keeps its entry unmeasured. Otherwise its own distance is measured, then the listed entries up
to the first bound that lies above, and only if the outer bound is reached too, all entries; all this in
integers, so that ties go to the lower index. b follows what the last round has needed, part by part.

Rows are never shuffled for this: a round maps one written table to the next, and a second pass returns
one row of sums per part, entry and task. The codebooks (parts x entries x components) are all that
the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.centroids import finite, matrix, squared, whole_numbers
from planloom.llm.common import discard, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integers beyond this count as this: squared distances of parts of up to 256 components fit 64 bits.
LIMIT = 1 << 26
#: Entries listed at first, as a part of all entries, and the least and greatest number later.
LISTED, LEAST_LISTED, MOST_LISTED = 8, 4, 64
#: So many of the parts shall be settled within their lists; a list grows where more are not.
WITHIN, BEYOND = 0.99, 0.05
#: Share of a distance by which bounds, kept in 32 bits, are taken wider: many times their error.
SLACK = 1e-6
ROWS = 4096


def all_squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * points.shape[1] < 1 << 53 else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    if kind is np.float64:
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([squared(p, x) for x in e], axis=1)


class Bounds:
    """What is known of one part of many rows: own entry, upper bound, listed entries, lower bounds, outer bound."""

    def __init__(self, own, up, near, low, rest):
        self.own, self.up, self.near, self.low, self.rest = own, up, near, low, rest

    @classmethod
    def measured(cls, points: np.ndarray, entries: np.ndarray, listed: int) -> Bounds:
        """From the distances to all entries."""
        n, k = len(points), len(entries)
        apart = all_squares(points, entries)
        own = apart.argmin(axis=1)  # the first of equal ones
        row = np.arange(n)
        away = np.sqrt(apart.astype(float))
        up = away[row, own] * (1 + SLACK)
        away[row, own] = np.inf
        near, low, rest = np.zeros((n, listed), np.int64), np.full((n, listed), np.inf), np.full(n, np.inf)
        some = min(listed + 1, k)
        closest = np.argpartition(away, some - 1, axis=1)[:, :some] if some < k else np.tile(np.arange(k), (n, 1))
        order = np.take_along_axis(away, closest, axis=1).argsort(axis=1, kind="stable")
        closest = np.take_along_axis(closest, order, axis=1)
        bounds = np.take_along_axis(away, closest, axis=1) * (1 - SLACK)
        kept = min(listed, some)
        near[:, :kept], low[:, :kept] = closest[:, :kept], bounds[:, :kept]
        if some > listed:
            rest = bounds[:, listed]
        return cls(own, up, near, low, rest)

    def resized(self, listed: int) -> Bounds:
        """Shorter lists hand their ends to the outer bound; longer ones have free places at the end."""
        n, b = self.near.shape
        if listed < b:
            self.rest = np.minimum(self.rest, self.low[:, listed])
            self.near, self.low = self.near[:, :listed], self.low[:, :listed]
        elif listed > b:
            self.near = np.concatenate([self.near, np.zeros((n, listed - b), np.int64)], axis=1)
            self.low = np.concatenate([self.low, np.full((n, listed - b), np.inf)], axis=1)
        return self

    def moved(self, drift: np.ndarray) -> Bounds:
        """Widened by how far the entries have moved, with the lists' bounds in ascending order again."""
        self.up = (self.up + drift[self.own]) * (1 + SLACK)
        low = self.low - drift[self.near]
        low -= SLACK * np.where(np.isinf(low), 0, np.abs(low))
        self.low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        self.rest = self.rest - drift.max()
        self.rest = self.rest - SLACK * np.where(np.isinf(self.rest), 0, np.abs(self.rest))
        return self

    def settle(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Bring every row to its nearest entry. How many listed entries each had to measure; one more
        than are listed where all entries were."""
        listed = self.near.shape[1]
        need = np.zeros(len(points), np.int64)
        reached = lambda r: ((self.low[r] <= self.up[r, None]).sum(axis=1), self.rest[r] <= self.up[r])
        many, beyond = reached(slice(None))
        rows = np.flatnonzero((many > 0) | beyond)
        if not len(rows):
            return need
        exact = np.zeros(len(points), np.int64)
        exact[rows] = squared(points[rows], entries[self.own[rows]])
        self.up[rows] = np.sqrt(exact[rows].astype(float)) * (1 + SLACK)
        many, beyond = reached(rows)
        far = rows[beyond]
        many, rows = many[~beyond], rows[~beyond]
        many, rows = many[many > 0], rows[many > 0]
        if len(rows):
            need[rows] = many
            r = np.repeat(rows, many)
            slot = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            entry = self.near[r, slot]
            apart = squared(points[r], entries[entry])
            self.low[r, slot] = np.sqrt(apart.astype(float)) * (1 - SLACK)
            order = np.lexsort((entry, apart, r))
            first = order[np.flatnonzero(np.concatenate(([True], r[order][1:] != r[order][:-1])))]
            who, best, new, place = r[first], apart[first], entry[first], slot[first]
            better = (best < exact[who]) | ((best == exact[who]) & (new < self.own[who]))
            who, best, new, place = who[better], best[better], new[better], place[better]
            self.near[who, place] = self.own[who]
            self.low[who, place] = np.sqrt(exact[who].astype(float)) * (1 - SLACK)
            self.own[who] = new
            self.up[who] = np.sqrt(best.astype(float)) * (1 + SLACK)
            order = self.low[rows].argsort(axis=1, kind="stable")
            self.near[rows] = np.take_along_axis(self.near[rows], order, axis=1)
            self.low[rows] = np.take_along_axis(self.low[rows], order, axis=1)
        if len(far):
            need[far] = listed + 1
            anew = Bounds.measured(points[far], entries, listed)
            self.own[far], self.up[far], self.near[far], self.low[far], self.rest[far] = anew.own, anew.up, anew.near, anew.low, anew.rest
        return need


def adapted(listed: int, needs: dict[int, int], most: int) -> int:
    """How many entries to list, from how many the rows of the last round have measured."""
    total = sum(needs.values())
    if needs.get(listed + 1, 0) > BEYOND * total:
        return min(2 * listed, most)
    within, count = 0, sum(n for need, n in needs.items() if need <= listed)
    for need in sorted(x for x in needs if x <= listed):
        within += needs[need]
        if within >= WITHIN * count:
            return min(listed, max(LEAST_LISTED, need))
    return listed


def _packed(values: np.ndarray, kind) -> pa.Array:
    """Rows of numbers as one byte string each: far cheaper to write and read than arrays of numbers."""
    data = np.ascontiguousarray(values, dtype=kind)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(0, width * len(data) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.BinaryArray, kind, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return np.frombuffer(data.tobytes(), kind).reshape(len(column), width)


#: own, up, rest: one for each part; near, low: the parts' lists one after the other. All packed.
STATE = {"own": np.int16, "up": np.float32, "near": np.int16, "low": np.float32, "rest": np.float32, "need": np.int16}


def _round(held: DataFrame, books: list[np.ndarray], before: list[int] | None, listed: list[int], drifts: list[np.ndarray] | None, last: bool):
    """The table after one assignment. before: the lists' lengths in the given table, None in the first round."""
    parts, width = len(books), books[0].shape[1]
    given = [f"{f.name} {f.dataType.simpleString()}" for f in held.select("id", "label", "q").schema]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                if not len(part):
                    continue
                points = matrix(part.column("q"), parts * width).reshape(len(part), parts, width)
                col = lambda name, n: _unpacked(part.column(name), STATE[name], n)  # noqa: B023, E731
                if before is not None:
                    own, up, rest = col("own", parts), col("up", parts), col("rest", parts)
                    near, low = col("near", sum(before)), col("low", sum(before))
                found, needs, errors = [], [], np.zeros(len(part), np.int64)
                for p in range(parts):
                    x = np.ascontiguousarray(points[:, p])
                    if before is None:
                        b, need = Bounds.measured(x, books[p], listed[p]), np.zeros(len(x), np.int64)
                    else:
                        cut = slice(sum(before[:p]), sum(before[:p + 1]))
                        b = Bounds(own[:, p].astype(np.int64), up[:, p].astype(float), near[:, cut].astype(np.int64), low[:, cut].astype(float), rest[:, p].astype(float))
                        b = b.moved(drifts[p]).resized(listed[p])
                        need = b.settle(x, books[p])
                    found.append(b)
                    needs.append(need)
                    if last:
                        errors += squared(x, books[p][b.own])
                side = lambda name: np.stack([getattr(b, name) for b in found], axis=1)  # noqa: B023, E731
                if last:
                    codes = side("own").astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)],
                        names=["id", "label", "code", "error"],
                    )
                    continue
                state = {
                    "own": side("own"), "up": side("up"), "near": np.concatenate([b.near for b in found], axis=1),
                    "low": np.concatenate([b.low for b in found], axis=1), "rest": side("rest"), "need": np.stack(needs, axis=1),
                }
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("q"), *(_packed(x, STATE[name]) for name, x in state.items())],
                    names=["id", "label", "q", *state],
                )

    schema = ", ".join([*given[:2], "code string, error bigint"]) if last else ", ".join([*given, *(f"{name} binary" for name in STATE)])
    return stored(held.mapInArrow(run, schema))


def _totals(held: DataFrame, parts: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray, list[dict[int, int]]]:
    """Members and sums of every entry of every part, and how often each need occurred."""
    def run(batches):
        totals, needs = np.zeros((parts, k, width + 1), np.int64), np.zeros((parts, MOST_LISTED + 2), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                if not len(part):
                    continue
                points = matrix(part.column("q"), parts * width).reshape(len(part), parts, width)
                own, need = (_unpacked(part.column(name), STATE[name], parts).astype(np.int64) for name in ("own", "need"))
                for p in range(parts):
                    order = np.argsort(own[:, p], kind="stable")
                    present, first = np.unique(own[order, p], return_index=True)
                    totals[p, present, :width] += np.add.reduceat(points[order, p], first, axis=0)
                    totals[p, :, width] += np.bincount(own[:, p], minlength=k)
                    needs[p] += np.bincount(need[:, p], minlength=MOST_LISTED + 2)
        p, e, c = np.nonzero(totals)
        q, n = np.nonzero(needs)
        yield pa.RecordBatch.from_pydict({
            "part": np.concatenate([p, q]).astype(np.int32), "entry": np.concatenate([e, np.full(len(q), k)]).astype(np.int32),
            "pos": np.concatenate([c, n]).astype(np.int32), "total": np.concatenate([totals[p, e, c], needs[q, n]]),
        })

    rows = held.select("q", "own", "need").mapInArrow(run, "part int, entry int, pos int, total bigint")
    totals, needs = np.zeros((parts, k, width + 1), np.int64), [{} for _ in range(parts)]
    # parts * k * (width + 1) rows and the needs: the size of the codebooks.
    for r in rows.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")).toLocalIterator():
        if r.entry == k:
            needs[r.part][r.pos] = r.total
        else:
            totals[r.part, r.entry, r.pos] = r.total
    return totals[:, :, width], totals[:, :, :width], needs


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", told: list | None = None,
) -> DataFrame:
    """One row per kept vector row: id, code (two hex digits for each part), error, label_error,
    codebooks_sha256.

    Vectors that are null or have a component that is null, NaN or infinite are dropped. Vectors are taken
    to be of one size that `parts` divides; where sizes differ, the commonest one that it divides (the
    greater of equally common ones) counts, and vectors of other sizes, which no codebook fits, go too.
    Components count as floor(scale * x), those beyond 2^26 as 2^26. A codebook starts with the parts of the
    kept vectors of the least ids (null ids last, equal ids by their components; fewer entries where there
    are fewer vectors). Equally near entries: the lower index. Entries without parts stay as they are.
    label_error sums error over rows of the same label, null labels together. Repeated rows stay
    repeated. A table without kept vectors gives no rows. Other columns are not read.

    told: gets the lists' lengths, and how many rows had which need, of every round.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    given = stored(vectors.filter(finite(vector)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(vector, scale, LIMIT).alias("q")
    ))
    sizes = given.groupBy(F.size("q").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("size") > 0) & (F.col("size") % parts == 0))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    if common is None:
        out = spark.createDataFrame([], f"id {kinds['id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
        return out.withColumnRenamed("id", id_col)
    width = common["size"] // parts
    held = given.filter(F.size("q") == common["size"])
    first = held.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    seeds = np.array([r.q for r in first], np.int64).reshape(len(first), parts, width)
    books = [np.ascontiguousarray(seeds[:, p]) for p in range(parts)]
    k = len(first)
    most = min(MOST_LISTED, max(1, k - 1))
    before, listed, drifts, stale = None, [min(most, max(LEAST_LISTED, k // LISTED))] * parts, None, given
    for step in range(rounds):
        held = _round(held, books, before, listed, drifts, False)
        discard(stale)
        stale = held
        members, sums, needs = _totals(held, parts, k, width)
        if told is not None:
            told.append((list(listed), needs))
        before = list(listed)
        if step:
            listed = [adapted(b, n, most) for b, n in zip(listed, needs, strict=True)]
        moved = []
        for p in range(parts):
            used = members[p] > 0
            book = books[p].copy()
            book[used] = sums[p][used] // members[p][used, None]  # floor, also below zero
            moved.append(book)
        drifts = [np.sqrt(squared(a, b).astype(float)) * (1 + SLACK) for a, b in zip(books, moved, strict=True)]
        books = moved
    coded = _round(held, books, before, listed, drifts, True)
    discard(stale)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    # Written, so that the join can split a label with many rows.
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
