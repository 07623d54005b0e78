"""Exact integer k-means, with a table of distances to fixed pivots that spares most of the others.

Vectors are turned into integers once and written with their distances to a few fixed pivots. In a
round the centroids, and their distances to the pivots, go out to the tasks. For any pivot the
difference of the two distances is a lower bound of the distance between vector and centroid; the
centroid of the least bound is measured first, and only centroids whose bound is not above that
distance are measured as well, in integers. Pivots stay, so the table holds for all rounds.

A task returns one row of sums per centroid, whatever it has read. Vectors are never shuffled, so a
vector that a third of the rows repeat weighs on no task. The centroids, k times the vector's size,
are the only thing the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import discard, stored

K = 40
ROUNDS = 5
SCALE = 256
SIZE = 64
PIVOTS = 12
#: Integers beyond this count as this: squared distances of 64 components then fit 64 bits.
LIMIT = 1 << 27
#: Share of a distance by which bounds in floating point are taken lower, many times their error.
SLACK = 1e-9
ROWS = 4096


def whole_numbers(vector: Column, scale: int, limit: int = LIMIT) -> Column:
    """Components as integers: floor(scale * x), held within the limit."""
    def one(x):
        return F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(limit)), F.lit(-limit)).cast("int")

    return F.transform(vector, one)


def finite(vector: Column) -> Column:
    """True for vectors whose components are all numbers; false for null vectors too."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(False))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to rows of b, one to one."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from those chosen before them, by the sum of distances; repeats are left out."""
    chosen, far = [0], np.zeros(len(points))
    while len(chosen) < min(count, len(points)):
        far += np.sqrt(((points - points[chosen[-1]]).astype(float) ** 2).sum(axis=1))
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return np.unique(points[chosen], axis=0)


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(float))


def nearest(points: np.ndarray, known: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every point the number of the nearest centroid (ties: the smaller one), the exact squared
    distance, and how many distances were measured in all. known: the points' distances to the pivots."""
    of_centroids = to_pivots(centroids, pivots)
    least = np.zeros((len(points), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(least, np.abs(known[:, p, None] - of_centroids[None, :, p]), out=least)
    # What rounding may have added to a bound.
    least -= SLACK * (known.max(axis=1)[:, None] + of_centroids.max(axis=1)[None, :])
    first = least.argmin(axis=1)
    best = squared(points, centroids[first])
    number = first.astype(np.int64)
    reach = np.sqrt(best.astype(float)) * (1 + SLACK)
    least[np.arange(len(points)), first] = np.inf
    rows, tried = np.nonzero(least <= reach[:, None])
    measured = len(points) + len(rows)
    if len(rows):
        found = squared(points[rows], centroids[tried])
        # By row, then distance, then number: the first of each row is its best.
        order = np.lexsort((tried, found, rows))
        rows, tried, found = rows[order], tried[order], found[order]
        head = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        rows, tried, found = rows[head], tried[head], found[head]
        better = (found < best[rows]) | ((found == best[rows]) & (tried < number[rows]))
        best[rows[better]], number[rows[better]] = found[better], tried[better]
    return number, best, measured


def pivot_table(vectors: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """vectors(id, q) with `far`, the distances to the pivots, written once for all rounds."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                known = to_pivots(matrix(part.column(1), size), pivots)
                far = pa.ListArray.from_arrays(np.arange(0, known.size + 1, len(pivots), dtype=np.int32), known.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, far], names=["id", "q", "far"])

    return stored(vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, q array<int>, far array<double>"))


def _parts(batches, size: int, pivots: int):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            if len(part):
                yield part, matrix(part.column("q"), size), part.column("far").flatten().to_numpy().reshape(-1, pivots)


def sums_by_centroid(held: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Members and component sums of every centroid, and how many distances were measured."""
    k, size = centroids.shape

    def run(batches):
        sums, members, measured = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
        for _, points, known in _parts(batches, size, len(pivots)):
            number, _, some = nearest(points, known, centroids, pivots)
            measured += some
            members += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            present, first = np.unique(number[order], return_index=True)
            sums[present] += np.add.reduceat(points[order], first, axis=0)
        yield pa.RecordBatch.from_pydict({
            "c": np.repeat(np.arange(k + 1, dtype=np.int32), [size + 1] * k + [1]),
            "pos": np.concatenate([np.tile(np.arange(size + 1, dtype=np.int32), k), np.zeros(1, np.int32)]),
            "total": np.concatenate([np.concatenate([sums, members[:, None]], axis=1).ravel(), [measured]]),
        })

    rows = held.select("q", "far").mapInArrow(run, "c int, pos int, total bigint")
    found = rows.groupBy("c", "pos").agg(F.sum("total").alias("total")).collect()  # k * (size + 1) + 1 rows
    sums, measured = np.zeros((k, size + 1), np.int64), 0
    for row in found:
        if row.c == k:
            measured = row.total
        else:
            sums[row.c, row.pos] = row.total
    return sums[:, size], sums[:, :size], measured


def first_centroids(vectors: DataFrame, k: int, salt: str, size: int) -> np.ndarray:
    """The k vectors whose salted ids have the least SHA-256, in that order; null ids come last, equal ids
    by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), size)


def cluster_vectors(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, pivots: int = PIVOTS,
    salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding", told: list | None = None,
) -> DataFrame:
    """One row per kept vector row: id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256.

    Vectors of exactly `size` components, none of them null, NaN or infinite, are kept, as integers
    floor(scale * x); integers beyond 2^27 count as 2^27. The k kept vectors of least salted hash are the
    first centroids (all of them where there are fewer). Each round assigns every vector to its nearest
    centroid, the smaller number of equally near ones, and moves every centroid that has vectors to the
    floor of their mean; then vectors are assigned once more. Repeated rows and equal ids are vectors of
    their own; a null id is never among the first centroids while others are left. A table without
    kept vectors gives no rows. Other columns are not read.

    told: gets (vectors, centroids, distances measured) of every round.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    given = vectors.filter(finite(vector) & (F.size(vector) == size)).select(
        F.col(id_col).alias("id"), whole_numbers(vector, scale).alias("q")
    )
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance bigint"
    centroids = first_centroids(given, k, salt, size)
    if not len(centroids):
        out = spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return out.withColumnRenamed("id", id_col)
    fixed = choose_pivots(centroids, pivots)
    held = pivot_table(given, fixed, size)
    for _ in range(rounds):
        members, sums, measured = sums_by_centroid(held, centroids, fixed)
        if told is not None:
            told.append((int(members.sum()), len(centroids), measured))
        used = members > 0
        centroids = centroids.copy()
        centroids[used] = sums[used] // members[used, None]  # floor, also below zero

    def assign(batches):
        for part, points, known in _parts(batches, size, len(fixed)):
            number, best, _ = nearest(points, known, centroids, fixed)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"]
            )

    assigned = stored(held.mapInArrow(assign, schema))
    discard(held)
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    # One row per centroid: k rows at most.
    known = spark.createDataFrame(
        [(c, t, sum(totals.values()), prints[c]) for c, t in totals.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
