import hashlib
import math

import numpy as np
import pytest

from planloom.llm.centroids import choose_pivots, cluster_vectors, nearest, to_pivots

KIND = "vec_id bigint, embedding array<double>, label int, q string, cluster string"


def kept(rows, size):
    """(id, integers) of the vectors that count."""
    fine = lambda v: v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    return [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v]) for i, v in rows if fine(v)]


def brute(rows, k, rounds, size):
    given = kept(rows, size)
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(given, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in given:
            groups.setdefault(pick(v), []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, pick(v), far(v, centroids[pick(v)])) for i, v in given]
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, per[c], sum(per.values()), digest(c)) for i, c, d in out), key=repr)


def made(n=260, size=6):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=size) + 2 * rng.integers(-2, 3, size=size)).tolist()) for k in range(n)]
    rows += [(n + k, (rng.integers(-3, 4, size=size) / 256).tolist()) for k in range(80)]  # many ties
    rows += [(1000 + k, [0.25] * size) for k in range(60)] + [(7, [0.5] * size), (7, [0.5] * size), (None, [0.1] * size), (None, [3.0] * size)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * (size - 1)), (2003, [1.0] * (size - 1) + [None]), (2004, [float("nan")] * size)]
    return rows + [(2005, [float("inf")] + [0.0] * (size - 1)), (2006, [-1e30] * size), (2007, [1e30] * size)]


def framed(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], KIND).repartition(5)


@pytest.mark.parametrize("k,rounds", [(12, 3), (5, 0), (1, 2)])
def test_against_brute_force(spark, k, rounds):
    rows = [r for r in made() if r[0] not in (2006, 2007)]
    found = cluster_vectors(framed(spark, rows), k=k, rounds=rounds, size=6, pivots=4).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, k, rounds, 6)


def test_huge_components_count_as_the_limit(spark):
    rows = [r for r in made() if r[0] is not None and r[0] >= 1000]
    found = cluster_vectors(framed(spark, rows), k=4, rounds=1, size=6).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, 4, 1, 6)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.0] * 6), (2, [1.0] * 6), (2, [1.0] * 6)]
    found = cluster_vectors(framed(spark, rows), size=6).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, 40, 5, 6)
    empty = cluster_vectors(framed(spark, [(3, None)]), size=6)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_pivots_spare_distances_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, size=(40, 64))
    points = (centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, size=(3000, 64))).astype(np.int64)
    pivots = choose_pivots(centres.astype(np.int64), 12)
    number, best, measured = nearest(points, to_pivots(points, pivots), centres.astype(np.int64), pivots)
    apart = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (number == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert measured < 0.2 * apart.size


def test_rounds_tell_what_they_measured(spark):
    told = []
    cluster_vectors(framed(spark, made()), k=8, rounds=2, size=6, told=told)
    assert len(told) == 2 and all(n <= measured <= n * k for n, k, measured in told)
