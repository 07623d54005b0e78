import hashlib
import math

import numpy as np
import pytest

from planloom.llm.vector_codes import Bounds, adapted, all_squares, vector_codes

KIND = "vec_id bigint, embedding array<double>, label int, code string, own int"


def brute(rows, entries, rounds, parts=4):
    fine = lambda v: v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)
    given = [(i, [max(-(1 << 26), min(1 << 26, math.floor(1024 * x))) for x in v], label) for i, v, label in rows if fine(v)]
    width = 8 // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(given, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in given:
                groups.setdefault(pick(cut(v, p), p), []).append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for i, v, label in given:
        code = [pick(cut(v, p), p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e in code), sum(far(cut(v, p), books[p][code[p]]) for p in range(parts)), label))
    by_label = {}
    for *_, error, label in out:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=repr)


def made(n=500):
    rng = np.random.default_rng(11)
    rows = [(k, (rng.normal(size=8) / 3 + rng.integers(-1, 2, size=8)).tolist(), int(rng.integers(0, 4))) for k in range(n)]
    rows += [(n + k, (rng.integers(-4, 5, size=8) / 1024).tolist(), None) for k in range(90)]  # many ties
    rows += [(2000 + k, [0.125] * 8, 3) for k in range(60)] + [(7, [0.5] * 8, None), (7, [0.5] * 8, None), (None, [0.1] * 8, 2), (None, [3.0] * 8, 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [1.0] * 4, 1), (3003, [1.0] * 7 + [None], 1), (3004, [float("nan")] * 8, 1)]
    return rows + [(3005, [float("inf")] + [0.0] * 7, 1), (3006, [-1e30] * 8, None)]


def framed(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 3) for i, v, label in rows], KIND).repartition(5)


@pytest.mark.parametrize("entries,rounds", [(64, 5), (256, 2), (3, 1)])
def test_against_brute_force(spark, entries, rounds):
    rows, told = made(), []
    found = vector_codes(framed(spark, rows), entries=entries, rounds=rounds, told=told).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, entries, rounds)
    if rounds == 5:
        unmeasured = sum(needs.get(0, 0) for _, by_part in told[1:] for needs in by_part)
        assert unmeasured > 0


def test_few_vectors_none_and_too_many_entries(spark):
    rows = [(1, [0.0] * 8, 1), (2, [1.0] * 8, None)]
    found = vector_codes(framed(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, 256, 4)
    assert vector_codes(framed(spark, [(3, None, 1), (4, [], 1)])).count() == 0
    with pytest.raises(ValueError):
        vector_codes(framed(spark, rows), entries=257)


def test_bounds_over_many_rounds_and_widths():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.integers(-300, 300, size=(900, 5)), np.zeros((50, 5), int), rng.integers(-2, 3, size=(150, 5))]).astype(np.int64)
    entries = points[rng.choice(len(points), 40, replace=False)]
    bounds, widths = Bounds.measured(points, entries, 5), [5, 5, 3, 8, 12, 4, 39, 20]
    for width in widths:
        step = rng.integers(-12, 13, size=entries.shape) * (rng.random((40, 1)) < 0.5)
        drift = np.sqrt((step.astype(float) ** 2).sum(axis=1)) * (1 + 1e-6)
        entries = entries + step
        bounds.moved(drift).resized(width)
        need = bounds.settle(points, entries)
        assert (bounds.own == all_squares(points, entries).argmin(axis=1)).all()
        assert need.max() <= width + 1
        assert (np.diff(bounds.low, axis=1) >= 0)[np.isfinite(bounds.low[:, 1:])].all()


def test_widths_follow_the_needs():
    assert adapted(16, {0: 900, 2: 95, 9: 5}, 64) == 4
    assert adapted(16, {0: 500, 12: 500}, 64) == 12
    assert adapted(16, {0: 500, 17: 500}, 64) == 32
    assert adapted(16, {17: 10}, 20) == 20


def test_squares_of_large_numbers():
    big = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64)
    assert all_squares(big, -big)[0, 0] == 2 * (1 << 27) ** 2
