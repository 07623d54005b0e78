"""Nearest neighbours by pivots against all pairs."""

import numpy as np
import pandas as pd

from planloom.operators import grounding

KIND = "project_id int, query_id int, vector array<double>"


def brute(vectors, asked, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    out = []
    for project in sorted({p for p, _, _ in asked}):
        ids = [i for p, i, _ in vectors if p == project]
        if not ids:
            continue
        corpus = unit(np.array([v for p, _, v in vectors if p == project], float))
        for p, q, v in asked:
            if p == project:
                far = np.round(1.0 - corpus @ unit(np.array([v], float))[0], 6) + 0.0
                best = sorted(zip(far.tolist(), ids, strict=True))[:k]
                out += [(project, q, i, d, n) for n, (d, i) in enumerate(best, 1)]
    return sorted(out)


def got(spark, vectors, asked, k, **options):
    queries = spark.createDataFrame(asked, KIND)
    corpus = spark.createDataFrame(vectors, KIND.replace("query_id", "chunk_id"))
    rows = grounding.nearest(queries, corpus, k, **options).collect()
    return sorted((r.project_id, r.query_id, r.chunk_id, r.distance + 0.0, r["rank"]) for r in rows)


def made(clusters, n, spread, project=1, seed=1, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return [(project, k, (centres[k % clusters] + spread * rng.normal(size=size)).tolist()) for k in range(n)]


def test_clusters_are_ruled_out_and_nothing_is_lost(spark):
    vectors, told = made(12, 900, 0.05), []
    assert got(spark, vectors, vectors, 4, block=40, told=told) == brute(vectors, vectors, 4)
    met, pairs = told[0]
    assert pairs == 900 * 900 and met < pairs / 2


def test_spread_vectors_ties_zeros_and_small_projects(spark):
    vectors = made(1, 150, 1.0) + made(3, 3, 0.1, project=2) + [(1, 900 + k, [0.0] * 12) for k in range(3)]
    vectors += [(1, 950 + k, vectors[5][2]) for k in range(30)] + [(3, 1, [1.0] + [0.0] * 11)]
    asked = vectors + [(7, 1, [1.0] * 12)]  # a project without a corpus
    want = brute(vectors, vectors, 5)
    assert got(spark, vectors, asked, 5, block=16) == want
    assert got(spark, vectors, asked, 5) == want


def test_large_blocks_are_compared_by_some_rows_at_a_time(monkeypatch):
    vectors, held, sort = made(1, 1200, 1.0), [], np.argsort
    monkeypatch.setattr(grounding.np, "argsort", lambda m, **options: held.append(np.shape(m)) or sort(m, **options))
    unit = [np.array(v) / np.linalg.norm(v) for _, _, v in vectors]
    far = [np.zeros(1)] * len(unit)
    rows = {"project_id": 1, "vector": unit, "far": far}
    best, _ = grounding._closest(3, {"project_id": "int", "query_id": "int", "chunk_id": "int"})
    got = best(pd.DataFrame({**rows, "query_id": range(1200), "reach": 4.0}), pd.DataFrame({**rows, "chunk_id": range(1200)}))
    want = [(q, i, d) for _, q, i, d, _ in brute(vectors, vectors, 3)]
    assert sorted(zip(got["query_id"], got["chunk_id"], got["distance"] + 0.0, strict=True)) == sorted(want)
    # No matrix of all distances of two blocks, whatever their size.
    assert max(shape[0] for shape in held if len(shape) == 2) <= grounding.ROWS
