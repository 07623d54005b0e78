import random
import re

import numpy as np
import pytest

from planloom.llm import near_dedup as nd
from planloom.llm.components import components

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if len(w) >= size else frozenset([tuple(w)])


def brute(docs, size=4, percent=80):
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[max(top(k), top(j))] = min(top(k), top(j))
    least = {}
    for k, (d, _) in enumerate(docs):
        least[top(k)] = min(d, least.get(top(k), d))
    return sorted((d, len(sets[k]), least[top(k)], d == least[top(k)]) for k, (d, _) in enumerate(docs))


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
    return words


def family_docs():
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    docs = []
    base = [word() for _ in range(120)]
    for _ in range(420):  # a family whose pairs lie around the threshold
        docs.append(" ".join(edited(rnd, base, rnd.choice([0, 1, 1, 2, 3, 5]))))
    for _ in range(60):
        other = [word() for _ in range(rnd.randint(1, 60))]
        docs += [" ".join(edited(rnd, other, rnd.randint(0, 1))).upper() for _ in range(3)]
    docs += ["", None, " \t\n", "one", "ONE", "one two", "one two three four five", "one two three four five six"]
    rows = [(k + 1, t) for k, t in enumerate(docs)]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 64)
    docs = family_docs()
    frame = spark.createDataFrame([(*d, 1, b"k") for d in docs], "doc_id bigint, text string, n int, s binary")
    got = sorted(map(tuple, nd.near_duplicates(frame).collect()))
    assert got == brute(docs)
    kept = nd.without_near_duplicates(frame, size=4)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, k in brute(docs) if k]


def test_edges(spark):
    frame = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id bigint, text string")
    rows = nd.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [
        ("3", "3", True), ("3", "3", True), ("None", "3", False), ("None", "None", True),
    ]
    assert nd.near_duplicates(frame.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "1 2 3 4 5 6 7 8"
    rows = [(1, a), (1, a), (1, a.upper()), (2, a), (2, b), (3, b), (2, c), (0, c), (None, a), (None, "x y z u v w"), (7, None), (7, None), (7, " ")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, _text_hash int")
    kept = nd.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect())
    assert got == [("0", c), ("1", a), ("2", b), ("7", ""), ("7", " "), ("None", "x y z u v w")]


def test_registers_agree_as_sets_do():
    rng = np.random.default_rng(5)
    for n, common in ((600, 500), (30, 20), (5, 4)):
        shared = []
        for _ in range(60):
            x = rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - common:])
            law = nd.zero_law(np.array([n]))
            shared.append(nd.estimate(np.array([(nd.registers(a) == nd.registers(b)).mean()]), nd.chance(law, law))[0])
        assert np.mean(shared) == pytest.approx(common / (2 * n - common), abs=0.05)


def test_components(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 200)] + [(500, 500), (7, 3)]
    rnd.shuffle(links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(200)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_whole_table(spark, small_folder):
    from planloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_folder}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op2_near_dedup"](spark, small_folder).collect())) == brute(docs)
