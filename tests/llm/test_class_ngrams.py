import collections
import math
import random
import zlib

import numpy as np
import pytest

from planloom.llm import class_ngrams as cn

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(A_Z)).split(" ") if w] + [None]


def out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def base(docs):
    counts = collections.Counter(w for d, t in docs if not out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, {
        (d, t): (len(w := tokens(t)), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, t in docs
    }


def check(rows, docs):
    n, want = base(docs)
    texts = collections.defaultdict(list)
    for d, t in docs:
        texts[d].append(want[d, t])
    for r in rows:
        assert r.train_tokens == n and r.held_out == out(r.doc_id)
        assert any((r.n_tokens, r.n_known) == x[:2] and r.base_score == pytest.approx(x[2], rel=1e-9) for x in texts[r.doc_id])
    assert len(rows) == len(docs)


def test_base_scores_and_edges(spark):
    rnd = random.Random(2)
    docs = [(k, " ".join(rnd.choice(["The", "the", "of", "É", "é", "x y", f"r{rnd.randint(0, 400)}"]) for _ in range(rnd.randint(0, 60)))) for k in range(150)]
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "w\x0bv " * 5000), (None, "the of"), (5, "again the"), (5, "again the")]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id bigint, text string, n_tokens int, key string")
    check(cn.score_corpus(frame).collect(), docs)
    assert cn.score_corpus(frame.limit(0)).count() == 0
    only = spark.createDataFrame([(d, "a b") for d in range(60) if out(d)], "doc_id bigint, text string")
    assert {(r.n_known, r.base_score) for r in cn.score_corpus(only).collect()} == {(0, 0.0)}


def test_probabilities_of_a_class_sum_to_one(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(30))) for k in range(40)], "id bigint, text string")
    model, rare = cn.train(docs)
    assert np.allclose((10.0**model.moves).sum(axis=1), 1)
    counts = {r.key: r.n for r in cn.word_counts(docs).collect()}
    keys = np.array(list(counts), np.int64).view(np.uint64)
    mass = np.bincount(model.classes[model.units(keys)], np.array(list(counts.values())) + 1.0, len(model.class_room))
    mass[model.classes[-1]] += model.end_count + 1
    assert np.allclose(mass + 1, 10**model.class_room)


def test_exchange_finds_alternating_classes():
    pairs = np.zeros((8, 8))
    for a in range(4):
        for b in range(4, 8):
            pairs[a, b] = pairs[b, a] = 10 + a + b
    classes = cn.exchange(pairs, 2)
    assert len(set(classes[:4])) == len(set(classes[4:])) == 1 and classes[0] != classes[4]


def test_whole_table_and_gain_on_held_out_documents(spark):
    from planloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op7_class_ngrams"](spark, folder).collect()
    check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.99 * sum(r.base_score for r in held)
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
