import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from planloom.llm import language as lg


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 3, 1])
    start, moves = rng.normal(size=2), rng.normal(size=(2, 2))
    place = lg.by_step(lengths)
    scores = rng.normal(size=(8, 2))
    post, expected, log_z = lg.forward_backward(scores[place], lengths, start, moves)
    laid = np.empty_like(post)
    laid[place] = post
    want, want_moves, want_z = np.zeros((8, 2)), np.zeros((2, 2)), 0.0
    for first, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        total, part, part_moves = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            s = start[path[0]] + sum(scores[first + k, path[k]] for k in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
            p = np.exp(s)
            total += p
            for k in range(n):
                part[k, path[k]] += p
            for a, b in itertools.pairwise(path):
                part_moves[a, b] += p
        want[first:first + n], want_z = part / total, want_z + np.log(total)
        want_moves += part_moves / total
    start_shift = 0.0
    assert np.allclose(laid, want) and np.allclose(expected, want_moves) and abs(log_z - want_z - start_shift) < 1e-9


def made(rnd, lang, n):
    parts = {"aa": ["lo", "mi", "za"], "bb": ["ku", "ty", "ren"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_predictions_edges_and_code_switching(spark):
    rnd = random.Random(3)
    docs = [(k, made(rnd, lang, rnd.randint(5, 40)), lang) for k in range(240) for lang in [rnd.choice(["aa", "bb"])]]
    docs += [(500, None, "aa"), (501, "12 34 -", "bb"), (502, "", None), (503, made(rnd, "aa", 9000), None), (None, made(rnd, "bb", 9), "bb")]
    docs += [(504, made(rnd, "aa", 30) + " " + made(rnd, "bb", 60), None)] * 2
    frame = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id bigint, text string, lang string, score double")
    rows = lg.identify(frame).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert all(by[d].lang_pred == lang for d, _, lang in docs[:240])
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (500, 501, 502))
    assert by[503].lang_pred == "aa" and by[503].n_words == 9000
    assert by[504].lang_pred == "bb" and by[504].switches == 1 and 0.5 < by[504].score < 0.8
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = lg.with_language(frame)
    assert kept.columns == frame.columns and kept.count() == len(docs) - 3
    assert lg.identify(frame.limit(0)).count() == 0
    unlabelled = lg.identify(frame.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_every_language_is_a_label_and_only_und_goes(spark):
    """70 languages of an own letter each; the last texts hold words of four of them in equal parts."""
    docs = [(k, " ".join([chr(0x4E00 + k % 70) * n for n in (2, 3, 4)] * 4), f"l{k % 70:02d}") for k in range(70 * 8)]
    docs += [(900, " ".join(chr(0x4E00 + k) * 3 for k in range(4) for _ in range(12)), None), (901, "12", None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    by = {r.doc_id: r for r in lg.identify(frame).collect()}
    assert len({by[d].lang_pred for d, _, lang in docs if lang}) == 70
    assert all(by[d].lang_pred == lang for d, _, lang in docs if lang) and by[900].score < 0.3
    assert lg.with_language(frame).count() == len(docs) - 1


def test_accuracy_on_held_out_documents(spark):
    from planloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, folder).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
