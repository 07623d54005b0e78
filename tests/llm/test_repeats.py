import hashlib
import random

import numpy as np

from planloom.llm.repeats import repeated_spans, runs_of


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = {}
    for r in raws:
        for k in range(len(r) - length + 1):
            w = r[k:k + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _), r in zip(docs, raws, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame, length):
    rows = repeated_spans(frame, length).collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in rows)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def made(rnd):
    text = lambda n: "".join(rnd.choice("abcdé 🙂") for _ in range(n))
    passages = [text(rnd.randint(20, 90)) for _ in range(6)]
    docs = []
    for k in range(70):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts += [p[a:rnd.randint(a, len(p))], text(rnd.randint(0, 20))]
        docs.append((k, "".join(parts)))
    docs += [(100, "z" * 300), (101, "xyz" * 60), (102, "q" * 31 + "r"), (103, "p" + "q" * 31)]
    return docs + [(104, None), (105, ""), (106, docs[3][1]), (7, docs[7][1]), (None, docs[9][1] + "!")]


def test_against_brute_force(spark):
    for seed, length in ((1, 30), (2, 41), (3, 2)):
        docs = made(random.Random(seed))
        frame = spark.createDataFrame([(*d, 4, b"k") for d in docs], "doc_id bigint, text string, n_bytes int, raw binary")
        assert got(frame, length) == brute(docs, length)
    assert repeated_spans(frame.limit(0), 30).count() == 0


def test_runs_cover_every_window_once_with_its_leftmost_least_gram():
    rnd = random.Random(5)
    for text in ["a" * 50, "ab" * 40] + ["".join(rnd.choice("ab") for _ in range(rnd.randint(30, 200))) for _ in range(30)]:
        core, _, a, lo, hi = runs_of(text.encode(), 20, 8)
        assert np.array_equal(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)]), np.arange(len(text) - 19))
        assert all(y >= x and y + 8 <= z + 20 for x, y, z in zip(hi, a, lo, strict=True))
        by_gram = {}
        for c, y in zip(core.tolist(), a.tolist(), strict=True):
            assert by_gram.setdefault(text[y:y + 8], c) == c


def test_whole_table(spark, small_folder):
    from planloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_folder}/documents.parquet").collect()]
    rows = QUERIES["op8_repeats"](spark, small_folder).collect()
    want = brute(docs, 400)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want and any(w[2] for w in want)
