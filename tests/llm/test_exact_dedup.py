import hashlib
import random

from pyspark.sql import functions as F

from planloom.llm.exact_dedup import exact_duplicates, without_duplicates

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault((t or "").translate(A_Z), []).append(d)
    rank = lambda d: -1 if d is None else d
    return sorted(
        (rank(d), rank(max(g, key=rank)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g
    )


def got(frame):
    rank = lambda d: -1 if d is None else d
    rows = frame.collect()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    return sorted((rank(r.doc_id), rank(r.keep_id), r.group_size, r.text_sha256) for r in rows)


def made():
    rnd = random.Random(2)
    base = ["", None, "É", "é", "ABC", "abc", "x" * 50, "X" * 50, "日本" * 9]
    base += ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    docs = [(k, rnd.choice(base)) for k in range(300)]
    return docs + [(7000, "abc"), (7000, "abc"), (None, "abc"), (None, "alone")]


def test_small_blocks_against_brute_force(spark):
    docs = made()
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id bigint, text string, row int, name string")
    for size in (1, 3, 4096):
        assert got(exact_duplicates(frame, size)) == brute(docs)


def test_blocks_that_share_a_fingerprint(spark):
    docs = made()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    weak = lambda block: F.octet_length(block).cast("bigint")
    assert got(exact_duplicates(frame, 4, fingerprint=weak)) == brute(docs)


def test_empty_table_and_filter(spark):
    frame = spark.createDataFrame(made(), "doc_id bigint, text string")
    assert exact_duplicates(frame.limit(0)).count() == 0
    kept = without_duplicates(frame.withColumn("_s", F.lit(1)).withColumn("kept", F.lit("k")))
    assert kept.columns == ["doc_id", "text", "_s", "kept"]
    texts = [(t or "").translate(A_Z) for _, t in made()]
    assert sorted((r.text or "").translate(A_Z) for r in kept.collect()) == sorted(set(texts))
