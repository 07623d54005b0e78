import hashlib
import random

from planloom.llm.line_dedup import common_lines, without_common_lines

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least_chars=20, least_documents=3):
    """(id, n_lines, n_dropped, kept text) in the order of docs."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(A_Z)
    rank = lambda d: (d is not None, d)
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < least_chars or len(holders[key(x)]) < least_documents or max(holders[key(x)], key=rank) == d
        ]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def made():
    rnd = random.Random(4)
    common = ["All rights reserved by us.", "  ALL rights reserved by us.\t", "é" * 20, "É" * 20, "x" * 19, "", "   ", "short"]
    docs = []
    for k in range(200):
        lines = [rnd.choice(common) if rnd.random() < 0.6 else f"A line of its own, number {rnd.randrange(400)}" for _ in range(rnd.randint(0, 9))]
        docs.append((k, "\n".join(lines)))
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "All rights reserved by us.\r\nAll rights reserved by us.")]
    docs += [(904, "the same two rows of one document\nb"), (904, "the same two rows of one document\nb"), (904, "the same two rows of one document")]
    docs += [(None, "a line that two ids and a null hold"), (905, "a line that two ids and a null hold"), (906, "a line that two ids and a null hold")]
    return docs


def test_against_brute_force(spark):
    docs = made()
    frame = spark.createDataFrame([(*d, 5, "z", 1) for d in docs], "doc_id bigint, text string, pos int, lines string, h1 int")
    assert got(without_common_lines(frame)) == brute(docs)
    assert got(without_common_lines(frame, least_chars=1, least_documents=2)) == brute(docs, 1, 2)
    want = sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)), key=repr)
    assert got(common_lines(frame)) == want


def test_ids_of_another_type(spark):
    docs = [(f"d{k}", t) for k, t in made()]
    assert got(without_common_lines(spark.createDataFrame(docs, "doc_id string, text string"))) == brute(docs)


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"this line is number {k % 5000} of them" for k in range(60_000))
    docs = [(1, long), (2, long), (3, long + "\nend")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r.doc_id: r for r in without_common_lines(frame).collect()}
    assert (rows[1].n_dropped, rows[1].kept_text, rows[3].n_dropped, rows[3].kept_text) == (60_000, "", 0, long + "\nend")
    assert common_lines(frame.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    frame = spark.createDataFrame(made(), "doc_id bigint, text string")
    plan = common_lines(frame)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
