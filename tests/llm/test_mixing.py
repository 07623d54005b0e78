import itertools
import random

from planloom.llm.mixing import fit, mix


def test_fit_is_best_on_small_cases():
    rnd = random.Random(3)
    for _ in range(200):
        lengths = rnd.sample(range(0, 12), 4)
        counts = [rnd.randint(1, 3) for _ in lengths]
        budget = rnd.randint(0, 40)
        got = fit(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        total = sum(n * g for n, g in zip(lengths, got, strict=True))
        best = max(
            s for pick in itertools.product(*(range(c + 1) for c in counts))
            if (s := sum(n * p for n, p in zip(lengths, pick, strict=True))) <= budget
        )
        assert total <= budget and best - total <= max(lengths)


def by_hand(words, weights=(3, 1, 2)):
    """The rule as stated: reshare what is above until none is."""
    names = sorted((n for n in words if n is not None)) + ([None] if None in words else [])
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    cap = {n: 2.0 * words[n] for n in names}
    target, full, left = {}, set(), 1.5 * sum(words.values())
    while True:
        open_ = [n for n in names if n not in full]
        total = sum(weight[n] for n in open_)
        part = {n: left * weight[n] / total for n in open_}
        over = [n for n in open_ if part[n] > cap[n]]
        if not over:
            return target | part
        for n in over:
            full.add(n)
            target[n] = cap[n]
            left -= cap[n]


def check(rows, docs):
    words = {}
    for _, text, source in docs:
        words[source] = words.get(source, 0) + len((text or "").split())
    want = by_hand(words)
    taken, source_of = {}, {d[0]: d[2] for d in docs}
    for r in rows:
        s = source_of[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == words[s]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    longest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= max(1, min(longest, 0.02 * want[s] + 1)) for s in want)


def test_mix_of_a_hot_source_and_nulls(spark):
    rnd = random.Random(9)
    docs = [(k, "w " * rnd.randint(0, 60), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(900)]
    docs += [(900, None, None), (901, "a b c", None), (902, "", "empty")]
    frame = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id bigint, text string, source string, size int, target string")
    rows = mix(frame).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    again = mix(frame.repartition(7)).collect()
    assert sorted(r.taken for r in again) == sorted(r.taken for r in rows)
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [(r.taken, r.target) for r in mix(none).collect()] == [(0, 0.0), (0, 0.0)]
    twice = spark.createDataFrame([(1, "a b", "s")] * 4, "doc_id bigint, text string, source string")
    assert sum(r.taken for r in mix(twice).collect()) == 12


def test_whole_table(spark, small_folder):
    from planloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small_folder}/documents.parquet").collect()]
    check(QUERIES["op3_mixing"](spark, small_folder).collect(), docs)
