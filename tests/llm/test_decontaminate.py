import random

import numpy as np

from planloom.llm import decontaminate as dc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for k, y in enumerate(b, 1):
            row.append(min(before[k - 1] + (x != y), before[k] + 1, row[k - 1] + 1))
    return row[-1]


def brute(text, items):
    words, out = dc.WORDS((text or "").lower()), {}
    for item, body in items:
        want = dc.WORDS((body or "").lower())
        if not want:
            continue
        if len(want) < dc.LEAST_WORDS:
            if words == want:
                out[item] = 0
            continue
        d = int(dc.EDITS * len(want))
        best = min(
            distance(want, words[a:a + n]) for n in range(max(0, len(want) - d), len(want) + d + 1) for a in range(max(1, len(words) - n + 1))
        )
        if best <= d:
            out[item] = best
    return out


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        k = rnd.randrange(len(words))
        words[k:k + 1] = rnd.choice([[], ["new"], [words[k], "more"]])
    return words


def test_against_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 8, 12, 20, 40])))) for k in range(25)]
    items += [(90, "the of"), (91, None), (92, "")]
    docs = [(1, None), (2, ""), (3, "the OF!"), (4, "the of and more")]
    for k in range(60):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if k % 2:
            words = items[k % 25][1].split()
            at = rnd.randint(0, len(body))
            body[at:at] = edited(rnd, words, rnd.randint(0, int(0.22 * len(words)) + 1))
        docs.append((10 + k, " ".join(body).upper() + "."))
    frame = spark.createDataFrame([(*d, 0, "s") for d in docs], "doc_id bigint, text string, edits int, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contamination(frame, bench, items_at_a_time=11).collect()}
    want = {(d, i): e for d, t in docs for i, e in brute(t, items).items()}
    assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want) and all(k in got for k, e in want.items() if e == 0)
    clean = dc.without_leaks(frame, bench)
    assert clean.columns == frame.columns and clean.count() == len(docs) - len({d for d, _ in got})
    assert dc.contamination(frame.limit(0), bench).count() == dc.contamination(frame, bench.limit(0)).count() == 0


def test_long_items_at_the_limit_are_all_found():
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(n))) for k, n in enumerate([100, 200, 400] * 8)]
    find = dc.Finder(items)
    for k, text in items:
        words = text.split()
        d = int(dc.EDITS * len(words))
        replaced = list(words)
        for at in rnd.sample(range(len(words)), d):
            replaced[at] = "new"
        for body in (replaced, edited(rnd, words, d)):
            around = [rnd.choice(vocabulary) for _ in range(60)]
            got = {i: (e, a, b) for i, e, _, a, b in find(" ".join(around[:30] + body + around[30:]))}
            assert k in got and got[k][0] <= d
            e, a, b = got[k]
            assert distance(words, (around[:30] + body + around[30:])[a:b]) == e


def test_best_match_against_all_stretches():
    rnd = random.Random(5)
    for _ in range(300):
        item, text = ([rnd.randrange(4) for _ in range(rnd.randint(1, n))] for n in (9, 14))
        edits, start, end = dc.best_match(item, text)
        every = [(distance(item, text[a:b]), b, a) for b in range(len(text) + 1) for a in range(b + 1)]
        assert (edits, end, start) == min(every)


def test_walks_keep_close_sequences_close():
    rnd = random.Random(8)
    words = [rnd.randrange(1, 999) for _ in range(40)]
    changed = words[:20] + words[21:] + [7]
    a, b = (dc.walks(np.array([w]), np.arange(5), 80) for w in (words, changed))
    assert (a != b).mean() < 0.35
    assert (a != dc.walks(np.array([words[::-1]]), np.arange(5), 80)).mean() > 0.9


def test_whole_table_finds_every_verbatim_item(spark, small_folder):
    from planloom.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontaminate"](spark, small_folder).collect()}
    items = spark.read.parquet(f"{small_folder}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{small_folder}/documents.parquet").collect()
    verbatim = {(d.doc_id, i.item_id) for d in docs for i in items if d.text and i.text in d.text}
    assert verbatim and verbatim <= got


def test_parts_of_a_text_change_nothing(monkeypatch):
    """However small the parts, the matches are those of the text as a whole."""
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 12, int(rng.integers(5, 40))))) for k in range(30)]
    words = [f"w{x}" for x in rng.integers(0, 12, 1500)]
    for k in range(0, 30, 3):
        planted = items[k][1].split()
        planted[len(planted) // 2] = "other"
        words[40 * k:40 * k + len(planted)] = planted
    find, text = dc.Finder(items), " ".join(words)
    whole = find(text)
    assert len(whole) >= 10
    for pairs in (1, 7, 100):
        monkeypatch.setattr(dc, "PAIRS", pairs)
        assert sorted(find(text)) == sorted(whole)


def test_repetitive_text_stays_small():
    """Many items that hold the same run, and a long text that is nothing but this run."""
    import resource

    items = [(k, "yes no " * 20 + f"end{k} of item") for k in range(200)]
    find = dc.Finder(items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = find("yes no " * 5_000)
    assert len(found) == 200 and {f[1] for f in found} == {3}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kB
