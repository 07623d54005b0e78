import random

import corpus_pipeline as cp
from planloom.llm import decontaminate as dc
from test_exact_dedup import A_Z
from test_near_dedup import brute as near_groups


def test_stages_on_the_whole_table(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_folder}/benchmark.parquet").collect()]
    find = dc.Finder(items)
    frame, columns = docs, docs.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in frame.collect()}
        frame = cp.stored(stage(spark, frame, small_folder))
        after = {r.doc_id: r for r in frame.collect()}
        if name == "language":
            assert all(not any(c.isalpha() for c in before[d].text or "") for d in before.keys() - after.keys())
        elif name == "exact":
            last = {}
            for d, r in before.items():
                t = (r.text or "").translate(A_Z)
                last[t] = max(d, last.get(t, d))
            assert after.keys() == set(last.values())
        elif name == "near":
            assert after.keys() == {d for d, _, _, k in near_groups([(d, r.text) for d, r in before.items()], 5) if k}
        elif name == "benchmark":
            assert after.keys() == {d for d, r in before.items() if not find(r.text or "")}
        else:
            assert after.keys() == before.keys()
            assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in after.values())
        if name != "mixture":
            assert frame.columns == columns and all(after[d] == before[d] for d in after)


def test_awkward_rows(spark, tmp_path):
    rnd = random.Random(1)
    words = [rnd.choice("the of and la der que".split()) + str(k) for k in range(60)]
    rows = [(k, " ".join(rnd.sample(words, 30)), "en", "s", 1) for k in range(20)] + [(3, None, None, None, None), (None, None, "en", None, 0)]
    rows += [(5, rows[5][1], "en", "s", 1)] * 2 + [(None, rows[6][1], None, None, None)]
    folder = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, size int"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this kind is in any text")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert sorted(r.doc_id for r in cp.run(spark, folder).collect()) == list(range(20))
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0
