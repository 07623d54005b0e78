"""Grounding policy, drift sequences, retrieval and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.operators import board, grounding
from planloom.sources import sinks


def graded(spark, verdicts):
    tasks = spark.createDataFrame([(1, i) for i in range(len(verdicts))], "project_id int, task_id int")
    rows = [(1, i, v) for i, vs in enumerate(verdicts) for v in vs]
    judged = spark.createDataFrame(rows, "project_id int, task_id int, verdict string")
    return [r for r in grounding.task_scores(tasks, judged).orderBy("task_id").collect()], judged


def test_scores_and_policy(spark):
    s, u, c = "supported", "unsupported", "contradicted"
    cases = [([s] * 10, 1.0, "accept"), ([s] * 9 + [u], 0.9, "accept"), ([s] * 8 + [u] * 2, 0.8, "review"), ([s] * 3 + [u], 0.75, "review"),
             ([s, s, u, u], 0.5, "reject"), ([s, u, u, u], 0.25, "reject"), ([s] * 9 + [c], 0.9, "reject"), ([], 1.0, "accept")]
    got, _ = graded(spark, [v for v, *_ in cases])
    assert [(r.score, r.status) for r in got] == [(score, status) for _, score, status in cases]


def test_project_score_is_pooled(spark):
    _, judged = graded(spark, [["supported"], ["unsupported"] * 9])
    projects = spark.createDataFrame([(1,), (2,)], "project_id int")
    assert {r.project_id: r.score for r in grounding.project_scores(projects, judged).collect()} == {1: 0.1, 2: 1.0}


def test_nearest_equals_brute_force_across_blocks(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(90, 8))
    rows = [(0 if i < 70 else 1, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "project_id int, id int, vector array<double>")
    got = grounding.nearest(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), 4, block=16)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for project, i, _ in rows:
        same = [j for p, j, _ in rows if p == project]
        want = sorted(same, key=lambda j: (round(1 - float(unit[i] @ unit[j]), 6), j))[:4]
        assert found[i] == want


STATE = "project_id int, task_id int, kind string, detail string, first_seen_at int, notified_at int, resolved_at int"
CARDS = ("board_id string, card_id string, list_name string, title string, body string, archived boolean, members array<string>")


def planned(spark):
    rows = [(1, "B", t, f"Task {t}", "technical", f"c{t}", "", "", "") for t in (1, 2)]
    return spark.createDataFrame(rows, "project_id int, board_id string, task_id int, title string, team string, external_ref string, "
                                       "account_id string, owner string, board_fingerprint string")


def check(spark, state, where, now):
    """One check of both tasks; `where` names each card's list, an empty mapping an unreadable board."""
    cards = spark.createDataFrame([("B", f"c{t}", name, f"Task {t}", "b", False, []) for t, name in where.items()], CARDS)
    found = board.detect(planned(spark), cards)
    checked = planned(spark).join(cards.select("board_id").distinct(), "board_id", "left_semi")
    rows = board.reconcile(state, found, checked, F.lit(now)).collect()
    kept = [tuple(r)[:7] for r in rows]
    return spark.createDataFrame(kept, STATE), sum(r.fresh for r in rows), sum(r.resolved_at is None for r in rows)


def test_drift_is_reported_once_and_again_when_it_recurs(spark):
    state = spark.createDataFrame([], STATE)
    home, done = {1: "Technical", 2: "Technical"}, {1: "Done", 2: "Technical"}
    seen = []
    for now, where in enumerate([home, done, done, home, done, {}], start=1):
        state, fresh, still_open = check(spark, state, where, now)
        seen.append((fresh, still_open))
    assert seen == [(0, 0), (1, 1), (0, 1), (0, 0), (1, 1), (0, 1)]


def test_partial_check_settles_only_what_it_looked_at(spark):
    state = spark.createDataFrame([(1, 1, "moved", "x", 1, None, None), (1, 2, "moved", "x", 1, None, None)], STATE)
    nothing = board.detect(planned(spark).limit(0), spark.createDataFrame([], CARDS))
    rows = board.reconcile(state, nothing, planned(spark).filter("task_id = 1"), F.lit(9)).collect()
    assert {r.task_id: r.resolved_at for r in rows} == {1: 9, 2: None}


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([("Títle", "body")], "t string, b string")
    assert df.select(board.fingerprint(F.col("t"), F.col("b"))).first()[0] == hashlib.sha256("Títle\x00body".encode()).hexdigest()[:32]


def test_replacing_sink(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    sinks.create(spark.createDataFrame([(p, f"old{p}") for p in range(6)], "project_id int, v string"), path, "project_id", 4)
    new = spark.createDataFrame([(1, "new1"), (1, "new1b")], "project_id int, v string")
    gone = spark.createDataFrame([(1,), (2,)], "project_id int")
    # A write that breaks off, here in the middle of its own job, leaves the table as it was.
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "stored", lambda df: df)
        broken = new.withColumn("v", F.when(F.col("v") == "new1b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
        with pytest.raises(Exception, match="lost"):
            sinks.replace(broken, path, ["project_id"], gone)
    assert sorted(tuple(r) for r in sinks.read(spark, path).collect()) == [(p, f"old{p}") for p in range(6)]
    for _ in range(2):  # a second run replaces, it does not add
        sinks.replace(new, path, ["project_id"], gone)
    want = [(0, "old0"), (1, "new1"), (1, "new1b"), (3, "old3"), (4, "old4"), (5, "old5")]
    assert sorted(tuple(r) for r in sinks.read(spark, path).collect()) == want
    everything = spark.createDataFrame([(p,) for p in range(6)], "project_id int")
    sinks.replace(new.limit(0), path, ["project_id"], everything)
    assert sinks.read(spark, path).count() == 0
    sinks.replace(new, path, ["project_id"], gone)
    assert sorted(tuple(r) for r in sinks.read(spark, path).collect()) == [(1, "new1"), (1, "new1b")]


def test_long_cards_go_out_in_parts_and_lose_nothing(spark):
    title, text = "T" * 25, "".join(chr(97 + k % 26) for k in range(73))
    row = (1, 1, "", title, text, "technical", "", "explicit", "accept", None, "")
    cards = spark.createDataFrame(
        [row], "project_id int, task_id int, external_ref string, title string, body string, team string, assignee_role string, "
        "source_status string, validation_status string, due_date date, account_id string")
    parts = sorted(board.payload(cards, 20).collect(), key=lambda r: r.part_no)
    assert [r.part_no for r in parts] == [1, 2, 3, 4]
    assert "".join(r.name for r in parts) == title and "".join(r.desc for r in parts) == text


def test_every_missing_dependency_is_a_row(spark):
    tasks = spark.createDataFrame([(1, k, f"t{k}", "x" if k == 0 else "") for k in range(7)], "project_id int, task_id int, title string, external_ref string")
    deps = spark.createDataFrame([(1, 0, k) for k in range(1, 7)], "project_id int, task_id int, depends_on_id int")
    assert {r.depends_on_id for r in board.dangling(tasks, deps).collect()} == set(range(1, 7))
