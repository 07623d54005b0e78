"""Projects that lie together, and the large ones that do not, on rows of their own."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from planloom import vocab
from planloom.operators import board, graph, roles, windows
from planloom.plans import registry
from planloom.plans.queries import QUERIES
from planloom.plans.registry import Catalog

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date, o_totalprice double"
LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_shipdate date"


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(1995, 3, 1)
    orders = [(k, k % 5, "OFP"[k % 3], day + datetime.timedelta(k), 10.0 * k) for k in [*range(1, 30), 83, 97, 194]] + [(7, 2, "O", day, 1.0), (None, 3, "F", day, 1.0)]
    lines = [(k, n, 10 * k + n, k + n, 9.0 * n, "ANR"[n % 3], day) for k in [*range(1, 30), 83, 97, 194] for n in range(1, 4 + k % 6)] + [(None, 1, 2, 3, 4.0, "A", day)]
    people = [(k, f"Supplier#{k:09d}", k % 25, float(k % 3)) for k in range(60)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(people, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def _rows(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


@pytest.mark.parametrize("name", ["ms_segments", "view_structure"])
def test_rows_are_the_same_where_projects_are_dealt_or_large(spark, folder, monkeypatch, name):
    with monkeypatch.context() as m:
        # As without by_project(): every join deals its rows out.
        m.setattr(Catalog, "by_project", lambda c, build: build(c))
        registry.forget_stages()
        want = _rows(QUERIES[name](spark, folder))
    registry.forget_stages()
    dealt = _rows(QUERIES[name](spark, folder))
    assert want and dealt == want
    # Some projects have more rows than that, some not.
    monkeypatch.setattr(graph, "WHOLE", 6)
    registry.forget_stages()
    assert _rows(QUERIES[name](spark, folder)) == want
    assert {key[3] for key in registry._stages} >= {"dealt", "large"}
    registry.forget_stages()


def test_what_lies_by_project_is_not_moved_again(spark, folder):
    registry.forget_stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = {}

        def joins(c):
            tasks, chunks, deps = (c.view(n) for n in ("v_tasks", "v_chunks", "v_deps"))
            seen["parts"] = c.parts
            cited = c.view("v_stories").join(tasks.select("project_id", "task_id", "team"), ["project_id", "task_id"], "left")
            counted = cited.groupBy("project_id", "team").agg(F.count("*").alias("n")).join(chunks.select("project_id", "chunk_key"), "project_id")
            return counted.join(deps.select("project_id", "slot"), "project_id", "left")

        rows = Catalog(spark, folder).by_project(joins)
        assert seen["parts"] and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crowded_keys_are_those_of_too_many_rows(spark):
    rows = spark.createDataFrame([(k,) for k in [1, 2, 2, 3, 3, 3, None, None, None, None]], "k bigint")
    assert [r.k for r in windows.crowded(rows, 2).collect()] == [3]
    assert windows.crowded(rows, 3) is None


def test_words_of_the_roster_are_those_found_in_rows(spark):
    titles = [t for t, *_ in vocab.ROSTER] + ["ML-Engineer / QA", "ops  Manager"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.w for r in rows.select(roles.tokens(F.col("t")).alias("w")).collect()] == [roles.fixed_tokens(t) for t in titles]


def test_checklists_compared_whole_are_those_compared_by_joins(spark, monkeypatch):
    wanted = [(card, name, item, pos) for card, name in itertools.product([1, 2, None], ["a", "b"]) for pos, item in enumerate(["x", "y", "y", None, "z"])] + [(3, "a", "x", None), (4, "a", "x", 0), (4, "a", "y", 1)]
    present = [(1, "a", "x", 5), (1, "a", "z", 3), (1, "a", None, 9), (1, "c", "x", 1), (2, "a", "y", 2), (2, "a", "y", None), (2, None, "x", 1), (None, "a", "x", 1),
               (2, "b", "x", 1), (2, "b", "y", 2), (2, "b", "z", 4), (3, "a", "x", 7), (4, "a", "x", 5), (4, "a", "y", 6)]
    w = spark.createDataFrame(wanted, "card_id bigint, list_name string, item string, want_pos int")
    p = spark.createDataFrame(present, "card_id bigint, list_name string, item string, have_pos int")
    want = _rows(board._diff_by_joins(w, p))
    assert len({r.split("action='")[1].split("'")[0] for r in want}) == 5
    assert _rows(board._diff_whole(w, p)) == want == _rows(board.checklist_diff(w, p))
    monkeypatch.setattr(board, "WHOLE", 7)  # some lists are longer, some not
    assert _rows(board.checklist_diff(w, p)) == want
