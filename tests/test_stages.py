"""Stage boundaries, answer files and one-pass views, on rows of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

from planloom.plans import registry, source_queries
from planloom.plans.adapters import DUCK
from planloom.plans.queries import QUERIES
from planloom.plans.registry import Catalog

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate date, o_totalprice double"
LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_shipdate date"


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(1995, 3, 1)
    orders = [(k, k % 5, "OFP"[k % 3], day, 10.0 * k) for k in range(1, 40)] + [(7, 2, "O", day, 1.0), (None, 3, "F", day, 1.0)]
    lines = [(k, n, 10 * k + n, k + n, float(n), "ANR"[n % 3], day) for k in range(1, 40) for n in range(1, 6)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_stages_are_written_as_columns_once(spark, folder):
    c = Catalog(spark, folder)
    tasks = c.stage("v_tasks", lambda c: c.view("v_tasks"))
    files = tasks.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
    assert Catalog(spark, folder).stage("v_tasks", lambda c: 1 / 0) is tasks
    assert sorted(tasks.collect(), key=str) == sorted(c.view("v_tasks").collect(), key=str)


def test_answers_are_read_from_the_compressed_files_they_were_written_to(spark, folder):
    files = source_queries.answers(Catalog(spark, folder)).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


@pytest.mark.parametrize("name", ["v_requirements", "v_milestones", "v_project_roles"])
def test_views_in_one_pass_give_the_rows_of_their_unions(spark, folder, name):
    c = Catalog(spark, folder)
    names = {"orders": c.table("orders"), "v_projects": c.view("v_projects")}
    text = DUCK[name].replace("FROM orders", "FROM {orders}").replace("FROM v_projects", "FROM {v_projects}")
    want = spark.sql(text, **{n: f for n, f in names.items() if "{" + n + "}" in text})
    got = c.view(name)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    # The base table is read once.
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_evidence_is_given_for_every_task(spark, folder):
    found = {(r.project_id, r.task_id) for r in QUERIES["cite_task_evidence"](spark, folder).collect()}
    cited = {(r.project_id, r.task_id) for r in QUERIES["cite_valid"](spark, folder).collect()}
    tasks = {(r.project_id, r.task_id): r.review_status for r in Catalog(spark, folder).view("v_tasks").collect()}
    assert found == cited and {tasks[t] for t in found} >= {"approved", "pending"}


def test_artifacts_of_a_project_meet_without_being_dealt_out_again(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c, keys = Catalog(spark, folder), ["project_id", "story_key"]
        lists = c.view("v_criteria").groupBy(*keys).agg(F.collect_list("criterion_key").alias("criteria"))
        rows = c.view("v_stories").join(lists, keys, "left").groupBy("project_id").agg(F.count("criteria").alias("n"))
        # Lines and orders are dealt out for either view, and nothing after that.
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_are_written_once_without_the_tasks(spark, folder):
    registry.forget_stages()
    QUERIES["dep_of"](spark, folder).collect()
    names = {key[2] for key in registry._stages}
    assert "edges of v_deps" in names and "v_tasks" not in names


def test_lists_of_orders_are_put_together_where_their_rows_lie(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = Catalog(spark, folder)
        for name, order in (("v_requirements", "ord"), ("v_milestones", "pos"), ("v_project_roles", "role_id")):
            got, want = (source_queries._lists(x.view(name), order, [F.col(order).alias("n")], "entries") for x in (source_queries.dealt(c), c))
            plan = got._jdf.queryExecution().executedPlan().toString()
            # Only the orders are moved, before the lists are made, and no part of a list is made on the way.
            assert plan.count("Exchange hashpartitioning(o_orderkey") == 1 and plan.count("Exchange") == 1
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
