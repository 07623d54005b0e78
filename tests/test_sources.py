"""Files that queries write from rows and read back."""

import os

from planloom.operators import evaluate
from planloom.plans.queries import QUERIES
from planloom.session import scratch
from planloom.sources import readers, sinks


def test_many_files_in_few_folders(spark, tmp_path):
    rows = [(f"doc{i}.txt", f"text {i}") for i in range(600)] + [("both.md", "one"), ("both.md", "one"), ("scan.PDF", "%")]
    path = str(tmp_path / "up")
    sinks.write_files(spark.createDataFrame(rows, "name string, value string"), path)
    # A folder for each file made a write as slow as its folders are many.
    folders = [d for d, _, names in os.walk(path) if names]
    assert sum(len(names) for _, _, names in os.walk(path)) == 602 and len(folders) <= sinks.FOLDERS
    documents, rejected = readers.text_documents(spark, path)
    texts = {r.filename: r.text for r in documents.collect()}
    assert len(texts) == 601 and texts["doc7.txt"] == "text 7\n" and texts["both.md"] == "one\none\n"
    assert [r.filename for r in rejected.collect()] == ["scan.PDF"]


def test_no_files(spark, tmp_path):
    path = str(tmp_path / "none")
    sinks.write_files(spark.createDataFrame([], "name string, value string"), path)
    assert readers.text_documents(spark, path)[0].count() == 0


def test_gold_is_written_once_and_small(spark, tmp_path):
    orders = [(k, k % 50, "P", 100.0 + k) for k in range(1, 1001)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    made = lambda: {os.path.join(d, n) for d, _, names in os.walk(scratch(spark).removeprefix("file:")) for n in names if not n.startswith((".", "_"))}
    before = made()
    assert QUERIES["src_gold"](spark, str(tmp_path)).count() == 3000
    assert [r.file for r in QUERIES["src_gold_rejects"](spark, str(tmp_path)).orderBy("file").collect()] == ["account-0-cut", "plan-0-cut", "plan-1-cut"]
    new = made() - before
    texts = [n for n in new if "/name=" in n]
    assert len(texts) == 6 and all(n.endswith(".gz") for n in texts)
    # One table besides, that of the parsed files.
    assert len({os.path.dirname(n) for n in new if n.endswith(".parquet")}) == 1


def test_off_roster_lists_roles_once_and_holds_no_table_of_them(spark):
    tasks = spark.createDataFrame([(1, "technical", "QA"), (1, "technical", "qa"), (1, "operations", "Trainer"), (2, "technical", "QA"), (None, "technical", "QA")],
                                  "project_id bigint, team string, assignee_role string")
    listed = spark.createDataFrame([(1, "technical", "Qa"), (1, "technical", "QA")], "project_id bigint, team string, role_title string")
    rows = evaluate.off_roster(tasks.union(tasks), listed)
    assert sorted((r.project_id or 0, r.role) for r in rows.collect()) == [(0, "technical/QA"), (1, "operations/Trainer"), (2, "technical/QA")]
    # The listed roles are not made distinct on their way: one table of groups only, that of the tasks.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
