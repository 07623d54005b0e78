"""The tree of a project and its totals on a plan small enough to draw."""

from pyspark.sql import functions as F

from planloom.operators import views


def tables(spark):
    make = spark.createDataFrame
    return {
        "roles": make([(1, "technical", "Lead", "explicit", 5), (1, "commercial", "Buyer", "assumed", None)],
                      "project_id int, team string, role_title string, source_status string, person_id int"),
        "people": make([(5, "Noor")], "person_id int, name string"),
        "details": make([(1, "technical", "api", "REST", "calls", "explicit", "K1")],
                        "project_id int, team string, category string, name string, description string, source_status string, chunk_key string"),
        "requirements": make([(1, "R1", "commercial", "Sign", "explicit", "K2"), (1, "R2", "technical", "Build", "assumed", "")],
                             "project_id int, requirement_id string, team string, title string, source_status string, chunk_key string"),
        "tasks": make([(1, 10, "R1", "operations", "Visit", "accept", "Trainer"), (1, 11, None, "technical", "Spare", "review", ""), (1, 12, "R2", "technical", "Code", "accept", "Lead")],
                      "project_id int, task_id int, linked_requirement string, team string, title string, validation_status string, assignee_role string"),
        "stories": make([
            (1, "S1", "client", "R1", None, "shopper", "earn", "points come"), (1, "S2", "engineer", "", 10, "Lead", "to call", "it works"),
            (1, "S3", "engineer", "", 11, "Lead", "idle", "nothing"), (1, "S4", "client", "R9", None, "shopper", "x", "y"),
            (1, "S5", "engineer", "R2", None, "Lead", "fix", "it holds")],
            "project_id int, story_key string, kind string, requirement_id string, task_id int, actor string, capability string, benefit string"),
        "criteria": make([(1, "S1", "A1", "Quick", "450 TPS", "K3"), (1, "S3", "A2", "Lost", "", "")],
                         "project_id int, story_key string, criterion_key string, text string, measure string, source_key string"),
        "cases": make([(1, "S2", "T1", "Call it", True, "sla_targets"), (1, "", "T2", "Orphan", False, "")],
                      "project_id int, story_key string, case_key string, title string, rests_on_assumption boolean, assumed_fields string"),
    }


def test_tree(spark):
    rows = {(r.team, r.node, r.parent, r.label, r.text, r.status, r.detail, r.other_team) for r in views.structure(**tables(spark)).collect()}
    assert rows == {
        ("technical", "role", "", "Lead", "Noor", "explicit", "", False), ("commercial", "role", "", "Buyer", "", "assumed", "", False),
        ("technical", "detail", "api", "REST", "calls", "explicit", "K1", False),
        ("commercial", "requirement", "", "R1", "Sign", "explicit", "K2", False), ("technical", "requirement", "", "R2", "Build", "assumed", "", False),
        # The task stands under the team that owns its requirement, though another delivers it.
        ("commercial", "task", "R1", "10", "Visit", "accept", "Trainer", True), ("technical", "task", "R2", "12", "Code", "accept", "Lead", False),
        ("technical", "unlinked_task", "", "11", "Spare", "review", "", False),
        ("commercial", "user_story", "R1", "S1", "As a shopper, I want to earn so that points come", "inferred", "", False),
        ("commercial", "engineer_story", "10", "S2", "As a Lead, I want to call so that it works", "inferred", "", False),
        # An engineer story without a task goes by its requirement.
        ("technical", "user_story", "R2", "S5", "As a Lead, I want to fix so that it holds", "inferred", "", False),
        ("commercial", "criterion", "S1", "A1", "Quick — 450 TPS", "", "K3", False),
        ("commercial", "test_case", "S2", "T1", "Call it", "assumed", "sla_targets", False),
    }


def test_empty_tables(spark):
    empty = {name: t.limit(0) for name, t in tables(spark).items()}
    assert views.structure(**empty).count() == 0


def test_totals(spark):
    t = tables(spark)
    projects = spark.createDataFrame([(1,), (2,)], "project_id int")
    questions = spark.createDataFrame([(1, "technical"), (1, None), (1, "marketing"), (3, "technical")], "project_id int, team string")
    rows = views.totals(projects, tasks=t["tasks"], cases=t["cases"], questions=questions).orderBy("project_id").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 2, 3), (2, 0, 0, 0)]
    rows = views.team_totals(projects, tasks=t["tasks"], questions=questions).collect()
    assert {tuple(r) for r in rows} == {
        (1, "commercial", 0, 0), (1, "technical", 2, 1), (1, "operations", 1, 0), (1, "all", 3, 3),
        (2, "commercial", 0, 0), (2, "technical", 0, 0), (2, "operations", 0, 0), (2, "all", 0, 0)}


def test_totals_move_each_table_once(spark):
    t = tables(spark)
    plan = views.totals(spark.createDataFrame([(1,)], "project_id int"), tasks=t["tasks"], cases=t["cases"]).filter(F.lit(True))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
