"""Reporting views. A project's tree is rows, one per node, so no project becomes one value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import vocab
from planloom.operators.artifacts import criterion_text, sentence


def projects_overview(projects: DataFrame, tasks: DataFrame, assumptions: DataFrame) -> DataFrame:
    n_tasks = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("task_count"))
    n_assumed = assumptions.groupBy("project_id").agg(F.count(F.lit(1)).alias("assumption_count"))
    return projects.join(n_tasks, "project_id", "left").join(n_assumed, "project_id", "left").fillna(
        0, ["task_count", "assumption_count"]).orderBy(F.col("created_on").desc(), "project_id")


def structure(
    roles: DataFrame, people: DataFrame, details: DataFrame, requirements: DataFrame, tasks: DataFrame, stories: DataFrame,
    criteria: DataFrame, cases: DataFrame,
) -> DataFrame:
    """The tree under each team, one row per node: (project_id, team, node, parent, label, text, status,
    detail, other_team).

    A node's parent is the label of a node above it: stories stand under their requirement or task,
    criteria and cases under their story. detail is the chunk a node rests on, of a case the fields it
    assumes, of a task the role it is given to. tasks carry linked_requirement (NULL when unlinked); stories requirement_id or task_id,
    actor, capability and benefit. What belongs to no team of the tree is left out: stories of unknown
    requirements or of tasks without one, and what hangs on them.
    """
    none = F.lit("")

    def nodes(df, kind, parent, label, text, status, detail=none, other=F.lit(False)):
        return df.select(
            "project_id", "team", F.lit(kind).alias("node"), parent.cast("string").alias("parent"), label.cast("string").alias("label"),
            text.alias("text"), status.alias("status"), detail.alias("detail"), other.alias("other_team"))

    holders = roles.join(people.select("person_id", F.col("name").alias("person")), "person_id", "left")
    owner = requirements.select("project_id", F.col("requirement_id").alias("linked_requirement"), F.col("team").alias("req_team"))
    placed = tasks.join(owner, ["project_id", "linked_requirement"], "left")
    linked = placed.filter(F.col("req_team").isNotNull())
    delivered = linked.select("*", (F.col("team") != F.col("req_team")).alias("elsewhere")).withColumn("team", F.col("req_team"))

    # A story has one owner, a requirement or a task, and looks for it among either: tables put together are dealt out
    # anew for what comes after, joins of tables that lie by project are not.
    own = (F.col("kind") == "engineer") & F.col("task_id").isNotNull()
    asked = requirements.select("project_id", F.col("requirement_id").alias("_requirement"), F.struct("team").alias("_asked"))
    done = linked.select("project_id", F.col("task_id").cast("string").alias("_task"), F.struct(F.col("req_team").alias("team")).alias("_done"))
    told = (
        stories.withColumn("_requirement", F.when(~F.coalesce(own, F.lit(False)), F.col("requirement_id")))
        .withColumn("_task", F.when(own, F.col("task_id").cast("string")))
        .join(asked, ["project_id", "_requirement"], "left").join(done, ["project_id", "_task"], "left")
        .filter("_asked IS NOT NULL OR _done IS NOT NULL")
        .select(
            "project_id", F.coalesce("_asked.team", "_done.team").alias("team"), F.when(own, "engineer_story").otherwise("user_story").alias("node"),
            F.coalesce("_task", "_requirement").alias("owner"), "story_key", "actor", "capability", "benefit"))

    placed_stories = told.select("project_id", "story_key", "team")
    of_criteria = criteria.join(placed_stories, ["project_id", "story_key"])
    of_cases = cases.join(placed_stories, ["project_id", "story_key"])

    parts = [
        nodes(holders, "role", none, F.col("role_title"), F.coalesce("person", none), F.col("source_status")),
        nodes(details, "detail", F.col("category"), F.col("name"), F.col("description"), F.col("source_status"), F.col("chunk_key")),
        nodes(requirements, "requirement", none, F.col("requirement_id"), F.col("title"), F.col("source_status"), F.col("chunk_key")),
        nodes(delivered, "task", F.col("linked_requirement"), F.col("task_id"), F.col("title"), F.col("validation_status"),
              F.col("assignee_role"), F.col("elsewhere")),
        nodes(placed.filter(F.col("req_team").isNull()), "unlinked_task", none, F.col("task_id"), F.col("title"), F.col("validation_status"),
              F.col("assignee_role")),
        told.select("project_id", "team", "node", F.col("owner").alias("parent"), F.col("story_key").alias("label"),
                    sentence(F.col("actor"), F.col("capability"), F.col("benefit")).alias("text"), F.lit("inferred").alias("status"),
                    none.alias("detail"), F.lit(False).alias("other_team")),
        nodes(of_criteria, "criterion", F.col("story_key"), F.col("criterion_key"), criterion_text(F.col("text"), F.col("measure")), none,
              F.col("source_key")),
        nodes(of_cases, "test_case", F.col("story_key"), F.col("case_key"), F.col("title"),
              F.when(F.col("rests_on_assumption"), "assumed").otherwise(""), F.col("assumed_fields")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _counted(**tables: DataFrame) -> DataFrame:
    """(project_id, team, what): one row for each row counted; tables without teams count for none."""
    return reduce(DataFrame.unionByName, [
        t.select("project_id", (F.col("team") if "team" in t.columns else F.lit(None).cast("string")).alias("team"), F.lit(name).alias("what"))
        for name, t in tables.items()])


def totals(projects: DataFrame, **tables: DataFrame) -> DataFrame:
    """Row counts per project, a column for each table: all tables counted in one aggregation."""
    rows = _counted(**tables).join(projects.select("project_id"), "project_id", "left_semi")
    rows = rows.select("project_id", "what").unionByName(projects.select("project_id", F.lit("").alias("what")))
    return rows.groupBy("project_id").agg(*[F.count_if(F.col("what") == name).alias(name) for name in tables])


def team_totals(projects: DataFrame, **tables: DataFrame) -> DataFrame:
    """The same counts for each of a project's teams and, with team 'all', for the project; every team
    is there even when nothing is its own. Rows of other teams, or of none, count for the project only."""
    teams = F.array(*[F.lit(t) for t in vocab.TEAMS])
    known = F.when(F.array_contains(teams, F.col("team")), F.col("team")).otherwise("")
    rows = _counted(**tables).join(projects.select("project_id"), "project_id", "left_semi").select("project_id", known.alias("team"), "what")
    spine = projects.select("project_id", F.explode(teams).alias("team"), F.lit("").alias("what"))
    sums = rows.unionByName(spine).groupingSets([["project_id", "team"], ["project_id"]], "project_id", "team").agg(
        F.grouping("team").alias("whole"), *[F.count_if(F.col("what") == name).alias(name) for name in tables])
    return sums.filter("whole = 1 OR team <> ''").select(
        "project_id", F.when(F.col("whole") == 1, "all").otherwise(F.col("team")).alias("team"), *tables)


def request_hash() -> "F.Column":
    return F.sha2(F.concat_ws("|", "model", "schema_name", "prompt_text"), 256)


def cache_lookup(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests with the latest stored output of the same hash, if there is one."""
    latest = log.groupBy("input_hash").agg(F.max_by("output_text", "created_at").alias("cached_output"))
    return requests.join(latest, "input_hash", "left").withColumn("hit", F.col("cached_output").isNotNull())


def audit_trail(projects: DataFrame, log: DataFrame, reported: DataFrame, scores: DataFrame) -> DataFrame:
    """(project_id, entry, name, position, passed, amount, score): a project's requests in order, its
    validation stages with their offenders and the project's grounding score, and how many requests there were.
    Projects without requests have a total of 0; requests of unknown projects are left out."""
    known = log.join(projects.select("project_id"), "project_id", "left_semi")
    no_score = F.lit(None).cast("double").alias("score")
    requests = known.select(
        "project_id", F.lit("request").alias("entry"), F.col("graph_node").alias("name"), F.col("created_at").cast("bigint").alias("position"),
        F.lit(None).cast("boolean").alias("passed"), F.length(F.coalesce("output_text", F.lit(""))).cast("bigint").alias("amount"), no_score)
    stages = reported.join(scores, "project_id", "left").select(
        "project_id", F.lit("stage").alias("entry"), F.col("stage").alias("name"), F.lit(None).cast("bigint").alias("position"),
        "passed", F.col("offenders").cast("bigint").alias("amount"), "score")
    asked = known.groupBy("project_id").agg(F.count(F.lit(1)).alias("_asked"))
    total = projects.select("project_id").distinct().join(asked, "project_id", "left").withColumn("amount", F.coalesce("_asked", F.lit(0))).select(
        "project_id", F.lit("total_requests").alias("entry"), F.lit("").alias("name"), F.lit(None).cast("bigint").alias("position"),
        F.lit(None).cast("boolean").alias("passed"), "amount", no_score)
    return requests.unionByName(stages).unionByName(total)


def audit(log: DataFrame) -> DataFrame:
    return log.select(
        "project_id", "turn", "graph_node", "model", F.substring("input_hash", 1, 12).alias("hash_prefix"), "created_at",
        F.length(F.coalesce("output_text", F.lit(""))).alias("output_chars")).orderBy("project_id", "created_at")
