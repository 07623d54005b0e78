"""Stories, criteria and test cases derived from the plan, provenance inherited downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.text import folded, quoted, strip
from planloom.operators.roles import is_delivery, lead_of


def client_stories(stories: DataFrame, requirements: DataFrame, projects: DataFrame) -> DataFrame:
    """Stories that restate a requirement: its team and citations, never stronger than inferred."""
    req = requirements.select(
        "project_id", "requirement_id", "team", F.col("source_status").alias("req_status"), F.col("chunk_key").alias("source_key"))
    clients = projects.select("project_id", "merchant_name")
    return (
        stories.filter("kind = 'client'").join(req, ["project_id", "requirement_id"]).join(clients, "project_id")
        .withColumn("source_status", F.when(F.col("req_status") == "assumed", "assumed").otherwise("inferred"))
        .withColumn("delivery_side", is_delivery(F.col("actor"), F.coalesce("merchant_name", F.lit(""))))
        .drop("req_status", "merchant_name")
    )


def client_story_warnings(stories: DataFrame, requirements: DataFrame) -> DataFrame:
    lost = stories.filter("kind = 'client'").join(
        requirements.select("project_id", "requirement_id"), ["project_id", "requirement_id"], "left_anti")
    return lost.select("project_id", "story_key", F.concat(
        F.lit("story "), F.col("story_key"), F.lit(" cites unknown requirement "), quoted(F.col("requirement_id")),
        F.lit(", dropped")).alias("message"))


def resolved_details(cited: DataFrame, details: DataFrame) -> DataFrame:
    """Cited detail names against the project's details; cited(project_id, owner, pos, name).

    The last detail listed under a name keeps it. `found` says whether the name exists, and
    `detail_key` is what that detail itself cites, if anything.
    """
    by_name = details.groupBy("project_id", folded(strip(F.col("name"))).alias("_name")).agg(
        F.max_by("chunk_key", "ord").alias("detail_key"))
    return cited.withColumn("_name", folded(strip(F.col("name")))).join(
        by_name.withColumn("found", F.lit(True)), ["project_id", "_name"], "left"
    ).withColumn("found", F.coalesce("found", F.lit(False))).drop("_name")


def engineer_stories(stories: DataFrame, tasks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Stories about one task; notes stay only if at least one cited detail exists."""
    sourced = resolved.groupBy("project_id", "story_key").agg(
        F.bool_or("found").alias("sourced"),
        # A story cites a handful of details; their keys in order, once each.
        F.array_join(F.array_distinct(F.transform(
            F.array_sort(F.collect_list(F.when(F.coalesce("detail_key", F.lit("")) != "", F.struct("pos", "detail_key")))),
            lambda x: x["detail_key"])), ",").alias("keys"))
    joined = (
        stories.filter("kind = 'engineer'")
        .join(tasks.select("project_id", "task_id", "team", "assignee_role", F.col("requirement_id").alias("task_requirement")),
              ["project_id", "task_id"])
        .join(sourced, ["project_id", "story_key"], "left")
    )
    notes = strip(F.col("technical_notes"))
    kept = F.when(F.coalesce("sourced", F.lit(False)), notes).otherwise("")
    return joined.select(
        "project_id", "story_key", "task_id", "team", F.col("task_requirement").alias("requirement_id"),
        F.when(F.col("assignee_role") != "", F.col("assignee_role")).otherwise(lead_of(F.col("team"))).alias("actor"),
        kept.alias("technical_notes"), F.when(kept != "", F.coalesce("keys", F.lit(""))).otherwise("").alias("notes_keys"),
        F.when((notes != "") & (kept == ""), F.concat(
            F.lit("engineer story "), F.col("story_key"),
            F.lit(" has technical notes resting on no detail the SOW stated, notes dropped"))).otherwise("").alias("warning"),
    )


def criteria(drafts: DataFrame, resolved: DataFrame) -> DataFrame:
    """A threshold whose cited details lead to no chunk is dropped."""
    keys = resolved.groupBy("project_id", "criterion_key").agg(F.max(F.coalesce("detail_key", F.lit(""))).alias("key"))
    measure = strip(F.col("measure"))
    joined = drafts.join(keys, ["project_id", "criterion_key"], "left")
    backed = F.coalesce("key", F.lit("")) != ""
    return joined.select(
        "project_id", "story_key", "criterion_key", "pos", "text", F.when(backed, measure).otherwise("").alias("measure"),
        F.when((measure != "") & backed, F.col("key")).otherwise("").alias("source_key"),
        ((measure != "") & ~backed).alias("dropped"))


def test_cases(cases: DataFrame, assumed_fields: DataFrame) -> DataFrame:
    """Which unsettled checklist fields a case stands on; cases carry `fields`, a short array of names."""
    known = F.array(*[F.lit(row[0]) for row in vocab.CHECKLIST])
    # At most one name per checklist field and project.
    assumed = assumed_fields.groupBy("project_id").agg(F.collect_set("field_key").alias("assumed"))
    joined = cases.join(assumed, "project_id", "left").withColumn("assumed", F.coalesce("assumed", F.array().cast("array<string>")))
    resting = F.array_sort(F.array_intersect(F.array_intersect("fields", known), F.col("assumed")))
    return joined.select(
        "project_id", "story_key", "case_key", "title", "expected_result", "pos",
        F.array_join(resting, ",").alias("assumed_fields"), (F.size(resting) > 0).alias("rests_on_assumption"),
        F.array_join(F.array_except("fields", known), ",").alias("unknown_fields"))


def sentence(actor: Column, capability: Column, benefit: Column) -> Column:
    c = strip(capability)
    infinitive = F.when(F.lower(c).startswith("to "), c).otherwise(F.concat(F.lit("to "), c))
    return F.concat(F.lit("As a "), actor, F.lit(", I want "), infinitive, F.lit(" so that "), benefit)


def criterion_text(text: Column, measure: Column) -> Column:
    return F.when(measure != "", F.concat(text, F.lit(" — "), measure)).otherwise(text)


def stories_for_tasks(stories: DataFrame, tasks: DataFrame) -> DataFrame:
    """A task with stories of its own keeps those; any other inherits its requirement's."""
    own = stories.filter(F.col("task_id").isNotNull()).select("project_id", "task_id", "story_key", F.lit("own").alias("via"))
    general = stories.filter(F.col("task_id").isNull() & (F.col("requirement_id") != "")).select("project_id", "requirement_id", "story_key")
    without = tasks.filter(F.col("requirement_id") != "").join(own.select("project_id", "task_id"), ["project_id", "task_id"], "left_anti")
    inherited = without.select("project_id", "task_id", "requirement_id").join(general, ["project_id", "requirement_id"]).select(
        "project_id", "task_id", "story_key", F.lit("requirement").alias("via"))
    return own.join(tasks.select("project_id", "task_id"), ["project_id", "task_id"], "left_semi").unionByName(inherited)
