"""Linking an extracted plan: requirements, milestones, dependencies, teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import folded, or_none, quoted, strip


def link_requirements(tasks: DataFrame, requirements: DataFrame) -> DataFrame:
    known = requirements.select("project_id", "requirement_id", F.lit(True).alias("_known")).distinct()
    return tasks.join(known, ["project_id", "requirement_id"], "left").withColumn(
        "linked_requirement", F.when(F.col("_known"), F.col("requirement_id"))
    ).drop("_known")


def requirement_warnings(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("linked_requirement").isNull() & (F.col("requirement_id") != "")).select(
        "project_id", "task_id",
        F.concat(quoted(F.col("title")), F.lit(": cites unknown requirement "), quoted(F.col("requirement_id")),
                 F.lit(", left unlinked")).alias("message"),
    )


def _milestones_by_name(milestones: DataFrame) -> DataFrame:
    """The last milestone listed under a name keeps the name."""
    return milestones.groupBy("project_id", folded(F.col("name")).alias("_name")).agg(
        F.max_by("milestone_id", "pos").alias("milestone_id")
    )


def milestone_links(tasks: DataFrame, milestones: DataFrame) -> DataFrame:
    named = tasks.filter(F.col("milestone") != "").select("project_id", "task_id", folded(F.col("milestone")).alias("_name"))
    return named.join(_milestones_by_name(milestones), ["project_id", "_name"]).drop("_name")


def milestone_warnings(tasks: DataFrame, milestones: DataFrame) -> DataFrame:
    named = tasks.filter(F.col("milestone") != "").withColumn("_name", folded(F.col("milestone")))
    return named.join(_milestones_by_name(milestones), ["project_id", "_name"], "left_anti").select(
        "project_id", "task_id",
        F.concat(quoted(F.col("title")), F.lit(" names milestone "), quoted(F.col("milestone")),
                 F.lit(", which the SOW does not list")).alias("message"),
    )


def milestones_without_task(milestones: DataFrame, links: DataFrame) -> DataFrame:
    """Of the milestones that keep their name, those nothing was attached to."""
    kept = milestones.join(_milestones_by_name(milestones).select("project_id", "milestone_id"),
                           ["project_id", "milestone_id"], "left_semi")
    return kept.join(links, ["project_id", "milestone_id"], "left_anti").select(
        "project_id", "milestone_id",
        F.concat(F.lit("milestone "), quoted(F.col("name")),
                 F.lit(" has no task attached, so its date cannot be compared with the schedule")).alias("message"),
    )


def link_dependencies(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Known, different, and the first of each repeated pair."""
    known = tasks.select("project_id", F.col("task_id").alias("depends_on_id"))
    usable = deps.filter(F.col("task_id") != F.col("depends_on_id")).join(
        known, ["project_id", "depends_on_id"], "left_semi"
    )
    rest = [c for c in usable.columns if c not in ("project_id", "task_id", "depends_on_id")]
    return usable.groupBy("project_id", "task_id", "depends_on_id").agg(
        F.min_by(F.struct(*rest), "edge_ord").alias("_first")
    ).select("project_id", "task_id", "depends_on_id", "_first.*")


def detail_team(details: DataFrame, categories: DataFrame) -> DataFrame:
    """The owning team is a property of the category; categories are a constant of 22 rows."""
    return details.join(F.broadcast(categories), "category", "left")


def empty_extractions(documents: DataFrame, tasks: DataFrame, requirements: DataFrame) -> DataFrame:
    """Documents that have chunks but yielded no task; documents(project_id, doc_key, chunk_count)."""
    n_tasks = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    n_reqs = requirements.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_reqs"))
    missing = F.concat_ws(
        ", ", F.when(F.col("n_reqs").isNull(), F.lit("requirements")), F.lit("tasks")
    )
    return (
        documents.filter(F.col("chunk_count") > 0)
        .join(n_tasks, "project_id", "left").filter("n_tasks IS NULL")
        .join(n_reqs, "project_id", "left")
        .select("project_id", "doc_key", "chunk_count", missing.alias("missing"))
    )


def estimate_source(hours: Column) -> Column:
    return F.when(F.coalesce(hours != 0, F.lit(False)), "estimated").otherwise("assumed")


def project_info(projects: DataFrame, answers: DataFrame) -> DataFrame:
    """Values read from the document win over what the project row had."""
    joined = projects.select("project_id", F.col("name").alias("_name")).join(answers, "project_id")
    return joined.select(
        "project_id", F.coalesce(or_none(F.col("project_name")), F.col("_name")).alias("name"),
        F.coalesce("merchant_name", F.lit("")).alias("merchant_name"), "start_date",
        F.coalesce("go_live_date", "end_date").alias("go_live_date"),
    )


def clean_rationale(c: Column) -> Column:
    return strip(c)
