"""What a reviewer did to the plan, applied to the task table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ["pending", "approved", "edited", "rejected"]
MAX_REGENERATIONS = 3
KEYS = ["project_id", "task_id"]


def summary(projects: DataFrame, tasks: DataFrame) -> DataFrame:
    counts = tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("review_status") == s).alias(s) for s in STATUSES])
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return projects.select("project_id").join(counts, "project_id", "left").select(
        "project_id", zero("total"), *[zero(s) for s in STATUSES],
        ((F.coalesce("pending", F.lit(0)) == 0) & (F.coalesce("rejected", F.lit(0)) == 0)).alias("ready"))


def set_status(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions(project_id, task_id, status, note)."""
    return tasks.join(decisions, KEYS, "left").withColumn(
        "review_status", F.coalesce("status", "review_status")
    ).withColumn("review_note", F.when(F.col("status").isNotNull(), F.coalesce("note", F.lit(""))).otherwise(F.col("review_note"))
    ).drop("status", "note")


def approve_projects(projects: DataFrame, approved: DataFrame) -> DataFrame:
    return projects.join(approved.select("project_id", F.lit(True).alias("_ok")).distinct(), "project_id", "left").withColumn(
        "status", F.when(F.col("_ok"), "approved").otherwise(F.col("status"))).drop("_ok")


def apply_edits(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Non-null edits to title, description, team and hours; grounding of the old wording is void."""
    fields = ["title", "description", "team", "estimated_hours"]
    new = edits.select(*KEYS, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_edited"))
    out = tasks.join(new, KEYS, "left")
    hit = F.col("_edited").isNotNull()
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return (
        out.withColumn("review_status", F.when(hit, "edited").otherwise(F.col("review_status")))
        .withColumn("board_dirty", hit | F.col("board_dirty"))
        .withColumn("grounding_score", F.when(~hit, F.col("grounding_score")))
        .withColumn("validation_status", F.when(hit, "pending").otherwise(F.col("validation_status")))
        .drop("_edited", *[f"_{f}" for f in fields])
    )


def drop_claims(claims: DataFrame, edited: DataFrame) -> DataFrame:
    return claims.join(edited.select(*KEYS), KEYS, "left_anti")


def regeneration_refused(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("regeneration_count") >= MAX_REGENERATIONS)


def apply_regeneration(tasks: DataFrame, replacements: DataFrame) -> DataFrame:
    """replacements(project_id, task_id, new_title, new_description, new_hours, new_key): '' and NULL keep the old."""
    out = tasks.join(replacements.withColumn("_new", F.lit(True)), KEYS, "left")
    hit = F.coalesce("_new", F.lit(False)) & (F.col("regeneration_count") < MAX_REGENERATIONS)
    given = lambda new, old: F.when(hit & (F.coalesce(new, F.lit("")) != ""), F.col(new)).otherwise(F.col(old))
    return (
        out.withColumn("title", given("new_title", "title"))
        .withColumn("description", F.when(hit, F.col("new_description")).otherwise(F.col("description")))
        .withColumn("estimated_hours", F.when(hit & (F.coalesce("new_hours", F.lit(0.0)) != 0), F.col("new_hours")).otherwise(F.col("estimated_hours")))
        .withColumn("source_key", given("new_key", "source_key"))
        .withColumn("review_status", F.when(hit, "pending").otherwise(F.col("review_status")))
        .withColumn("review_note", F.when(hit, "").otherwise(F.col("review_note")))
        .withColumn("board_dirty", hit | F.col("board_dirty"))
        .withColumn("regeneration_count", F.col("regeneration_count") + hit.cast("int"))
        .drop("_new", "new_title", "new_description", "new_hours", "new_key")
    )
