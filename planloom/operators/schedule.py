"""Critical-path schedules of all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.workdays import add_working_days, next_working_day, parse_date
from planloom.operators.graph import longest_paths

HOURS_PER_DAY = 8.0


def is_assumed(hours: Column) -> Column:
    return F.coalesce(hours <= 0, F.lit(True))


def duration_days(hours: Column) -> Column:
    return F.when(is_assumed(hours), F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(hours / HOURS_PER_DAY).cast("int"))
    )


def offsets(tasks: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Early and late offsets, slack and the project's length, in working days. parts: as of longest_paths()."""
    sized = tasks.select(
        "project_id", "task_id", "title", "team",
        duration_days(F.col("estimated_hours")).alias("duration_days"),
        is_assumed(F.col("estimated_hours")).alias("duration_is_assumed"),
    )
    paths = longest_paths(sized.withColumnRenamed("duration_days", "weight"), edges, parts=parts)
    placed = sized.join(paths, ["project_id", "task_id"]).withColumn(
        "early_finish", F.col("before") + F.col("duration_days")
    )
    length = placed.groupBy("project_id").agg(F.max("early_finish").alias("project_days"))
    return (
        placed.join(length, "project_id")
        .withColumn("late_finish", F.col("project_days") - F.col("after"))
        .withColumn("late_start", F.col("late_finish") - F.col("duration_days"))
        .withColumnRenamed("before", "early_start")
        .withColumn("slack_days", F.col("late_start") - F.col("early_start"))
        .withColumn("is_critical", F.col("slack_days") == 0)
        .drop("after")
    )


def dated(placed: DataFrame, starts: DataFrame) -> DataFrame:
    """Offsets as dates; starts(project_id, start_date)."""
    first = starts.select("project_id", next_working_day(F.col("start_date")).alias("project_start"))
    return (
        placed.join(first, "project_id")
        .withColumn("start_date", add_working_days(F.col("project_start"), F.col("early_start")))
        .withColumn("due_date", add_working_days(F.col("start_date"), F.col("duration_days") - 1))
    )


def project_spans(placed: DataFrame, starts: DataFrame) -> DataFrame:
    """Start, end and length per project; an empty project starts and ends on its given date."""
    lengths = placed.groupBy("project_id").agg(F.max("project_days").alias("project_days"))
    joined = starts.select("project_id", F.col("start_date").alias("given")).join(lengths, "project_id", "left")
    empty = F.col("project_days").isNull()
    start = F.when(empty, F.col("given")).otherwise(next_working_day(F.col("given")))
    end = F.when(empty, F.col("given")).otherwise(add_working_days(start, F.greatest(F.col("project_days") - 1, F.lit(0))))
    return joined.select(
        "project_id", start.alias("project_start"), end.alias("project_end"),
        F.coalesce("project_days", F.lit(0)).alias("duration_working_days"),
    )


def breaches(spans: DataFrame, deadlines: DataFrame) -> DataFrame:
    late = F.datediff("project_end", "deadline")
    return (
        spans.join(deadlines.select("project_id", "deadline"), "project_id")
        .filter(F.col("project_end") > F.col("deadline"))
        .select(
            "project_id", late.alias("overrun_days"),
            F.concat(
                F.lit("Schedule ends "), F.col("project_end").cast("string"), F.lit(", "), late.cast("string"),
                F.lit(" day(s) past the SOW date of "), F.col("deadline").cast("string"), F.lit("."),
            ).alias("deadline_breach"),
        )
    )


def estimate_coverage(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    counted = tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_assumed(F.col("estimated_hours"))).alias("guessed")
    )
    return projects.select("project_id").join(counted, "project_id", "left").select(
        "project_id",
        F.coalesce(F.lit(1.0) - F.col("guessed") / F.col("n"), F.lit(1.0)).alias("estimate_coverage"),
        F.coalesce("guessed", F.lit(0)).alias("assumed_tasks"),
    )


def deadlines(projects: DataFrame, assumptions: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """First of: the stated text, the project's go-live, the first schedule assumption that is a date."""
    first = (
        assumptions.filter(F.col("category") == "SCHEDULE")
        .groupBy("project_id")
        .agg(F.min_by("value", "assumption_key").alias("assumed_text"))
    )
    joined = projects.select("project_id", "go_live_date").join(first, "project_id", "left")
    choices = [F.col("go_live_date"), parse_date(F.col("assumed_text"))]
    if stated is not None:
        joined = joined.join(stated.select("project_id", "go_live_text"), "project_id", "left")
        choices.insert(0, parse_date(F.col("go_live_text")))
    return joined.select("project_id", F.coalesce(*choices).alias("deadline"))
