"""Agreed milestones against the computed schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.workdays import working_days_between
from planloom.operators import windows

# Calendar days a plan may land ahead of a date before that says something about the plan.
EARLY_DAYS = 10


def project(milestones: DataFrame, links: DataFrame, due: DataFrame) -> DataFrame:
    """Latest due date of the linked tasks; links(milestone_id, task_id), due(project_id, task_id, due_date)."""
    reached = (
        links.join(due.select("project_id", "task_id", "due_date"), ["project_id", "task_id"])
        .groupBy("project_id", "milestone_id")
        .agg(F.max("due_date").alias("projected_date"), F.count(F.lit(1)).alias("task_count"))
    )
    return milestones.join(reached, ["project_id", "milestone_id"], "left").withColumn(
        "task_count", F.coalesce("task_count", F.lit(0))
    )


def variance_days() -> Column:
    return F.datediff("projected_date", "target_date")


def status() -> Column:
    v = variance_days()
    return (
        F.when(v.isNull(), "unscheduled").when(v > 0, "late").when(v < -EARLY_DAYS, "early").otherwise("on_track")
    )


def detail() -> Column:
    v, name = variance_days(), F.col("name")
    plan, promised = F.col("projected_date").cast("string"), F.col("target_date").cast("string")
    return (
        F.when(F.col("projected_date").isNull(), F.concat(name, F.lit(": no scheduled task covers this milestone")))
        .when(F.col("target_date").isNull(), F.concat(name, F.lit(": the SOW gives no date to check against")))
        .when(v > 0, F.concat(name, F.lit(": plan ends "), plan, F.lit(", "), v.cast("string"),
                              F.lit(" day(s) past the agreed "), promised))
        .when(v < 0, F.concat(name, F.lit(": plan ends "), plan, F.lit(", "), (-v).cast("string"),
                              F.lit(" day(s) before the agreed "), promised))
        .otherwise(F.concat(name, F.lit(": plan ends "), plan, F.lit(", exactly as agreed")))
    )


def checked(projected: DataFrame) -> DataFrame:
    return projected.select(
        "project_id", "milestone_id", "name", "pos", "target_date", "projected_date",
        variance_days().alias("variance_days"), status().alias("status"), detail().alias("detail"),
    )


def summary(checks: DataFrame) -> DataFrame:
    def n(value: str) -> Column:
        return F.count_if(F.col("status") == value).alias(value)

    return checks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), n("late"), n("early"), n("unscheduled"), n("on_track")
    )


def messages(checks: DataFrame) -> DataFrame:
    """Breaches, then warnings: early ones before unscheduled ones."""
    rank = F.when(F.col("status") == "late", 1).when(F.col("status") == "early", 2).when(
        F.col("status") == "unscheduled", 3)
    return checks.withColumn("rank", rank).filter("rank IS NOT NULL").select(
        "project_id", F.when(F.col("rank") == 1, "breach").otherwise("warning").alias("level"), "rank", "pos", "detail"
    )


def segments(checks: DataFrame, starts: DataFrame, whole: bool = False) -> DataFrame:
    """Working days allowed and planned between consecutive milestones, the first from the start. whole: as of
    windows.lag_by()."""
    usable = checks.filter(F.col("target_date").isNotNull() & F.col("projected_date").isNotNull())
    stepped = windows.lag_by(
        usable, ["project_id"], F.unix_date("target_date"), [F.col("target_date"), F.col("pos")],
        F.struct("target_date", "projected_date", "name"), "prev", whole,
    ).join(starts.select("project_id", F.col("start_date").alias("kickoff")), "project_id")
    allowed = working_days_between(F.coalesce("prev.target_date", "kickoff"), F.col("target_date"))
    planned = working_days_between(F.coalesce("prev.projected_date", "kickoff"), F.col("projected_date"))
    sized = stepped.withColumn("allowed_days", allowed).withColumn("planned_days", planned).withColumn(
        "after", F.coalesce("prev.name", F.lit("")))
    unaccounted = F.greatest(F.col("allowed_days") - F.col("planned_days"), F.lit(0))
    coverage = F.when(F.col("allowed_days") > 0, F.col("planned_days") / F.col("allowed_days"))
    return sized.select(
        "project_id", "milestone_id", "pos", "name", "after", "target_date", "allowed_days", "planned_days",
        unaccounted.alias("unaccounted_days"), coverage.alias("coverage"),
    ).withColumn("detail", segment_detail())


def segment_detail() -> Column:
    window = F.when(F.col("after") != "", F.concat(F.lit("after "), F.col("after"))).otherwise("from kickoff")
    return F.when(
        F.col("allowed_days") <= 0,
        F.concat(F.col("name"), F.lit(": the SOW gives no working days for this step ("), window,
                 F.lit("), so it cannot be compared")),
    ).otherwise(
        F.concat(F.col("name"), F.lit(": the SOW allows "), F.col("allowed_days").cast("string"),
                 F.lit(" working day(s) "), window, F.lit(", the plan uses "), F.col("planned_days").cast("string"))
    )


def calibration(steps: DataFrame) -> DataFrame:
    totals = steps.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("allowed_days").alias("allowed_days"),
        F.sum("planned_days").alias("planned_days"),
    )
    return totals.withColumn(
        "unaccounted_days", F.greatest(F.col("allowed_days") - F.col("planned_days"), F.lit(0))
    ).withColumn("coverage", F.when(F.col("allowed_days") != 0, F.col("planned_days") / F.col("allowed_days")))


def widest_gaps(steps: DataFrame, k: int = 3) -> DataFrame:
    top = windows.first_k(
        steps.filter("unaccounted_days > 0"), ["project_id"],
        [F.col("unaccounted_days").desc(), F.col("target_date"), F.col("pos")], k, "gap_rank",
    )
    return top.select("project_id", "gap_rank", "unaccounted_days", "detail")


def verdict() -> Column:
    c = F.col("coverage")
    return (
        F.when(c.isNull(), "no window to compare").when(c < 0.6, "likely underestimated")
        .when(c > 1.0, "needs more time than agreed").otherwise("fits")
    )
