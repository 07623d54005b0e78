"""Extracted plans scored against hand-written gold standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.text import contains_any, folded, has_digit


def _areas_in(text: Column) -> Column:
    hits = F.array(*[F.when(contains_any(text, words), area) for area, words in vocab.COVERAGE_AREAS.items()])
    return F.filter(hits, lambda a: a.isNotNull())


def expected_areas(gold_requirements: DataFrame) -> DataFrame:
    """Keyword areas that the gold requirement titles call for."""
    return gold_requirements.select("project_id", F.explode(_areas_in(F.lower("title"))).alias("area")).distinct()


def area_coverage(expected: DataFrame, tasks: DataFrame) -> DataFrame:
    """Expected areas, each covered or not by the wording of any task."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    found = tasks.select("project_id", F.explode(_areas_in(text)).alias("area")).distinct()
    return expected.join(found.withColumn("_hit", F.lit(True)), ["project_id", "area"], "left").select(
        "project_id", "area", F.col("_hit").isNotNull().alias("covered"))


def coverage(projects: DataFrame, areas: DataFrame) -> DataFrame:
    share = areas.groupBy("project_id").agg((F.count_if("covered") / F.count(F.lit(1))).alias("task_coverage"))
    return projects.select("project_id").join(share, "project_id", "left").select(
        "project_id", F.coalesce("task_coverage", F.lit(0.0)).alias("task_coverage"))


def hallucinated(tasks: DataFrame, known_gaps: DataFrame) -> DataFrame:
    """Declared gaps whose forbidden terms stand in a task called explicit."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    hits = F.array(*[F.when(contains_any(text, terms), gap) for gap, terms in vocab.FORBIDDEN_TERMS.items()])
    asserted = tasks.filter("source_status = 'explicit'").select(
        "project_id", F.explode(F.filter(hits, lambda g: g.isNotNull())).alias("gap")).distinct()
    return asserted.join(known_gaps.select("project_id", "gap"), ["project_id", "gap"], "left_semi")


def grounding_rates(claims: DataFrame) -> DataFrame:
    supported, number = F.col("verdict") == "supported", F.col("is_quantitative")
    return claims.groupBy("project_id").agg(
        (F.count_if(supported) / F.count(F.lit(1))).alias("grounding_score"),
        F.try_divide(F.count_if(supported & number), F.count_if(number)).alias("quantitative_grounding"))


def assumption_recall(projects: DataFrame, expected: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Expected categories whose every part occurs in the project's assumptions; nothing expected scores 1.

    expected(project_id, category). Each part is looked for by itself, in any assumption.
    """
    parts = expected.select("project_id", "category", F.explode(F.array_distinct(F.split(F.lower("category"), "_"))).alias("part"))
    text = assumptions.select("project_id", F.lower(F.concat_ws(" ", "category", "value", "reason")).alias("text"))
    met = parts.join(text, "project_id").filter(F.contains("text", "part")).select("project_id", "category", "part").distinct()
    need = parts.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("need"))
    have = met.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("have"))
    rate = need.join(have, ["project_id", "category"], "left").groupBy("project_id").agg(
        (F.count_if(F.col("need") == F.coalesce("have", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return projects.select("project_id").join(rate, "project_id", "left").select(
        "project_id", F.coalesce("recall", F.lit(1.0)).alias("assumption_recall"))


def task_rates(tasks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return tasks.groupBy("project_id").agg(
        (F.count_if(F.col("assignee_role") != "") / n).alias("assignment_rate"),
        (F.count_if(F.coalesce("linked_requirement", F.lit("")) != "") / n).alias("requirement_link_rate"))


def off_roster(tasks: DataFrame, project_roles: DataFrame) -> DataFrame:
    # Not made distinct before the join: where rows are read that is a table of nearly all of them.
    listed = project_roles.select("project_id", "team", folded(F.col("role_title")).alias("_key"))
    used = tasks.filter("assignee_role <> ''").select("project_id", "team", "assignee_role", folded(F.col("assignee_role")).alias("_key")).distinct()
    return used.join(listed, ["project_id", "team", "_key"], "left_anti").select(
        "project_id", F.concat_ws("/", "team", "assignee_role").alias("role"))


def disclosure(cases: DataFrame, stories: DataFrame) -> DataFrame:
    """Share of cases that do not assert a number they cannot account for."""
    keys = ["project_id", "story_key"]
    sourced = stories.filter("source_key <> ''").select(*keys, F.lit(True).alias("_sourced")).distinct()
    unexplained = has_digit(F.col("expected_result")) & (F.col("assumed_fields") == "") & F.col("_sourced").isNull()
    return cases.join(sourced, keys, "left").groupBy("project_id").agg(
        ((F.count(F.lit(1)) - F.count_if(unexplained)) / F.count(F.lit(1))).alias("assumption_disclosure"))


def latest_runs(documents: DataFrame) -> DataFrame:
    """Newest project per document key; documents(doc_key, project_id, uploaded_at)."""
    return documents.groupBy("doc_key").agg(F.max_by("project_id", F.struct("uploaded_at", "project_id")).alias("project_id"))


def overall(rates: DataFrame, claims: DataFrame) -> DataFrame:
    """Lowest citation validity over the documents, and grounding pooled over all claims: one row."""
    worst = rates.agg(F.min("citation_validity").alias("min_citation_validity"))
    pooled = claims.agg(
        F.count(F.lit(1)).alias("claims"), (F.count_if(F.col("verdict") == "supported") / F.count(F.lit(1))).alias("grounding"))
    # Either side is one row, whatever the input.
    return worst.withColumn("_one", F.lit(1)).join(pooled.withColumn("_one", F.lit(1)), "_one").drop("_one")
