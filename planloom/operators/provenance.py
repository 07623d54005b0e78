"""Citations: resolved, audited and joined to their evidence.

citations(project_id, <owner columns>, pos, raw_key); chunks(project_id, chunk_key, ...).
Keys are always looked up within the project: two projects may hold the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions.citations import normalize
from planloom.functions.text import blank, quoted


def normalized(citations: DataFrame) -> DataFrame:
    return citations.withColumn("chunk_key", normalize(F.col("raw_key")))


def valid(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of chunks that exist, repeats and order kept."""
    return normalized(citations).join(
        chunks.select("project_id", "chunk_key"), ["project_id", "chunk_key"], "left_semi"
    )


def invented(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct cited keys that no chunk has."""
    return (
        normalized(citations).select("project_id", "chunk_key").distinct()
        .join(chunks.select("project_id", "chunk_key"), ["project_id", "chunk_key"], "left_anti")
    )


def first_section(valid_citations: DataFrame, chunks: DataFrame, owner: str) -> DataFrame:
    first = valid_citations.groupBy("project_id", owner).agg(F.min_by("chunk_key", "pos").alias("chunk_key"))
    return first.join(
        chunks.select("project_id", "chunk_key", "section_index", "section_title"), ["project_id", "chunk_key"]
    )


def demote_explicit(deps: DataFrame, chunks: DataFrame) -> DataFrame:
    """Dependencies called explicit without a citation that exists become inferred."""
    known = chunks.select("project_id", "chunk_key", F.lit(True).alias("_known"))
    joined = normalized(deps).join(known, ["project_id", "chunk_key"], "left")
    cites = F.col("_known").isNotNull()
    demoted = (F.col("source_status") == "explicit") & ~cites
    return (
        joined.withColumn("demoted", demoted).withColumn("cites", cites)
        .withColumn("source_status", F.when(demoted, "inferred").otherwise(F.col("source_status")))
        .drop("_known")
    )


def demotion_warnings(demoted: DataFrame, tasks: DataFrame) -> DataFrame:
    title = tasks.select("project_id", "task_id", "title")
    upstream = tasks.select("project_id", F.col("task_id").alias("depends_on_id"), F.col("title").alias("upstream"))
    return (
        demoted.filter("demoted").join(title, ["project_id", "task_id"]).join(upstream, ["project_id", "depends_on_id"])
        .select("project_id", "task_id", F.concat(
            quoted(F.col("title")), F.lit(" waits on "), quoted(F.col("upstream")),
            F.lit(": called explicit with no citation the document contains, recorded as inferred")).alias("message"))
    )


def evidence_for_all(task_citations: DataFrame, dep_citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk a project's tasks or dependencies cite, once."""
    cited = (
        task_citations.select("project_id", "chunk_key").union(dep_citations.select("project_id", "chunk_key")).distinct()
    )
    return chunks.join(cited, ["project_id", "chunk_key"], "left_semi").select(
        "project_id", "chunk_key", "text", "page", "section_title")


def evidence_for_one(chunks: DataFrame, chunk_key: str) -> DataFrame:
    return chunks.filter(F.col("chunk_key") == chunk_key).select("project_id", "chunk_key", "text", "page", "section_title")


def task_evidence(requested: DataFrame, valid_citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of the requested tasks (project_id, task_id): cited chunks, then the other chunks of the section of
    the first one, each once. Only citations of those tasks, and so only their sections, are looked at."""
    asked = valid_citations.join(requested.select("project_id", "task_id").distinct(), ["project_id", "task_id"], "left_semi")
    cited = asked.select("project_id", "task_id", "chunk_key", F.lit(1).alias("priority"))
    around = first_section(asked, chunks, "task_id").select("project_id", "task_id", "section_index").join(
        chunks.select("project_id", "section_index", "chunk_key"), ["project_id", "section_index"]
    ).select("project_id", "task_id", "chunk_key", F.lit(2).alias("priority"))
    return cited.union(around).groupBy("project_id", "task_id", "chunk_key").agg(F.min("priority").alias("priority"))


def citation_rates(tasks: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of citations that resolve, and share of tasks that cite anything."""
    known = chunks.select("project_id", "chunk_key", F.lit(1).alias("_known"))
    by_task = (
        normalized(citations).join(known, ["project_id", "chunk_key"], "left")
        .groupBy("project_id", "task_id").agg(F.count(F.lit(1)).alias("cited"), F.count("_known").alias("real"))
    )
    return (
        tasks.select("project_id", "task_id").join(by_task, ["project_id", "task_id"], "left")
        .groupBy("project_id").agg(
            F.coalesce(F.sum("real") / F.sum("cited"), F.lit(0.0)).alias("citation_validity"),
            (F.count("cited") / F.count(F.lit(1))).alias("evidence_coverage"))
    )


def missing_or_blank(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tasks citing a chunk that is missing or has no text."""
    known = chunks.select("project_id", "chunk_key", "text")
    return (
        normalized(citations).join(known, ["project_id", "chunk_key"], "left")
        .filter(blank(F.col("text"))).select("project_id", "task_id").distinct()
    )
