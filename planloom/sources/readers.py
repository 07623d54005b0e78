"""Sources: documents, model answers and gold standards, with schemas stated and rejects kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.text import strip
from planloom.session import stored

# What can be uploaded, and of that what is plain text.
UPLOADABLE = [".pdf", ".docx", ".txt"]
TEXT_SUFFIXES = [".txt", ".md"]

ANSWER_SCHEMA = """
    project_info struct<project_name:string, merchant_name:string, start_date:date, end_date:date, go_live_date:date>,
    requirements array<struct<requirement_id:string, team:string, title:string, description:string, source_status:string,
        source_chunk_keys:array<string>>>,
    tasks array<struct<task_id:string, title:string, description:string, team:string, assignee_role:string, requirement_id:string,
        milestone:string, estimated_hours:double, source_status:string, source_chunk_keys:array<string>, depends_on:array<string>>>,
    milestones array<struct<name:string, target_date:date, source_status:string, source_chunk_keys:array<string>>>,
    details array<struct<category:string, name:string, description:string, source_status:string, source_chunk_keys:array<string>>>,
    team_roster array<struct<title:string, team:string, responsibility:string, headcount:int, source_status:string,
        source_chunk_keys:array<string>>>, _corrupt_record string
"""
DEPENDENCY_SCHEMA = "depends_on_id string, source_status string, source_chunk_keys array<string>, rationale string"
FINDING_SCHEMA = """findings array<struct<field_key:string, status:string, value:string, evidence_chunk_keys:array<string>,
    note:string, hint:string>>"""
CLAIM_SCHEMA = "tasks array<struct<task_ref:string, claims:array<struct<claim_id:string, text:string, is_quantitative:boolean>>>>"
JUDGEMENT_SCHEMA = "judgements array<struct<claim_id:string, verdict:string, supporting_chunk_keys:array<string>, reasoning:string>>"
_STORY = """array<struct<story_key:string, requirement_id:string, task_id:string, actor:string, capability:string, benefit:string,
    technical_notes:string, source_detail_names:array<string>,
    acceptance_criteria:array<struct<criterion_key:string, text:string, measure:string, source_detail_names:array<string>>>,
    test_cases:array<struct<case_key:string, title:string, preconditions:string, action:string, expected_result:string, kind:string,
        depends_on_fields:array<string>>>>>"""
ARTIFACT_SCHEMA = f"stories {_STORY}, engineer_stories {_STORY}"
GOLD_SCHEMA = """doc string, profile string, project_info map<string,string>, facts map<string,struct<value:string,
    source_status:string, section:string>>, requirements array<struct<team:string,title:string,section:string>>,
    milestones array<struct<name:string,date:string,owner:string>>, expected_dependencies array<array<string>>,
    expected_assumption_categories array<string>, known_gaps map<string,string>"""


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./]*)$", 1))


def text_documents(spark: SparkSession, path: str, named_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents(path, filename, file_type, text), rejected(filename, reason)). One file is one row.

    Bytes that are no UTF-8 become replacement characters, as decoding does. named_by: files stand in
    folders `named_by=filename`, as partitioned writers leave them, and take their names from those.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", f"{named_by}=([^/]*)", 1) if named_by else F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("filename", name).withColumn("file_type", suffix(F.col("filename")))
    good = F.col("file_type").isin(TEXT_SUFFIXES)
    documents = named.filter(good).select(
        "path", "filename", F.regexp_replace("file_type", r"^\.", "").alias("file_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return documents, rejected_files(named.filter(~good))


def rejected_files(named: DataFrame) -> DataFrame:
    return named.select("filename", F.concat(F.lit("Unsupported format '"), "file_type", F.lit("'")).alias("reason"))


def parsed_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers(project_id, output) -> (parsed rows with missing lists empty, rejected rows)."""
    parsed = answers.withColumn(
        "a", F.from_json("output", ANSWER_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("a").isNull() | F.col("a._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("project_id", "a.*").drop("_corrupt_record"), parsed.filter(bad).select("project_id", "output")


def answer_list(parsed: DataFrame, name: str) -> DataFrame:
    """The entries of one list of parsed answers, numbered from one in their order; a missing list has none."""
    return parsed.select("project_id", F.posexplode(name).alias("_at", "_entry")).select(
        "project_id", (F.col("_at") + 1).alias("pos"), "_entry.*")


def answer_tasks(parsed: DataFrame) -> DataFrame:
    return parsed.select("project_id", F.posexplode("tasks").alias("pos", "t")).select("project_id", (F.col("pos") + 1).alias("ord"), "t.*")


def answer_dependencies(tasks: DataFrame) -> DataFrame:
    """Dependencies of parsed tasks; a bare id means inferred, with no citation."""
    each = tasks.select("project_id", "task_id", F.posexplode("depends_on").alias("pos", "raw"))
    parsed = F.when(strip(F.col("raw")).startswith("{"), F.from_json("raw", DEPENDENCY_SCHEMA))
    return each.withColumn("d", parsed).select(
        "project_id", "task_id", (F.col("pos") + 1).alias("slot"),
        strip(F.coalesce("d.depends_on_id", "raw")).alias("depends_on_id"),
        F.coalesce("d.source_status", F.lit("inferred")).alias("source_status"),
        F.size(F.coalesce("d.source_chunk_keys", F.array().cast("array<string>"))).alias("citations"),
        F.coalesce("d.rationale", F.lit("")).alias("rationale"))


def parsed_list(answers: DataFrame, schema: str, name: str) -> DataFrame:
    """The entries of one list of answers(project_id, output) of any schema."""
    return answer_list(answers.select("project_id", F.from_json("output", schema).alias("a")).select("project_id", "a.*"), name)


def parsed_findings(answers: DataFrame) -> DataFrame:
    return parsed_list(answers, FINDING_SCHEMA, "findings")


def parsed_claims(answers: DataFrame) -> DataFrame:
    tasks = parsed_list(answers, CLAIM_SCHEMA, "tasks")
    return tasks.select("project_id", "task_ref", F.explode("claims").alias("c")).select("project_id", "task_ref", "c.*")


def parsed_stories(answers: DataFrame) -> DataFrame:
    """Client and engineer stories, told apart by `kind`, with their criteria and cases."""
    kinds = {"stories": "client", "engineer_stories": "engineer"}
    both = [parsed_list(answers, ARTIFACT_SCHEMA, name).withColumn("kind", F.lit(kind)) for name, kind in kinds.items()]
    return both[0].unionByName(both[1])


def gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gold standards, rejected(path)): files of one JSON object or an array of them, over any number of
    lines. A file that does not parse is rejected whole: nothing read from it counts."""
    raw = spark.read.schema(f"{GOLD_SCHEMA}, _corrupt_record string").json(path, multiLine=True, recursiveFileLookup=True)
    # Parsed once and written: Spark asks for that where rejects are looked at by themselves.
    seen = stored(raw.withColumn("path", F.col("_metadata.file_path")))
    bad = seen.filter("_corrupt_record IS NOT NULL").select("path").distinct()
    return seen.join(bad, "path", "left_anti").drop("_corrupt_record", "path"), bad
