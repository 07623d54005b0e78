"""Sources read from files: uploads, model answers, judgements, artifacts and gold standards.

The given rows are written as files of each kind into the shared folder, and the queries scan those
files. Uploads are a file for each document; answers are rows of JSON lines; gold standards are
arrays in files of many lines, next to which stand copies cut off in the middle.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from planloom.operators import evaluate, gaps
from planloom.plans.adapters import DUCK
from planloom.plans.provenance_queries import gap_fields
from planloom.plans.registry import Catalog, query
from planloom.session import scratch
from planloom.sources import readers, sinks


# Many small files: tasks move their own to where they belong, not the driver one after the other. A folder
# is read only after the write that makes it has ended.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _folder(c, name):
    return f"{scratch(c.spark)}/{name}-{uuid.uuid4().hex}"


# Uploads ---------------------------------------------------------------------------------

DUCK["v_files"] = """
SELECT 'doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' WHEN 2 THEN '.rtf' ELSE '.md' END AS filename,
       CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'rtf' ELSE 'md' END AS file_type, coalesce(text, '') || chr(10) AS text FROM documents"""


def uploads(c):
    """(documents, rejected) of folders with one file for each document."""
    def build(c):
        i = F.col("doc_id") % 4
        ending = F.when(i == 0, ".txt").when(i == 1, ".PDF").when(i == 2, ".rtf").otherwise(".md")
        path = _folder(c, "uploads")
        name = F.coalesce(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ending), F.lit("__HIVE_DEFAULT_PARTITION__"))
        sinks.write_files(c.table("documents").select(name.alias("name"), F.coalesce("text", F.lit("")).alias("value")), path)
        documents, rejected = readers.text_documents(c.spark, path)
        return documents.select("filename", "file_type", "text", F.lit("read").alias("outcome")).unionByName(
            rejected.withColumnRenamed("reason", "outcome"), allowMissingColumns=True)

    return c.once("uploads", build)


@query("src_text_docs", """
SELECT filename, CASE WHEN file_type IN ('txt', 'md') THEN file_type END AS file_type, CASE WHEN file_type IN ('txt', 'md') THEN length(text) END AS chars,
       CASE WHEN file_type IN ('txt', 'md') THEN sha256(text) END AS text_sha256,
       CASE WHEN file_type IN ('txt', 'md') THEN 'read' ELSE 'Unsupported format ''.' || file_type || '''' END AS outcome FROM v_files""")
def _(c):
    return uploads(c).select(
        "filename", "file_type", F.length("text").cast("bigint").alias("chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "outcome")


# Model answers ---------------------------------------------------------------------------


def _saved(c, name, rows):
    """Answers (project_id, output) as compressed files of JSON lines, and the scan of them."""
    path = _folder(c, name)
    rows.select("project_id", "output").write.json(path, compression="gzip")
    return c.spark.read.schema("project_id bigint, output string").json(path)


def _lists(rows, order, fields, name):
    """One list for each project; an answer is one document, so its lists are bounded."""
    return rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *fields))).alias(name))


def dealt(c):
    """The catalog with orders dealt out by project before anything is read off them: lists of a project are
    put together where its rows lie, and what moves is narrow rows, not lists."""
    views = Catalog(c.spark, c.folder)
    views._frames["orders"] = c.table("orders").repartition("o_orderkey")
    return views


def answers(c):
    """Model answers as JSON text, one per project; an unreadable one for every 71st."""
    def build(c):
        c = dealt(c)
        t, keys = c.view("v_tasks"), F.array("raw_key").alias("source_chunk_keys")
        bare = F.when(F.col("ord") > 1, (F.col("task_id") - 1).cast("string"))
        full = F.when(F.col("ord") > 3, F.to_json(F.struct(
            F.concat(F.lit(" "), (F.col("task_id") - 3).cast("string")).alias("depends_on_id"), F.lit("explicit").alias("source_status"),
            F.array(F.lit("K")).alias("source_chunk_keys"), F.lit("order stated").alias("rationale"))))
        depends_on = F.filter(F.array(bare, full), lambda x: x.isNotNull()).alias("depends_on")
        parts = [
            _lists(t, "ord", [F.col("task_id").cast("string").alias("task_id"), "title", "team", "estimated_hours", "source_status", depends_on], "tasks"),
            _lists(c.view("v_requirements"), "ord", ["requirement_id", "team", "title", "source_status", keys], "requirements"),
            _lists(c.view("v_milestones"), "pos", ["name", "target_date"], "milestones"),
            _lists(c.view("v_details"), "ord", ["category", "name", "description", "source_status", keys], "details"),
            _lists(c.view("v_project_roles"), "role_id", [F.col("role_title").alias("title"), "team", "source_status"], "team_roster"),
        ]
        rows = reduce(lambda a, b: a.join(b, "project_id", "left"), parts)
        text = F.to_json(F.struct(*[F.col(x.columns[1]) for x in parts]))
        cut_off = F.expr("substr(output, 1, length(output) - 3)")
        whole = rows.select("project_id", text.alias("output"))
        return _saved(c, "answers", whole.withColumn("output", F.when(F.col("project_id") % 71 == 0, cut_off).otherwise(F.col("output"))))

    return c.once("answers", build)


def parsed(c):
    return readers.parsed_answers(answers(c))[0]


_KNOWN = "project_id % 71 <> 0 AND project_id IN (SELECT project_id FROM v_tasks)"


@query("src_structured_answer", "SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ord) AS INT) AS ord, CAST(task_id AS STRING) AS task_id, title, team, estimated_hours FROM v_tasks WHERE project_id % 71 <> 0")
def _(c):
    return readers.answer_tasks(parsed(c)).select("project_id", "ord", "task_id", "title", "team", "estimated_hours")


@query("src_structured_rejects", "SELECT DISTINCT project_id FROM v_tasks WHERE project_id % 71 = 0")
def _(c):
    return readers.parsed_answers(answers(c))[1].select("project_id")


@query("src_bare_dependency", """
SELECT project_id, CAST(task_id AS STRING) AS task_id, CAST(1 AS INT) AS slot, CAST(task_id - 1 AS STRING) AS depends_on_id, 'inferred' AS source_status, CAST(0 AS INT) AS citations, '' AS rationale FROM v_tasks WHERE ord > 1 AND project_id % 71 <> 0
UNION ALL SELECT project_id, CAST(task_id AS STRING), 2, CAST(task_id - 3 AS STRING), 'explicit', 1, 'order stated' FROM v_tasks WHERE ord > 3 AND project_id % 71 <> 0""")
def _(c):
    return readers.answer_dependencies(readers.answer_tasks(parsed(c)))


@query("src_answer_requirements", f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ord) AS INT) AS pos, requirement_id, team, title, source_status, raw_key AS first_key FROM v_requirements WHERE {_KNOWN}""")
def _(c):
    return readers.answer_list(parsed(c), "requirements").select(
        "project_id", "pos", "requirement_id", "team", "title", "source_status", F.get("source_chunk_keys", F.lit(0)).alias("first_key"))


@query("src_answer_milestones", f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos) AS INT) AS pos, name, target_date FROM v_milestones WHERE {_KNOWN}""")
def _(c):
    return readers.answer_list(parsed(c), "milestones").select("project_id", "pos", "name", "target_date")


@query("src_answer_details", f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ord) AS INT) AS pos, category, name, description, source_status FROM v_details WHERE {_KNOWN}""")
def _(c):
    return readers.answer_list(parsed(c), "details").select("project_id", "pos", "category", "name", "description", "source_status")


@query("src_answer_roster", f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY role_id) AS INT) AS pos, role_title AS title, team, CAST(1 AS INT) AS headcount FROM v_project_roles WHERE {_KNOWN}""")
def _(c):
    return readers.answer_list(parsed(c), "team_roster").select("project_id", "pos", "title", "team", F.coalesce("headcount", F.lit(1)).alias("headcount"))


@query("src_findings_claims_artifacts", """
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos) AS INT) AS pos, field_key, status, value, hint FROM v_findings""")
def _(c):
    finding = ["field_key", "status", "value", F.array("raw_key").alias("evidence_chunk_keys"), "note", "hint"]
    rows = _lists(c.view("v_findings"), "pos", finding, "findings").select("project_id", F.to_json(F.struct("findings")).alias("output"))
    return readers.parsed_findings(_saved(c, "findings", rows)).select("project_id", "pos", "field_key", "status", "value", "hint")


@query("src_claims", "SELECT project_id, CAST(task_id AS STRING) AS task_ref, claim_id, text, is_quantitative FROM v_claims")
def _(c):
    claim = F.struct("claim_id", "text", "is_quantitative")
    of_task = c.view("v_claims").groupBy("project_id", "task_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    rows = _lists(of_task, "task_id", [F.col("task_id").cast("string").alias("task_ref"), "claims"], "tasks")
    return readers.parsed_claims(_saved(c, "claims", rows.select("project_id", F.to_json(F.struct("tasks")).alias("output"))))


@query("src_judgements", "SELECT project_id, claim_id, verdict, raw_key AS first_key, reasoning FROM v_judgements")
def _(c):
    given = ["claim_id", "verdict", F.array("raw_key").alias("supporting_chunk_keys"), "reasoning"]
    rows = _lists(c.view("v_judgements"), "pos", given, "judgements").select("project_id", F.to_json(F.struct("judgements")).alias("output"))
    return readers.parsed_list(_saved(c, "judgements", rows), readers.JUDGEMENT_SCHEMA, "judgements").select(
        "project_id", "claim_id", "verdict", F.get("supporting_chunk_keys", F.lit(0)).alias("first_key"), "reasoning")


def artifacts(c):
    def build(c):
        criteria = _lists_by(c.view("v_criteria"), "pos", ["criterion_key", "text", "measure", F.array("detail_1").alias("source_detail_names")], "acceptance_criteria")
        cases = _lists_by(c.view("v_cases"), "case_key", ["case_key", "title", "expected_result", F.array("field_1", "field_2").alias("depends_on_fields")], "test_cases")
        keys = ["project_id", "story_key"]
        stories = c.view("v_stories").join(criteria, keys, "left").join(cases, keys, "left")
        story = F.struct(
            "story_key", "requirement_id", F.col("task_id").cast("string").alias("task_id"), "actor", "capability", "benefit", "technical_notes",
            "acceptance_criteria", "test_cases")
        of_kind = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", story.alias("s")))))
        rows = stories.groupBy("project_id").agg(of_kind("client").alias("a"), of_kind("engineer").alias("b"))
        texts = F.to_json(F.struct(F.col("a.s").alias("stories"), F.col("b.s").alias("engineer_stories")))
        return _saved(c, "artifacts", rows.select("project_id", texts.alias("output")))

    return readers.parsed_stories(c.once("artifacts", build))


def _lists_by(rows, order, fields, name):
    return rows.groupBy("project_id", "story_key").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *fields))).alias(name))


@query("src_stories", """
SELECT project_id, kind, story_key, CASE WHEN kind = 'client' THEN requirement_id ELSE '' END AS requirement_id, CASE WHEN kind = 'engineer' THEN CAST(task_id AS STRING) END AS task_id,
       CASE WHEN kind = 'client' THEN actor ELSE '' END AS actor, capability, benefit, CASE WHEN kind = 'engineer' THEN technical_notes ELSE '' END AS technical_notes FROM v_stories""")
def _(c):
    client = F.col("kind") == "client"
    return artifacts(c).select(
        "project_id", "kind", "story_key", F.when(client, F.col("requirement_id")).otherwise("").alias("requirement_id"),
        F.when(~client, F.col("task_id")).alias("task_id"), F.when(client, F.col("actor")).otherwise("").alias("actor"), "capability", "benefit",
        F.when(~client, F.col("technical_notes")).otherwise("").alias("technical_notes"))


@query("src_criteria", """
SELECT s.project_id, s.story_key, criterion_key, text, measure, k.detail_1 AS first_detail FROM v_stories s JOIN v_criteria k ON k.project_id = s.project_id AND k.story_key = s.story_key""")
def _(c):
    return artifacts(c).select("project_id", "story_key", F.explode("acceptance_criteria").alias("k")).select(
        "project_id", "story_key", "k.criterion_key", "k.text", "k.measure", F.get("k.source_detail_names", F.lit(0)).alias("first_detail"))


@query("src_cases", """
SELECT s.project_id, s.story_key, case_key, title, expected_result, field_1 || ',' || field_2 AS fields FROM v_stories s JOIN v_cases k ON k.project_id = s.project_id AND k.story_key = s.story_key""")
def _(c):
    return artifacts(c).select("project_id", "story_key", F.explode("test_cases").alias("k")).select(
        "project_id", "story_key", "k.case_key", "k.title", "k.expected_result", F.array_join("k.depends_on_fields", ",").alias("fields"))


# Gold standards --------------------------------------------------------------------------

# A gold standard says what its document leaves open: a project that tests offers without counting
# them, or trains without a duration; and, by its open findings, which assumptions a plan must state.
DUCK["v_gold_gaps"] = """
SELECT DISTINCT project_id, CASE title WHEN 'Test offers' THEN 'offer_count' ELSE 'training_duration' END AS gap FROM v_requirements WHERE title IN ('Test offers', 'Staff training')"""
DUCK["v_gold_categories"] = "SELECT DISTINCT project_id, upper(field_key) AS category FROM v_findings WHERE status = 'assumed'"


def golds(c):
    """(gold standards, files that could not be read)."""
    path_of = lambda: _folder(c, "gold")

    def build(c):
        path = path_of()
        # Cast so that every list sorts by one thing, and named so that gold of plans and of accounts differ.
        requirement = F.struct("ord", "team", "title", F.col("requirement_id").alias("section"))
        gap = F.when(F.col("title") == "Test offers", "offer_count").when(F.col("title") == "Staff training", "training_duration")
        plans = c.view("v_requirements").groupBy("project_id").agg(
            F.array_sort(F.collect_list(requirement)).alias("requirements"), F.map_from_arrays(
                F.collect_set(gap), F.transform(F.collect_set(gap), lambda g: F.lit("not stated"))).alias("known_gaps"))
        accounts = c.view("v_findings").filter("status = 'assumed'").groupBy("project_id").agg(
            F.array_sort(F.collect_set(F.upper("field_key"))).alias("expected_assumption_categories"))
        texts = plans.select("project_id", F.lit("plan").alias("profile"), "requirements", "known_gaps").unionByName(
            accounts.select("project_id", F.lit("account").alias("profile"), "expected_assumption_categories"), allowMissingColumns=True)
        text = F.to_json(F.struct(F.col("project_id").cast("string").alias("doc"), "profile", "requirements", "known_gaps", "expected_assumption_categories"))
        # A file holds the gold of a thousand project numbers.
        files = texts.groupBy("profile", F.floor(F.col("project_id") / 1000).alias("_file")).agg(
            F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list(text)), ",\n"), F.lit("\n]")).alias("value"))
        whole = files.select("value", F.concat_ws("-", "profile", F.col("_file").cast("string")).alias("name"))
        broken = whole.select(F.expr("substr(value, 1, length(value) - 9)").alias("value"), F.concat("name", F.lit("-cut")).alias("name"))
        whole.unionByName(broken).write.options(**BY_TASKS, compression="gzip").partitionBy("name").text(path)
        good, rejected = readers.gold(c.spark, path)
        return good.withColumn("rejected", F.lit(None).cast("string")).unionByName(
            rejected.select(F.regexp_extract("path", "name=([^/]*)", 1).alias("rejected")), allowMissingColumns=True)

    both = c.once("gold", build)  # readers.gold() has written what it parsed
    return both.filter("rejected IS NULL").withColumn("project_id", F.col("doc").cast("bigint")), both.filter("rejected IS NOT NULL").select("rejected")


@query("src_gold", "SELECT project_id, requirement_id AS section, team, title FROM v_requirements")
def _(c):
    return golds(c)[0].filter("profile = 'plan'").select("project_id", F.explode("requirements").alias("r")).select("project_id", "r.section", "r.team", "r.title")


@query("src_gold_gaps", "SELECT project_id, 'gap' AS kind, gap AS name FROM v_gold_gaps UNION ALL SELECT project_id, 'category', category FROM v_gold_categories")
def _(c):
    good = golds(c)[0]
    return good.select("project_id", F.lit("gap").alias("kind"), F.explode(F.map_keys("known_gaps")).alias("name")).unionByName(
        good.select("project_id", F.lit("category").alias("kind"), F.explode("expected_assumption_categories").alias("name")))


@query("src_gold_rejects", """
SELECT DISTINCT 'plan-' || CAST(floor(project_id / 1000) AS BIGINT) || '-cut' AS file FROM v_requirements
UNION ALL SELECT DISTINCT 'account-' || CAST(floor(project_id / 1000) AS BIGINT) || '-cut' FROM v_gold_categories""")
def _(c):
    return golds(c)[1].select(F.col("rejected").alias("file"))


@query("ev_hallucinated", """
SELECT DISTINCT x.project_id, x.gap FROM (
  SELECT project_id, 'offer_count' AS gap FROM v_tasks WHERE source_status = 'explicit' AND regexp_matches(lower(title || ' ' || description), '20 offers|12 offers|15 offers')
  UNION ALL SELECT project_id, 'training_duration' FROM v_tasks WHERE source_status = 'explicit' AND regexp_matches(lower(title || ' ' || description), '2 days|3 days|two days')) x
JOIN v_gold_gaps g ON g.project_id = x.project_id AND g.gap = x.gap""")
def _(c):
    known = golds(c)[0].filter("profile = 'plan'").select("project_id", F.explode(F.map_keys("known_gaps")).alias("gap"))
    return evaluate.hallucinated(c.view("v_tasks"), known)


@query("ev_assumption_recall", """
SELECT p.project_id, coalesce(r, 1.0) AS assumption_recall FROM v_gap_projects p LEFT JOIN (
  SELECT project_id, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS r FROM (
    SELECT e.project_id, e.category, bool_and(coalesce(contains(h.t, e.part), false)) AS ok FROM (SELECT project_id, category, unnest(string_split(lower(category), '_')) AS part FROM v_gold_categories) e
    LEFT JOIN (SELECT project_id, string_agg(lower(category || ' ' || value || ' ' || reason), chr(10)) AS t FROM v_assumptions GROUP BY 1) h USING (project_id) GROUP BY 1, 2) GROUP BY 1) x USING (project_id)""")
def _(c):
    expected = golds(c)[0].filter("profile = 'account'").select("project_id", F.explode("expected_assumption_categories").alias("category"))
    return evaluate.assumption_recall(c.view("v_gap_projects"), expected, gaps.assumptions(gap_fields(c)))
