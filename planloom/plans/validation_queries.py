"""Derived artifacts and the validation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom import vocab
from planloom.operators import artifacts, graph, grounding, provenance, staffing, validation
from planloom.plans.adapters import DUCK, fold_sql
from planloom.plans.people_queries import delivery, owned
from planloom.plans.provenance_queries import judged, norm
from planloom.plans.registry import query
from planloom.plans.schedule_queries import cycles_of, dated, milestone_checks


def details(c):
    """Details with the chunk they cite, '' where the citation is not real."""
    known = c.view("v_chunks").select("project_id", "chunk_key", F.lit(True).alias("_known"))
    return provenance.normalized(c.view("v_details")).join(known, ["project_id", "chunk_key"], "left").withColumn(
        "chunk_key", F.when(F.col("_known"), F.col("chunk_key")).otherwise("")).drop("_known")


def requirements(c):
    known = c.view("v_chunks").select("project_id", "chunk_key", F.lit(True).alias("_known"))
    return provenance.normalized(c.view("v_requirements")).join(known, ["project_id", "chunk_key"], "left").withColumn(
        "chunk_key", F.when(F.col("_known"), F.col("chunk_key")).otherwise("")).drop("_known")


DUCK["v_detail_keys"] = f"""
SELECT d.project_id, {fold_sql('trim(d.name)')} AS n, max_by(coalesce(k.chunk_key, ''), d.ord) AS detail_key FROM v_details d
LEFT JOIN v_chunks k ON k.project_id = d.project_id AND k.chunk_key = {norm('d.raw_key')} GROUP BY 1, 2"""
DUCK["v_reqs"] = f"""
SELECT r.*, coalesce(k.chunk_key, '') AS chunk_key FROM v_requirements r LEFT JOIN v_chunks k ON k.project_id = r.project_id AND k.chunk_key = {norm('r.raw_key')}"""
DUCK["v_client_stories"] = """
SELECT s.project_id, s.story_key, s.requirement_id, r.team, CASE WHEN r.source_status = 'assumed' THEN 'assumed' ELSE 'inferred' END AS source_status, r.chunk_key AS source_key, d.is_delivery AS delivery_side
FROM v_stories s JOIN v_reqs r ON r.project_id = s.project_id AND r.requirement_id = s.requirement_id JOIN v_delivery d ON d.story_key = s.story_key WHERE s.kind = 'client'"""


def client_stories(c):
    return artifacts.client_stories(c.view("v_stories"), requirements(c), c.view("v_projects"))


@query("art_client_story", "SELECT * FROM v_client_stories")
def _(c):
    return client_stories(c).select("project_id", "story_key", "requirement_id", "team", "source_status", "source_key", "delivery_side")


@query("art_client_story_dropped", """
SELECT project_id, story_key, 'story ' || story_key || ' cites unknown requirement ''' || requirement_id || ''', dropped' AS message FROM v_stories s
WHERE kind = 'client' AND NOT EXISTS (SELECT 1 FROM v_requirements r WHERE r.project_id = s.project_id AND r.requirement_id = s.requirement_id)""")
def _(c):
    return artifacts.client_story_warnings(c.view("v_stories"), c.view("v_requirements"))


DUCK["v_story_details"] = f"""
SELECT c.project_id, c.story_key, c.pos, c.name, d.n IS NOT NULL AS found, d.detail_key FROM (
  SELECT project_id, story_key, 1 AS pos, detail_1 AS name FROM v_stories UNION ALL SELECT project_id, story_key, 2, detail_2 FROM v_stories) c
LEFT JOIN v_detail_keys d ON d.project_id = c.project_id AND d.n = {fold_sql('trim(c.name)')}"""


def story_details(c):
    s = c.view("v_stories")
    cited = s.select("project_id", "story_key", F.posexplode(F.array("detail_1", "detail_2")).alias("i", "name")).select(
        "project_id", "story_key", (F.col("i") + 1).alias("pos"), "name")
    return artifacts.resolved_details(cited, details(c))


@query("art_resolve_details", "SELECT story_key, pos, name, found FROM v_story_details")
def _(c):
    return story_details(c).select("story_key", "pos", "name", "found")


DUCK["v_engineer_stories"] = """
SELECT s.project_id, s.story_key, s.task_id, t.team, t.requirement_id, t.assignee_role AS actor, CASE WHEN x.any THEN trim(s.technical_notes) ELSE '' END AS technical_notes,
  CASE WHEN x.any AND trim(s.technical_notes) <> '' THEN CASE WHEN coalesce(k1, '') = '' THEN coalesce(k2, '') WHEN coalesce(k2, '') IN ('', k1) THEN k1 ELSE k1 || ',' || k2 END ELSE '' END AS notes_keys,
  CASE WHEN trim(s.technical_notes) <> '' AND NOT x.any THEN 'engineer story ' || s.story_key || ' has technical notes resting on no detail the SOW stated, notes dropped' ELSE '' END AS warning
FROM v_stories s JOIN v_tasks t ON t.task_id = s.task_id AND t.project_id = s.project_id
JOIN (SELECT story_key, bool_or(found) AS "any", max(detail_key) FILTER (WHERE pos = 1) AS k1, max(detail_key) FILTER (WHERE pos = 2) AS k2 FROM v_story_details GROUP BY 1) x USING (story_key)
WHERE s.kind = 'engineer'""".replace("x.any", 'x."any"')


def engineer_stories(c):
    return artifacts.engineer_stories(c.view("v_stories"), c.view("v_tasks"), story_details(c))


@query("art_engineer_story", "SELECT * FROM v_engineer_stories")
def _(c):
    return engineer_stories(c)


DUCK["v_crit"] = f"""
SELECT c.project_id, c.story_key, c.criterion_key, c.pos, c.text, CASE WHEN coalesce(d.detail_key, '') <> '' THEN trim(measure) ELSE '' END AS measure,
       CASE WHEN trim(measure) <> '' AND coalesce(d.detail_key, '') <> '' THEN d.detail_key ELSE '' END AS source_key, trim(measure) <> '' AND coalesce(d.detail_key, '') = '' AS dropped
FROM v_criteria c LEFT JOIN v_detail_keys d ON d.project_id = c.project_id AND d.n = {fold_sql('trim(c.detail_1)')}"""


def criteria(c):
    drafts = c.view("v_criteria")
    cited = drafts.select("project_id", "criterion_key", F.lit(1).alias("pos"), F.col("detail_1").alias("name"))
    return artifacts.criteria(drafts, artifacts.resolved_details(cited, details(c)))


@query("art_criteria", "SELECT * FROM v_crit")
def _(c):
    return criteria(c)


# Fields a project never settled: those its own findings left assumed.
DUCK["v_assumed"] = "SELECT DISTINCT project_id, field_key FROM v_findings WHERE status = 'assumed'"
DUCK["v_case_rows"] = """
SELECT c.*, coalesce(a, '') AS assumed_fields, coalesce(a, '') <> '' AS rests_on_assumption,
       CASE WHEN field_1 = 'no_such_field' OR field_2 = 'no_such_field' THEN 'no_such_field' ELSE '' END AS unknown_fields
FROM v_cases c LEFT JOIN (SELECT case_key, string_agg(DISTINCT f, ',' ORDER BY f) AS a FROM (
  SELECT case_key, project_id, field_1 AS f FROM v_cases UNION ALL SELECT case_key, project_id, field_2 FROM v_cases) x
  JOIN v_assumed g ON g.project_id = x.project_id AND g.field_key = x.f WHERE x.f <> 'no_such_field' GROUP BY 1) USING (case_key)"""


def cases(c):
    rows = c.view("v_cases").withColumn("fields", F.array("field_1", "field_2"))
    assumed = c.view("v_findings").filter("status = 'assumed'").select("project_id", "field_key").distinct()
    return artifacts.test_cases(rows, assumed)


@query("art_test_cases", "SELECT case_key, assumed_fields, rests_on_assumption, unknown_fields FROM v_case_rows")
def _(c):
    return cases(c).select("case_key", "assumed_fields", "rests_on_assumption", "unknown_fields")


@query("art_sentence", """
SELECT story_key, 'As a ' || actor || ', I want ' || CASE WHEN lower(trim(capability)) LIKE 'to %' THEN trim(capability) ELSE 'to ' || trim(capability) END || ' so that ' || benefit AS sentence FROM v_stories""")
def _(c):
    return c.view("v_stories").select("story_key", artifacts.sentence(F.col("actor"), F.col("capability"), F.col("benefit")).alias("sentence"))


@query("art_criterion_text", "SELECT criterion_key, CASE WHEN measure <> '' THEN text || ' — ' || measure ELSE text END AS rendered FROM v_crit")
def _(c):
    return criteria(c).select("criterion_key", artifacts.criterion_text(F.col("text"), F.col("measure")).alias("rendered"))


DUCK["v_task_stories"] = """
SELECT s.project_id, s.task_id, s.story_key, 'own' AS via FROM v_stories s JOIN v_tasks t ON t.task_id = s.task_id AND t.project_id = s.project_id
UNION ALL SELECT t.project_id, t.task_id, s.story_key, 'requirement' FROM v_tasks t JOIN v_stories s ON s.project_id = t.project_id AND s.requirement_id = t.requirement_id AND s.task_id IS NULL
WHERE t.requirement_id <> '' AND NOT EXISTS (SELECT 1 FROM v_stories o WHERE o.task_id = t.task_id)"""


@query("art_for_task", "SELECT * FROM v_task_stories")
def _(c):
    return artifacts.stories_for_tasks(c.view("v_stories"), c.view("v_tasks"))


# Stages ----------------------------------------------------------------------------------

DUCK["v_off_schema"] = "SELECT project_id, 'schema' AS stage, CAST(task_id AS STRING) AS item FROM v_tasks WHERE trim(title) = '' OR team NOT IN ('commercial', 'technical', 'operations')"
DUCK["v_off_grounding"] = "SELECT project_id, 'grounding' AS stage, CAST(task_id AS STRING) AS item FROM v_scores WHERE status = 'reject'"
DUCK["v_off_evidence"] = """
SELECT DISTINCT c.project_id, 'evidence' AS stage, CAST(c.task_id AS STRING) AS item FROM v_cited c LEFT JOIN v_chunks k USING (project_id, chunk_key) WHERE coalesce(trim(k.text), '') = ''"""
_sig = {t: "|".join(w for w in words) for t, words in vocab.TEAM_SIGNALS.items()}
_hit = {t: f"regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])({p})([^\\p{{L}}\\p{{N}}_]|$)')" for t, p in _sig.items()}
DUCK["v_off_rules"] = f"""
SELECT project_id, 'business_rules' AS stage, CAST(task_id AS STRING) AS item FROM (
  SELECT *, CAST({_hit['commercial']} AS INT) AS c, CAST({_hit['technical']} AS INT) AS t, CAST({_hit['operations']} AS INT) AS o FROM (SELECT *, lower(title || ' ' || description) AS x FROM v_tasks))
WHERE c + t + o = 1 AND team <> CASE WHEN c = 1 THEN 'commercial' WHEN t = 1 THEN 'technical' ELSE 'operations' END"""
DUCK["v_issues"] = """
SELECT project_id, 'self_reference' AS kind, depends_on_id AS src, task_id AS dst, task_id || ' depends on itself' AS detail FROM v_deps WHERE task_id = depends_on_id
UNION ALL SELECT project_id, 'unknown_task', depends_on_id, task_id, task_id || ' depends on unknown task ' || depends_on_id FROM v_deps WHERE task_id <> depends_on_id AND depends_on_id NOT IN (SELECT task_id FROM v_tasks)
UNION ALL SELECT project_id, 'cycle', src, dst, 'circular dependency of ' || count(*) || ' tasks; removed ' || src || ' -> ' || dst FROM v_loop_steps GROUP BY 1, 3, 4"""
DUCK["v_issue_projects"] = """
SELECT project_id FROM v_deps WHERE task_id = depends_on_id OR depends_on_id NOT IN (SELECT task_id FROM v_tasks) UNION SELECT project_id FROM v_removed"""
DUCK["v_off_deps"] = """
SELECT DISTINCT project_id, 'dependencies' AS stage, CAST(task_id AS STRING) AS item FROM v_tasks t
WHERE project_id IN (SELECT project_id FROM v_issue_projects) OR task_id IN (SELECT task_id FROM v_demoted WHERE source_status = 'explicit' AND good_key = '' AND depends_on_id IN (SELECT task_id FROM v_tasks))"""
DUCK["v_off_timeline"] = "SELECT d.project_id, 'timeline' AS stage, CAST(task_id AS STRING) AS item FROM v_dated d JOIN v_projects p USING (project_id) WHERE d.due_date > p.go_live_date"
DUCK["v_off_ms"] = "SELECT project_id, 'milestones' AS stage, CAST(milestone_id AS STRING) AS item FROM v_ms WHERE status = 'late'"
# Overlaps against the latest-ending earlier task, by joining each task with those before it.
DUCK["v_overlaps"] = """
SELECT * FROM (
  SELECT b.project_id, b.owner, a.task_id AS first_task_id, b.task_id AS second_task_id, CAST(a.due_date - b.start_date + 1 AS INT) AS overlap_days,
         b.owner || ' is on ''' || a.title || ''' and ''' || b.title || ''' at the same time (' || (a.due_date - b.start_date + 1) || ' day(s) overlapping)' AS message,
         a.due_date >= b.start_date AS clash
  FROM (SELECT * FROM v_owned WHERE due_date IS NOT NULL AND owner <> '') b JOIN (SELECT * FROM v_owned WHERE due_date IS NOT NULL AND owner <> '') a
    ON a.project_id = b.project_id AND a.owner = b.owner AND (a.start_date, a.ord) < (b.start_date, b.ord)
  QUALIFY row_number() OVER (PARTITION BY b.task_id ORDER BY a.due_date DESC, a.start_date, a.ord) = 1) WHERE clash"""
DUCK["v_off_staffing"] = "SELECT DISTINCT project_id, 'staffing' AS stage, CAST(x AS STRING) AS item FROM (SELECT project_id, first_task_id AS x FROM v_overlaps UNION ALL SELECT project_id, second_task_id FROM v_overlaps)"
DUCK["v_all_stories"] = """
SELECT s.project_id, s.story_key, s.kind, s.requirement_id, s.task_id, d.is_delivery AS delivery_side, s.technical_notes, coalesce(e.notes_keys, '') AS notes_keys, coalesce(c.source_key, '') AS source_key
FROM v_stories s JOIN v_delivery d USING (story_key) LEFT JOIN v_engineer_stories e USING (story_key) LEFT JOIN v_client_stories c USING (story_key)"""
DUCK["v_raw_crit"] = "SELECT c.*, k.source_key FROM v_criteria c JOIN (SELECT criterion_key, source_key FROM v_crit) k USING (criterion_key)"
DUCK["v_derived"] = """
SELECT project_id, 'story_without_requirement' AS rule, story_key AS item FROM v_all_stories WHERE kind <> 'engineer' AND requirement_id = ''
UNION ALL SELECT project_id, 'engineer_story_without_task', story_key FROM v_all_stories WHERE kind = 'engineer' AND task_id IS NULL
UNION ALL SELECT project_id, 'case_without_story', case_key FROM v_case_rows WHERE story_key = ''
UNION ALL SELECT project_id, 'story_without_criteria', story_key FROM v_all_stories ANTI JOIN v_criteria USING (story_key)
UNION ALL SELECT project_id, 'story_from_delivery_side', story_key FROM v_all_stories WHERE kind <> 'engineer' AND delivery_side
UNION ALL SELECT project_id, 'threshold_uncited', criterion_key FROM v_raw_crit WHERE measure <> '' AND source_key = ''
UNION ALL SELECT project_id, 'notes_uncited', story_key FROM v_all_stories WHERE technical_notes <> '' AND notes_keys = ''
UNION ALL SELECT project_id, 'number_unexplained', case_key FROM (SELECT * FROM v_case_rows WHERE regexp_matches(expected_result, '[0-9]') AND assumed_fields = '') ANTI JOIN (SELECT story_key FROM v_all_stories WHERE source_key <> '') s USING (story_key)
UNION ALL SELECT project_id, 'criteria_of_rejected_task', story_key FROM (SELECT * FROM v_all_stories WHERE kind = 'engineer') SEMI JOIN (SELECT task_id FROM v_tasks WHERE validation_status IN ('reject', 'unsupported')) r USING (task_id) SEMI JOIN (SELECT story_key FROM v_criteria) k USING (story_key)"""
DUCK["v_off_derived"] = "SELECT DISTINCT project_id, 'derived_artifacts' AS stage, item FROM v_derived"
DUCK["v_offenders"] = " UNION ALL ".join(f"SELECT * FROM v_off_{n}" for n in ["schema", "grounding", "evidence", "rules", "deps", "timeline", "ms", "staffing", "derived"])


@query("val_schema", "SELECT * FROM v_off_schema")
def val_schema(c):
    return validation.schema(c.view("v_tasks"))


@query("val_grounding", "SELECT * FROM v_off_grounding")
def val_grounding(c):
    return validation.grounding(grounding.task_scores(c.view("v_tasks"), judged(c)))


@query("val_evidence", "SELECT * FROM v_off_evidence")
def val_evidence(c):
    return validation.evidence(provenance.missing_or_blank(c.view("v_citations"), c.view("v_chunks")))


@query("val_business_rules", "SELECT * FROM v_off_rules")
def val_business_rules(c):
    return validation.business_rules(c.view("v_tasks"))


def graph_issues(c):
    return graph.issues(c.view("v_deps"), c.view("v_tasks"), *cycles_of(c))


@query("dep_issues", "SELECT * FROM v_issues")
def _(c):
    return graph_issues(c)


def unsourced(c):
    return provenance.demote_explicit(c.view("v_deps"), c.view("v_chunks")).filter("demoted").join(
        c.view("v_tasks").select("project_id", F.col("task_id").alias("depends_on_id")), ["project_id", "depends_on_id"], "left_semi")


def deadlines(c):
    return c.view("v_projects").withColumnRenamed("go_live_date", "deadline")


@query("val_dependencies", "SELECT * FROM v_off_deps")
def val_dependencies(c):
    return validation.dependencies(graph_issues(c), c.view("v_tasks"), unsourced(c))


@query("val_timeline", "SELECT * FROM v_off_timeline")
def val_timeline(c):
    return validation.timeline(dated(c), deadlines(c))


@query("val_milestones", "SELECT * FROM v_off_ms")
def val_milestones(c):
    return validation.milestones(milestone_checks(c))


@query("staff_overlaps", "SELECT project_id, owner, first_task_id, second_task_id, overlap_days, message FROM v_overlaps")
def overlaps(c):
    return c.by_project(lambda c: staffing.overlaps(owned(c), whole=bool(c.parts)))


@query("val_staffing", "SELECT * FROM v_off_staffing")
def val_staffing(c):
    return validation.staffing(overlaps(c))


def all_stories(c):
    keys = ["project_id", "story_key"]
    return (
        delivery(c).select(*keys, "kind", "requirement_id", "task_id", F.col("is_delivery").alias("delivery_side"), "technical_notes")
        .join(engineer_stories(c).select(*keys, "notes_keys"), keys, "left")
        .join(client_stories(c).select(*keys, "source_key"), keys, "left")
    )


def derived_checks(c):
    return c.by_project(_derived)


def _derived(c):
    c.store("v_tasks", "v_chunks")
    # Criteria are judged on the drafts: what they claim, and whether anything stands behind it.
    def drafts(c):
        sources = criteria(c).select("project_id", "criterion_key", "source_key")
        return c.view("v_criteria").join(sources, ["project_id", "criterion_key"])

    # Stories and drafts are each read more than once.
    return validation.derived(c.stage("all stories", all_stories), c.stage("drafts", drafts), cases(c), c.view("v_tasks"))


@query("val_derived", "SELECT * FROM v_derived")
def _(c):
    return derived_checks(c)


def offenders(c):
    """Tables of all offenders: those that are tasks come from one table of marks, opened once."""
    c.store("v_tasks", "v_chunks")
    tasks = c.view("v_tasks")
    found = {
        "grounding": grounding.task_scores(tasks, judged(c)).filter("status = 'reject'"),
        "evidence": provenance.missing_or_blank(c.view("v_citations"), c.view("v_chunks")),
        "dependencies": unsourced(c), "timeline": validation.late(dated(c), deadlines(c)),
        "staffing": overlaps(c).select("project_id", F.explode(F.array("first_task_id", "second_task_id")).alias("task_id")),
    }
    marked = validation.marks(tasks, found, graph_issues(c), c.parts)
    return [validation.opened(marked), val_milestones(c), validation.offending(derived_checks(c), "derived_artifacts", "item")]


DUCK["v_report"] = f"""
SELECT p.project_id, s.stage, coalesce(n, 0) = 0 AS passed, coalesce(n, 0) AS offenders, 'v1' AS validator_version FROM v_projects p
CROSS JOIN (VALUES {', '.join(f"('{s}')" for s in validation.STAGES)}) s(stage)
LEFT JOIN (SELECT project_id, stage, count(*) AS n FROM v_offenders GROUP BY 1, 2) o ON o.project_id = p.project_id AND o.stage = s.stage"""


@query("val_report", "SELECT * FROM v_report")
def val_report(c):
    return c.by_project(lambda c: validation.report(c.view("v_projects"), *offenders(c)))


@query("val_verdict", """
SELECT project_id, bool_and(passed) AS passed, coalesce(string_agg(CASE WHEN NOT passed THEN stage END, ',' ORDER BY stage), '') AS failed_stages FROM v_report GROUP BY 1""")
def _(c):
    return validation.verdict(val_report(c))
