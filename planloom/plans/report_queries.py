"""Sources, sinks, reporting views, request cache and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planloom import vocab
from planloom.operators import board, evaluate, gaps, grounding, linking, provenance, segment, validation, views
from planloom.plans.adapters import DUCK
from planloom.plans.provenance_queries import gap_fields, judged, norm, rates
from planloom.plans.registry import query
from planloom.plans.schedule_queries import placed
from planloom.plans.validation_queries import all_stories, cases, client_stories, criteria, requirements, val_report
from planloom.plans.validation_queries import details as detail_rows
from planloom.session import scratch
from planloom.sources import sinks

# Sources ---------------------------------------------------------------------------------

@query("scan_filter", """
SELECT project_id, task_id, title FROM v_tasks WHERE review_status <> 'rejected' AND due_date IS NOT NULL AND board_dirty AND team IN ('technical', 'operations') AND external_ref <> ''""")
def _(c):
    return c.view("v_tasks").filter(
        (F.col("review_status") != "rejected") & F.col("due_date").isNotNull() & F.col("board_dirty")
        & F.col("team").isin("technical", "operations") & (F.col("external_ref") != "")).select("project_id", "task_id", "title")


# Sinks -----------------------------------------------------------------------------------


def folder(c, name):
    return f"{scratch(c.spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_replace_by_project", """
SELECT project_id, role_id, role_title, source_status FROM v_project_roles WHERE project_id % 3 <> 0
UNION ALL SELECT project_id, project_id * 10 + 9, 'Replaced role', 'assumed' FROM v_projects WHERE project_id % 3 = 0 AND project_id % 2 = 0""")
def _(c):
    path = folder(c, "roles")
    sinks.create(c.view("v_project_roles").select("project_id", "role_id", "role_title", "source_status"), path, "project_id")
    again = c.view("v_projects").filter("project_id % 3 = 0")
    new = again.filter("project_id % 2 = 0").select(
        "project_id", (F.col("project_id") * 10 + 9).alias("role_id"), F.lit("Replaced role").alias("role_title"), F.lit("assumed").alias("source_status"))
    sinks.replace(new, path, ["project_id"], again)
    return sinks.read(c.spark, path)


@query("sink_replace_by_key", """
SELECT project_id, task_id, claim_id, 'old' AS run FROM v_claims WHERE part_id % 5 <> 0 OR task_id % 2 = 0
UNION ALL SELECT project_id, task_id, claim_id, 'new' FROM v_claims WHERE part_id % 5 = 0 AND task_id % 2 = 1""".replace(
    "part_id % 5 <> 0 OR task_id % 2 = 0", "task_id NOT IN (SELECT task_id FROM v_claims WHERE part_id % 5 = 0 AND task_id % 2 = 1)"))
def _(c):
    path, claims = folder(c, "claims"), c.view("v_claims")
    sinks.create(claims.select("project_id", "task_id", "claim_id", F.lit("old").alias("run")), path, "project_id")
    new = claims.filter("part_id % 5 = 0 AND task_id % 2 = 1").select("project_id", "task_id", "claim_id", F.lit("new").alias("run"))
    sinks.replace(new, path, ["project_id", "task_id"], new.select("project_id", "task_id"))
    return sinks.read(c.spark, path)


@query("sink_append_log", "SELECT conv_id AS project_id, turn, role AS graph_node FROM conversations UNION ALL SELECT conv_id, turn, 'again' FROM conversations WHERE role = 'user'")
def _(c):
    path, log = folder(c, "requests"), c.view("v_requests").select("project_id", "turn", "graph_node")
    sinks.append_log(log, path)
    sinks.append_log(log.filter("graph_node = 'user'").withColumn("graph_node", F.lit("again")), path)
    return c.spark.read.parquet(path)


CHILDREN = [
    "tasks", "deps", "chunks", "citations", "requirements", "milestones", "details", "findings", "claims", "judgements", "stories", "criteria", "cases",
    "project_roles",
]


@query("cascade_delete", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows_left FROM v_{n} c WHERE NOT EXISTS (SELECT 1 FROM v_projects p WHERE p.name = '' AND p.project_id = c.project_id)"
    for n in CHILDREN))
def _(c):
    out = None
    tables = {n: c.view(f"v_{n}").select("project_id") for n in CHILDREN}
    for name, left in sinks.cascade_delete(tables, c.view("v_projects").filter("name = ''")).items():
        part = left.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        out = part if out is None else out.unionByName(part)
    return out


@query("orphan_check", """
SELECT 'dependency.depends_on_id' AS reference, project_id || '/' || depends_on_id AS missing FROM v_deps WHERE depends_on_id NOT IN (SELECT task_id FROM v_tasks)
UNION ALL SELECT 'task.requirement_id', project_id || '/' || requirement_id FROM v_tasks t WHERE requirement_id <> '' AND NOT EXISTS (SELECT 1 FROM v_requirements r WHERE r.project_id = t.project_id AND r.requirement_id = t.requirement_id)
UNION ALL SELECT 'project_role.person_id', person_id || '' FROM v_project_roles WHERE person_id NOT IN (SELECT person_id FROM v_people)
UNION ALL SELECT 'story.task_id', project_id || '/' || task_id FROM v_stories WHERE task_id NOT IN (SELECT task_id FROM v_tasks)""")
def _(c):
    known = c.view("v_tasks").select("project_id", "task_id")
    return (
        sinks.orphans(c.view("v_deps"), known.withColumnRenamed("task_id", "depends_on_id"), ["project_id", "depends_on_id"], "dependency.depends_on_id")
        .unionByName(sinks.orphans(c.view("v_tasks"), c.view("v_requirements"), ["project_id", "requirement_id"], "task.requirement_id"))
        .unionByName(sinks.orphans(c.view("v_project_roles"), c.view("v_people"), ["person_id"], "project_role.person_id"))
        .unionByName(sinks.orphans(c.view("v_stories"), known, ["project_id", "task_id"], "story.task_id")))


@query("doc_key_assign", """
WITH have AS (SELECT doc_id, printf('SOW-%03d', doc_id + 7) AS doc_key FROM documents WHERE lang = 'de')
SELECT doc_id, doc_key FROM have
UNION ALL SELECT doc_id, printf('SOW-%03d', row_number() OVER (ORDER BY doc_id) + (SELECT max(CAST(substr(doc_key, 5) AS BIGINT)) FROM have)) FROM documents WHERE lang IS DISTINCT FROM 'de'""")
def _(c):
    # Documents in one language have been taken in before and have their keys.
    docs = c.table("documents").select("doc_id", "lang")
    before = F.coalesce(F.col("lang") == "de", F.lit(False))
    have = docs.filter(before).select("doc_id", F.format_string("SOW-%03d", F.col("doc_id") + 7).alias("doc_key"))
    return have.unionByName(segment.assign_keys(docs.filter(~before), have))


# Views -----------------------------------------------------------------------------------


@query("view_projects", """
SELECT p.*, coalesce(t, 0) AS task_count, coalesce(a, 0) AS assumption_count FROM v_projects p LEFT JOIN (SELECT project_id, count(*) AS t FROM v_tasks GROUP BY 1) USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS a FROM v_assumptions GROUP BY 1) USING (project_id)""")
def _(c):
    return views.projects_overview(c.view("v_projects"), c.view("v_tasks"), gaps.assumptions(gap_fields(c)))


@query("view_tasks", """
SELECT t.project_id, t.task_id, t.title, t.team, f.section_title AS source_section, coalesce(n, 0) AS dependency_count, t.review_status, t.external_ref, t.board_dirty
FROM v_tasks t LEFT JOIN v_first f USING (task_id) LEFT JOIN (SELECT task_id, count(*) AS n FROM v_linked GROUP BY 1) d ON d.task_id = t.task_id""")
def _(c):
    keys = ["project_id", "task_id"]
    sections = provenance.first_section(provenance.valid(c.view("v_citations"), c.view("v_chunks")), c.view("v_chunks"), "task_id")
    n = linking.link_dependencies(c.view("v_deps"), c.view("v_tasks")).groupBy(*keys).agg(F.count(F.lit(1)).alias("dependency_count"))
    return c.view("v_tasks").join(sections.select(*keys, F.col("section_title").alias("source_section")), keys, "left").join(n, keys, "left").select(
        *keys, "title", "team", "source_section", F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"), "review_status", "external_ref", "board_dirty")


@query("view_task_dependencies", """
SELECT l.project_id, l.task_id, u.title, l.source_status, l.rationale FROM v_linked l JOIN v_tasks u ON u.task_id = l.depends_on_id""")
def _(c):
    up = c.view("v_tasks").select("project_id", F.col("task_id").alias("depends_on_id"), "title")
    return linking.link_dependencies(c.view("v_deps"), c.view("v_tasks")).join(up, ["project_id", "depends_on_id"]).select(
        "project_id", "task_id", "title", "source_status", linking.clean_rationale(F.col("rationale")).alias("rationale"))


@query("view_roles", "SELECT r.project_id, r.role_id, r.team, r.role_title, r.person_id, p.name AS person FROM v_project_roles r LEFT JOIN v_people p USING (person_id)")
def _(c):
    people = c.view("v_people").select("person_id", F.col("name").alias("person"))
    return c.view("v_project_roles").join(people, "person_id", "left").select(
        "project_id", "role_id", "team", "role_title", "person_id", "person").orderBy("project_id", "team", "role_title")


DUCK["v_linked_tasks"] = """
SELECT t.*, r.requirement_id AS linked, r.team AS req_team FROM v_tasks t LEFT JOIN v_requirements r ON r.project_id = t.project_id AND r.requirement_id = t.requirement_id"""


DUCK["v_placed_stories"] = """
SELECT s.*, t.req_team AS tree_team, 'engineer_story' AS node, s.task_id || '' AS owner FROM v_stories s JOIN v_linked_tasks t USING (project_id, task_id) WHERE s.kind = 'engineer' AND t.linked IS NOT NULL
UNION ALL SELECT s.*, r.team, 'user_story', s.requirement_id FROM v_stories s JOIN v_requirements r USING (project_id, requirement_id) WHERE NOT (s.kind = 'engineer' AND s.task_id IS NOT NULL)"""


@query("view_structure", f"""
SELECT project_id, team, 'role' AS node, '' AS parent, role_title AS label, coalesce(p.name, '') AS text, source_status AS status, '' AS detail, false AS other_team FROM v_project_roles LEFT JOIN v_people p USING (person_id)
UNION ALL SELECT t.project_id, t.team, 'detail', category, name, description, t.source_status, coalesce(k.chunk_key, ''), false FROM v_teamed t LEFT JOIN v_chunks k ON k.project_id = t.project_id AND k.chunk_key = {norm('t.raw_key')}
UNION ALL SELECT project_id, team, 'requirement', '', requirement_id, title, source_status, chunk_key, false FROM v_reqs
UNION ALL SELECT project_id, req_team, 'task', linked, task_id || '', title, validation_status, assignee_role, team <> req_team FROM v_linked_tasks WHERE linked IS NOT NULL
UNION ALL SELECT project_id, team, 'unlinked_task', '', task_id || '', title, validation_status, assignee_role, false FROM v_linked_tasks WHERE linked IS NULL
UNION ALL SELECT project_id, tree_team, node, owner, story_key, 'As a ' || actor || ', I want ' || CASE WHEN lower(trim(capability)) LIKE 'to %' THEN trim(capability) ELSE 'to ' || trim(capability) END || ' so that ' || benefit, 'inferred', '', false FROM v_placed_stories
UNION ALL SELECT c.project_id, s.tree_team, 'criterion', c.story_key, c.criterion_key, CASE WHEN c.measure <> '' THEN c.text || ' — ' || c.measure ELSE c.text END, '', c.source_key, false FROM v_crit c JOIN v_placed_stories s ON s.project_id = c.project_id AND s.story_key = c.story_key
UNION ALL SELECT c.project_id, s.tree_team, 'test_case', c.story_key, c.case_key, c.title, CASE WHEN c.rests_on_assumption THEN 'assumed' ELSE '' END, c.assumed_fields, false FROM v_case_rows c JOIN v_placed_stories s ON s.project_id = c.project_id AND s.story_key = c.story_key""")
def _(c):
    return c.by_project(structure)


def structure(c):
    c.store("v_tasks", "v_chunks")
    details = linking.detail_team(detail_rows(c), vocab.detail_categories(c.spark))
    tasks = linking.link_requirements(c.view("v_tasks"), c.view("v_requirements"))
    return views.structure(
        c.view("v_project_roles"), c.view("v_people"), details, requirements(c), tasks, c.view("v_stories"), criteria(c), cases(c))


@query("view_structure_totals", """
SELECT p.project_id, (SELECT count(*) FROM v_tasks x WHERE x.project_id = p.project_id) AS tasks, (SELECT count(*) FROM v_requirements x WHERE x.project_id = p.project_id) AS requirements,
       (SELECT count(*) FROM v_stories x WHERE x.project_id = p.project_id) AS user_stories, (SELECT count(*) FROM v_stories x WHERE x.project_id = p.project_id AND kind = 'engineer') AS engineer_stories,
       (SELECT count(*) FROM v_cases x WHERE x.project_id = p.project_id) AS test_cases, (SELECT count(*) FROM v_case_rows x WHERE x.project_id = p.project_id AND rests_on_assumption) AS cases_on_assumptions,
       (SELECT count(*) FROM v_details x WHERE x.project_id = p.project_id) AS detail_items, (SELECT count(*) FROM v_questions x WHERE x.project_id = p.project_id) AS open_questions FROM v_projects p""")
def _(c):
    stories = c.view("v_stories")
    return views.totals(
        c.view("v_projects"), tasks=c.view("v_tasks"), requirements=c.view("v_requirements"), user_stories=stories,
        engineer_stories=stories.filter("kind = 'engineer'"), test_cases=c.view("v_cases"),
        cases_on_assumptions=cases(c).filter("rests_on_assumption"), detail_items=c.view("v_details"),
        open_questions=gaps.questions(gap_fields(c)))


@query("view_team_totals", """
WITH counts AS (
  SELECT project_id, team, 1 AS t, 0 AS r, 0 AS q FROM v_tasks UNION ALL SELECT project_id, team, 0, 1, 0 FROM v_requirements UNION ALL SELECT project_id, team, 0, 0, 1 FROM v_questions)
SELECT p.project_id, x.team, count(*) FILTER (WHERE t = 1) AS task_count, count(*) FILTER (WHERE r = 1) AS requirements, count(*) FILTER (WHERE q = 1) AS open_questions
FROM v_projects p CROSS JOIN (VALUES ('commercial'), ('technical'), ('operations'), ('all')) x(team) LEFT JOIN counts n ON n.project_id = p.project_id AND (x.team = 'all' OR x.team = n.team) GROUP BY 1, 2""")
def _(c):
    return views.team_totals(
        c.view("v_projects"), task_count=c.view("v_tasks"), requirements=c.view("v_requirements"), open_questions=gaps.questions(gap_fields(c)))


DUCK["v_log"] = "SELECT *, sha256(model || '|' || schema_name || '|' || prompt_text) AS input_hash FROM v_requests"


def log(c):
    return c.view("v_requests").withColumn("input_hash", views.request_hash())


@query("view_audit", "SELECT project_id, turn, graph_node, model, substr(input_hash, 1, 12) AS hash_prefix, created_at, CAST(length(output_text) AS INT) AS output_chars FROM v_log")
def _(c):
    return views.audit(log(c))


DUCK["v_project_scores"] = """
SELECT p.project_id, coalesce(s, 1.0) AS score FROM v_projects p LEFT JOIN (SELECT project_id, CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) AS s FROM v_judged GROUP BY 1) j USING (project_id)"""


def project_scores(c):
    return grounding.project_scores(c.view("v_projects"), judged(c))


@query("view_audit_trail", """
SELECT project_id, 'request' AS entry, graph_node AS name, created_at AS position, CAST(NULL AS BOOLEAN) AS passed, CAST(length(output_text) AS BIGINT) AS amount, CAST(NULL AS DOUBLE) AS score FROM v_log SEMI JOIN v_projects USING (project_id)
UNION ALL SELECT project_id, 'stage', stage, NULL, passed, offenders, score FROM v_report JOIN v_project_scores USING (project_id)
UNION ALL SELECT p.project_id, 'total_requests', '', NULL, NULL, count(l.project_id), NULL FROM v_projects p LEFT JOIN v_log l USING (project_id) GROUP BY 1""")
def _(c):
    return c.by_project(lambda c: views.audit_trail(c.view("v_projects"), log(c), stored_report(c), project_scores(c)))


def stored_report(c):
    return c.stage("validation_report", val_report)


_order = ", ".join(f"('{s}', {i})" for i, s in enumerate(validation.STAGES))


@query("review_ready_message", f"""
SELECT p.project_id, '**New project ready for review**' || chr(10) || 'Project: ' || p.name || chr(10) || 'Tasks: ' || (a + b + o) || CASE WHEN a + b + o > 0 THEN ' (' || concat_ws(', ', CASE WHEN a > 0 THEN 'commercial ' || a END,
   CASE WHEN b > 0 THEN 'technical ' || b END, CASE WHEN o > 0 THEN 'operations ' || o END) || ')' ELSE '' END || chr(10) || 'Critical path: ' || k || ' tasks' || chr(10) || 'Assumptions: ' || coalesce(m, 0) || chr(10)
   || 'Grounding score: ' || CAST(round_even(score * 100, 0) AS INT) || '%' || chr(10) || 'Validation: ' || coalesce(failed || ' failed', 'all stages passed') || chr(10) || 'Status: awaiting PM approval' AS message
FROM v_projects p JOIN (SELECT t.project_id, count(*) FILTER (WHERE t.team = 'commercial') AS a, count(*) FILTER (WHERE t.team = 'technical') AS b, count(*) FILTER (WHERE t.team = 'operations') AS o, count(*) FILTER (WHERE s.slack_days = 0) AS k
  FROM v_tasks t JOIN v_sched s USING (task_id) GROUP BY 1) USING (project_id)
JOIN v_project_scores USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS m FROM v_assumptions GROUP BY 1) USING (project_id)
LEFT JOIN (SELECT project_id, string_agg(stage, ', ' ORDER BY n) AS failed FROM v_report JOIN (VALUES {_order}) x(stage, n) USING (stage) WHERE NOT passed GROUP BY 1) USING (project_id)""")
def _(c):
    return c.by_project(ready_messages)


def ready_messages(c):
    counts = placed(c).groupBy("project_id").agg(*[F.count_if(F.col("team") == t).alias(t) for t in vocab.TEAMS], F.count_if("is_critical").alias("critical"))
    assumed = gaps.assumptions(gap_fields(c)).groupBy("project_id").agg(F.count(F.lit(1)).alias("assumptions"))
    rows = (
        c.view("v_projects").select("project_id", "name").join(counts, "project_id").join(project_scores(c), "project_id")
        .join(assumed, "project_id", "left").join(validation.failed_stages(stored_report(c)), "project_id")
        .fillna(0, ["assumptions"]))
    return board.review_ready(rows)


@query("llm_cache_lookup", """
SELECT r.project_id, r.turn, l.cached AS cached_output, l.cached IS NOT NULL AS hit FROM v_log r LEFT JOIN (
  SELECT input_hash, max_by(output_text, created_at) AS cached FROM v_log WHERE graph_node = 'user' GROUP BY 1) l USING (input_hash)""")
def _(c):
    return views.cache_lookup(log(c), log(c).filter("graph_node = 'user'")).select("project_id", "turn", "cached_output", "hit")


# Evaluation ------------------------------------------------------------------------------

_area = " UNION ALL ".join(
    f"SELECT project_id, '{a}' AS area FROM {{src}} WHERE " + " OR ".join(f"contains(x, '{w}')" for w in ws) for a, ws in vocab.COVERAGE_AREAS.items())
DUCK["v_expected_areas"] = "SELECT DISTINCT * FROM (" + _area.format(src="(SELECT project_id, lower(title) AS x FROM v_requirements)") + ")"
DUCK["v_task_areas"] = "SELECT DISTINCT * FROM (" + _area.format(src="(SELECT project_id, lower(title || ' ' || description) AS x FROM v_tasks)") + ")"
DUCK["v_areas"] = "SELECT e.project_id, e.area, t.area IS NOT NULL AS covered FROM v_expected_areas e LEFT JOIN v_task_areas t ON t.project_id = e.project_id AND t.area = e.area"


def areas(c):
    return evaluate.area_coverage(evaluate.expected_areas(c.view("v_requirements")), c.view("v_tasks"))


@query("ev_areas", "SELECT * FROM v_areas")
def _(c):
    return areas(c)


@query("ev_coverage", """
SELECT p.project_id, coalesce(s, 0.0) AS task_coverage FROM v_projects p LEFT JOIN (SELECT project_id, CAST(count(*) FILTER (WHERE covered) AS DOUBLE) / count(*) AS s FROM v_areas GROUP BY 1) USING (project_id)""")
def _(c):
    return evaluate.coverage(c.view("v_projects"), areas(c))


DUCK["v_ev_grounding"] = """
SELECT project_id, CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) AS grounding_score,
       CASE WHEN count(*) FILTER (WHERE is_quantitative) > 0 THEN CAST(count(*) FILTER (WHERE verdict = 'supported' AND is_quantitative) AS DOUBLE) / count(*) FILTER (WHERE is_quantitative) END AS quantitative_grounding FROM v_judged GROUP BY 1"""


@query("ev_grounding", "SELECT project_id, grounding_score FROM v_ev_grounding")
def _(c):
    return evaluate.grounding_rates(judged(c)).select("project_id", "grounding_score")


@query("ev_quant_grounding", "SELECT project_id, quantitative_grounding FROM v_ev_grounding")
def _(c):
    return evaluate.grounding_rates(judged(c)).select("project_id", "quantitative_grounding")


@query("ev_provenance_mix", "SELECT project_id, source_status, count(*) AS tasks FROM v_tasks GROUP BY 1, 2")
def _(c):
    return c.view("v_tasks").groupBy("project_id", "source_status").agg(F.count(F.lit(1)).alias("tasks"))


@query("ev_verdicts", "SELECT project_id, validation_status, count(*) AS tasks FROM v_tasks GROUP BY 1, 2")
def _(c):
    return c.view("v_tasks").groupBy("project_id", "validation_status").agg(F.count(F.lit(1)).alias("tasks"))


def task_rates(c):
    return evaluate.task_rates(linking.link_requirements(c.view("v_tasks"), c.view("v_requirements")))


@query("ev_assignment", "SELECT project_id, CAST(count(*) FILTER (WHERE assignee_role <> '') AS DOUBLE) / count(*) AS assignment_rate FROM v_tasks GROUP BY 1")
def _(c):
    return task_rates(c).select("project_id", "assignment_rate")


@query("ev_requirement_link", "SELECT project_id, CAST(count(linked) AS DOUBLE) / count(*) AS requirement_link_rate FROM v_linked_tasks GROUP BY 1")
def _(c):
    return task_rates(c).select("project_id", "requirement_link_rate")


@query("ev_off_roster", """
SELECT DISTINCT t.project_id, t.team || '/' || t.assignee_role AS role FROM v_tasks t WHERE assignee_role <> '' AND NOT EXISTS (
  SELECT 1 FROM v_project_roles r WHERE r.project_id = t.project_id AND r.team = t.team AND lower(r.role_title) = lower(t.assignee_role))""")
def _(c):
    return evaluate.off_roster(c.view("v_tasks"), c.view("v_project_roles"))


@query("ev_disclosure", """
SELECT project_id, CAST(count(*) - count(*) FILTER (WHERE regexp_matches(expected_result, '[0-9]') AND assumed_fields = '' AND story_key NOT IN (SELECT story_key FROM v_all_stories WHERE source_key <> '')) AS DOUBLE) / count(*) AS assumption_disclosure
FROM v_case_rows GROUP BY 1""")
def _(c):
    return evaluate.disclosure(cases(c), all_stories(c))


@query("ev_explicit_stories", "SELECT project_id, story_key FROM v_client_stories WHERE source_status = 'explicit'")
def _(c):
    return client_stories(c).filter("source_status = 'explicit'").select("project_id", "story_key")


@query("ev_latest_run", """
SELECT 'SOW-' || c_nationkey AS doc_key, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS project_id FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def _(c):
    runs = c.table("orders").join(c.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("SOW-"), F.col("c_nationkey").cast("string")).alias("doc_key"), F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").alias("uploaded_at"))
    return evaluate.latest_runs(runs)


@query("ev_summary", """
SELECT (SELECT min(citation_validity) FROM v_rates) AS min_citation_validity, count(*) AS claims, CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) AS grounding FROM v_judged""")
def _(c):
    return evaluate.overall(rates(c), judged(c))
