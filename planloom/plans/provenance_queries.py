"""Citations, linking, gap audit and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.citations import normalize
from planloom.functions.text import percent
from planloom.operators import gaps, grounding, linking, provenance, segment
from planloom.plans.adapters import DUCK, fold_sql
from planloom.plans.registry import query

NORM = (
    "CASE WHEN regexp_extract({x}, '(?i)[A-Za-z0-9_.-]*SOW[A-Za-z0-9_.-]*-S[0-9]+-C[0-9]+') <> '' "
    "THEN regexp_extract({x}, '(?i)[A-Za-z0-9_.-]*SOW[A-Za-z0-9_.-]*-S[0-9]+-C[0-9]+') ELSE trim({x}) END"
)


def norm(x: str) -> str:
    return NORM.format(x=x)


DUCK["v_cited"] = f"SELECT project_id, task_id, pos, {norm('raw_key')} AS chunk_key FROM v_citations"
DUCK["v_valid"] = "SELECT * FROM v_cited WHERE (project_id, chunk_key) IN (SELECT (project_id, chunk_key) FROM v_chunks)"


def valid_citations(c):
    return provenance.valid(c.view("v_citations"), c.view("v_chunks"))


@query("cite_normalize", "SELECT task_id, pos, chunk_key FROM v_cited")
def _(c):
    return provenance.normalized(c.view("v_citations")).select("task_id", "pos", "chunk_key")


@query("cite_valid", "SELECT project_id, task_id, pos, chunk_key FROM v_valid")
def _(c):
    return valid_citations(c).select("project_id", "task_id", "pos", "chunk_key")


@query("cite_invented", f"""
SELECT DISTINCT project_id, chunk_key FROM (SELECT project_id, chunk_key FROM v_cited UNION ALL SELECT project_id, {norm('raw_key')} FROM v_requirements) u
WHERE NOT EXISTS (SELECT 1 FROM v_chunks k WHERE k.project_id = u.project_id AND k.chunk_key = u.chunk_key)""")
def _(c):
    both = c.view("v_citations").select("project_id", "raw_key").unionByName(c.view("v_requirements").select("project_id", "raw_key"))
    return provenance.invented(both, c.view("v_chunks"))


DUCK["v_first"] = """
SELECT f.project_id, f.task_id, f.chunk_key, k.section_index, k.section_title FROM (SELECT project_id, task_id, min_by(chunk_key, pos) AS chunk_key FROM v_valid GROUP BY 1, 2) f
JOIN v_chunks k USING (project_id, chunk_key)"""


@query("cite_first_section", "SELECT * FROM v_first")
def _(c):
    return provenance.first_section(valid_citations(c), c.view("v_chunks"), "task_id")


DUCK["v_demoted"] = f"""
SELECT d.*, k.chunk_key IS NULL AND d.source_status = 'explicit' AS demoted, coalesce(k.chunk_key, '') AS good_key
FROM v_deps d LEFT JOIN v_chunks k ON k.project_id = d.project_id AND k.chunk_key = {norm('d.raw_key')}"""


@query("cite_demote_explicit", """
SELECT project_id, task_id, slot, CASE WHEN demoted THEN 'inferred' ELSE source_status END AS source_status, demoted FROM v_demoted""")
def _(c):
    return provenance.demote_explicit(c.view("v_deps"), c.view("v_chunks")).select("project_id", "task_id", "slot", "source_status", "demoted")


@query("cite_demote_warnings", """
SELECT d.project_id, d.task_id, '''' || t.title || ''' waits on ''' || u.title || ''': called explicit with no citation the document contains, recorded as inferred' AS message
FROM v_demoted d JOIN v_tasks t ON t.task_id = d.task_id JOIN v_tasks u ON u.task_id = d.depends_on_id WHERE d.demoted""")
def _(c):
    return provenance.demotion_warnings(provenance.demote_explicit(c.view("v_deps"), c.view("v_chunks")), c.view("v_tasks"))


@query("cite_evidence_all", """
SELECT project_id, chunk_key, text, page, section_title FROM v_chunks k WHERE EXISTS (SELECT 1 FROM v_valid v WHERE v.project_id = k.project_id AND v.chunk_key = k.chunk_key)
 OR EXISTS (SELECT 1 FROM v_demoted d WHERE d.project_id = k.project_id AND d.good_key = k.chunk_key)""")
def _(c):
    chunks = c.view("v_chunks")
    return provenance.evidence_for_all(valid_citations(c), provenance.valid(c.view("v_deps"), chunks), chunks)


@query("cite_evidence_one", "SELECT project_id, chunk_key, text, page, section_title FROM v_chunks WHERE chunk_key = 'SOW-0000012-S01-C02'")
def _(c):
    return provenance.evidence_for_one(c.view("v_chunks"), "SOW-0000012-S01-C02")


@query("cite_task_evidence", """
SELECT project_id, task_id, chunk_key, min(priority) AS priority FROM (
  SELECT project_id, task_id, chunk_key, CAST(1 AS INT) AS priority FROM v_valid
  UNION ALL SELECT f.project_id, f.task_id, k.chunk_key, 2 FROM v_first f JOIN v_chunks k ON k.project_id = f.project_id AND k.section_index = f.section_index)
GROUP BY 1, 2, 3""")
def _(c):
    return provenance.task_evidence(c.view("v_tasks"), valid_citations(c), c.view("v_chunks"))


DUCK["v_rates"] = """
SELECT project_id, coalesce(sum(r) / sum(n), 0.0) AS citation_validity, CAST(count(n) AS DOUBLE) / count(*) AS evidence_coverage FROM (
  SELECT t.project_id, t.task_id, n, r FROM v_tasks t LEFT JOIN (
    SELECT c.project_id, task_id, count(*) AS n, count(k.chunk_key) AS r FROM v_cited c LEFT JOIN v_chunks k USING (project_id, chunk_key) GROUP BY 1, 2) x USING (task_id)) GROUP BY 1"""


def rates(c):
    return provenance.citation_rates(c.view("v_tasks"), c.view("v_citations"), c.view("v_chunks"))


@query("cite_validity", "SELECT project_id, citation_validity FROM v_rates")
def _(c):
    return rates(c).select("project_id", "citation_validity")


@query("cite_coverage", "SELECT project_id, evidence_coverage FROM v_rates")
def _(c):
    return rates(c).select("project_id", "evidence_coverage")


# Linking ---------------------------------------------------------------------------------


@query("link_requirement", """
SELECT t.project_id, t.task_id, r.requirement_id AS linked_requirement,
       CASE WHEN r.requirement_id IS NULL AND t.requirement_id <> '' THEN '''' || t.title || ''': cites unknown requirement ''' || t.requirement_id || ''', left unlinked' END AS message
FROM v_tasks t LEFT JOIN v_requirements r ON r.project_id = t.project_id AND r.requirement_id = t.requirement_id""")
def _(c):
    linked = linking.link_requirements(c.view("v_tasks"), c.view("v_requirements"))
    return linked.select("project_id", "task_id", "linked_requirement").join(
        linking.requirement_warnings(linked), ["project_id", "task_id"], "left")


@query("link_milestone", """
SELECT t.project_id, t.task_id, l.milestone_id, CASE WHEN l.milestone_id IS NULL AND t.milestone <> '' THEN '''' || t.title || ''' names milestone ''' || t.milestone || ''', which the SOW does not list' END AS message
FROM v_tasks t LEFT JOIN v_ms_links l USING (task_id)""")
def _(c):
    tasks, ms = c.view("v_tasks"), c.view("v_milestones")
    keys = ["project_id", "task_id"]
    return (
        tasks.select(*keys).join(linking.milestone_links(tasks, ms), keys, "left")
        .join(linking.milestone_warnings(tasks, ms), keys, "left")
    )


@query("link_milestone_empty", f"""
SELECT m.project_id, m.milestone_id, 'milestone ''' || m.name || ''' has no task attached, so its date cannot be compared with the schedule' AS message
FROM v_milestones m WHERE milestone_id IN (SELECT max_by(milestone_id, pos) FROM v_milestones GROUP BY project_id, {fold_sql('name')}) AND milestone_id NOT IN (SELECT milestone_id FROM v_ms_links)""")
def _(c):
    ms = c.view("v_milestones")
    return linking.milestones_without_task(ms, linking.milestone_links(c.view("v_tasks"), ms))


DUCK["v_linked"] = """
SELECT project_id, task_id, depends_on_id, min_by(slot, edge_ord) AS slot, trim(min_by(rationale, edge_ord)) AS rationale, min_by(source_status, edge_ord) AS source_status
FROM v_deps WHERE task_id <> depends_on_id AND depends_on_id IN (SELECT task_id FROM v_tasks) GROUP BY 1, 2, 3"""


@query("link_dependencies", "SELECT project_id, task_id, depends_on_id, slot, rationale FROM v_linked")
def _(c):
    return linking.link_dependencies(c.view("v_deps"), c.view("v_tasks")).select(
        "project_id", "task_id", "depends_on_id", "slot", linking.clean_rationale(F.col("rationale")).alias("rationale"))


_cats = " ".join(f"WHEN category = '{category}' THEN '{team}'" for category, team in vocab.CATEGORY_TEAMS.items())
DUCK["v_teamed"] = f"SELECT *, CASE {_cats} END AS team FROM v_details"


@query("detail_team", "SELECT project_id, ord, category, name, team FROM v_teamed")
def _(c):
    return linking.detail_team(c.view("v_details"), vocab.detail_categories(c.spark)).select("project_id", "ord", "category", "name", "team")


@query("empty_extraction", """
SELECT d.project_id, count(*) AS chunk_count, 'tasks' AS missing FROM v_docs d JOIN v_doc_chunks k USING (doc_key)
WHERE d.project_id IN (SELECT project_id FROM v_requirements) AND d.project_id NOT IN (SELECT project_id FROM v_tasks) GROUP BY 1
UNION ALL SELECT d.project_id, count(*), 'requirements, tasks' FROM v_docs d JOIN v_doc_chunks k USING (doc_key)
WHERE d.project_id NOT IN (SELECT project_id FROM v_requirements) AND d.project_id NOT IN (SELECT project_id FROM v_tasks) GROUP BY 1""")
def _(c):
    chunks = segment.chunk_rows(segment.segment(c.view("v_docs").select("project_id", "doc_key", "text")))
    docs = chunks.groupBy("project_id", "doc_key").agg(F.count(F.lit(1)).alias("chunk_count"))
    return linking.empty_extractions(docs, c.view("v_tasks"), c.view("v_requirements")).select("project_id", "chunk_count", "missing")


@query("estimate_source", "SELECT task_id, CASE WHEN coalesce(estimated_hours <> 0, false) THEN 'estimated' ELSE 'assumed' END AS estimate_source FROM v_tasks")
def _(c):
    return c.view("v_tasks").select("task_id", linking.estimate_source(F.col("estimated_hours")).alias("estimate_source"))


@query("project_info", """
SELECT project_id, CASE WHEN name <> '' THEN name ELSE 'Upload ' || project_id END AS name, merchant_name, start_date, coalesce(go_live_date, end_date) AS go_live_date FROM v_projects""")
def _(c):
    answers = c.view("v_projects").withColumnRenamed("name", "project_name")
    rows = answers.select("project_id", F.concat(F.lit("Upload "), F.col("project_id").cast("string")).alias("name"))
    return linking.project_info(rows, answers)


# Gap audit -------------------------------------------------------------------------------

_rows = ", ".join("(" + ", ".join([str(i), *("'" + v.replace("'", "''") + "'" for v in row)]) + ")" for i, row in enumerate(vocab.CHECKLIST, 1))
DUCK["v_checklist"] = f"SELECT CAST(o AS INT) AS field_ord, k AS field_key, c AS category, q AS question, t AS team, d AS default_value, s AS scope FROM (VALUES {_rows}) x(o, k, c, q, t, d, s)"
_defer = " OR ".join(f"contains(v, '{m}')" for m in vocab.DEFERRING_MARKERS)
_hedge = " OR ".join(f"contains(v, '{m}')" for m in vocab.HEDGE_WORDS)
DUCK["v_gap_judged"] = f"""
SELECT *, CASE WHEN uncited OR vague THEN 'assumed' ELSE status END AS new_status, CASE WHEN uncited OR vague THEN '' ELSE value END AS new_value,
       CASE WHEN vague AND hint = '' THEN value ELSE hint END AS new_hint
FROM (SELECT *, claims AND NOT known AS uncited, claims AND known AND (v = '' OR {_defer} OR (({_hedge}) AND NOT regexp_matches(v, '[0-9]'))) AS vague FROM (
  SELECT f.*, status IN ('explicit', 'inferred') AS claims, lower(trim(value)) AS v, k.chunk_key IS NOT NULL AS known, coalesce(k.chunk_key, '') AS evidence_key
  FROM v_findings f LEFT JOIN v_gap_keys k ON k.project_id = f.project_id AND k.chunk_key = {norm('f.raw_key')}
  WHERE field_key IN (SELECT field_key FROM v_checklist)))"""
DUCK["v_fields"] = """
SELECT p.project_id, c.*, l.field_key IS NOT NULL AS reported, coalesce(l.new_status, 'assumed') AS status, coalesce(l.new_value, '') AS value,
       coalesce(l.new_hint, '') AS hint, coalesce(l.note, 'The audit did not report on this field.') AS note, coalesce(l.evidence_key, '') AS evidence_key
FROM v_gap_projects p CROSS JOIN v_checklist c LEFT JOIN (
  SELECT * FROM v_gap_judged QUALIFY row_number() OVER (PARTITION BY project_id, field_key ORDER BY pos DESC) = 1) l
ON l.project_id = p.project_id AND l.field_key = c.field_key"""
DUCK["v_open"] = """
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY field_ord) AS n, trim(hint) AS h, CASE WHEN trim(hint) <> '' THEN trim(hint) ELSE default_value END AS working
FROM v_fields WHERE status = 'assumed'"""
DUCK["v_assumptions"] = """
SELECT project_id, printf('A-%03d', n) AS assumption_key, category, working AS value,
       CASE WHEN trim(note) <> '' THEN trim(note) ELSE 'The SOW does not specify the ' || replace(field_key, '_', ' ') || '.' END
         || CASE WHEN h <> '' THEN ' Using the direction the SOW indicates rather than a default.' ELSE '' END AS reason,
       round(CAST(CASE category WHEN 'SCHEDULE' THEN 0.6 WHEN 'TEAM_SIZE' THEN 0.5 WHEN 'PERFORMANCE' THEN 0.5 WHEN 'SLA_TARGETS' THEN 0.5 ELSE 0.7 END AS DOUBLE) + CASE WHEN h <> '' THEN 0.1 ELSE 0 END, 6) AS confidence
FROM v_open"""
DUCK["v_questions"] = """
SELECT project_id, printf('Q-%03d', n) AS question_key, scope, category, field_key, team, question AS text, working AS working_assumption FROM v_open"""


def gap_fields(c):
    return gaps.validated(c.view("v_findings"), c.view("v_gap_keys"), c.view("v_gap_projects"), vocab.checklist(c.spark))


@query("gap_fields", "SELECT p.project_id, c.* FROM v_gap_projects p CROSS JOIN v_checklist c")
def _(c):
    return gaps.spine(c.view("v_gap_projects"), vocab.checklist(c.spark))


@query("gap_non_committal", f"""
SELECT project_id, pos, v = '' OR {_defer} OR (({_hedge}) AND NOT regexp_matches(v, '[0-9]')) AS non_committal FROM (SELECT *, lower(trim(value)) AS v FROM v_findings)""")
def _(c):
    return c.view("v_findings").select("project_id", "pos", gaps.non_committal(F.col("value")).alias("non_committal"))


@query("gap_validate", "SELECT project_id, field_key, reported, status, value, hint, note, evidence_key FROM v_fields")
def _(c):
    return gap_fields(c).select("project_id", "field_key", "reported", "status", "value", "hint", "note", "evidence_key")


@query("gap_warnings", """
SELECT project_id, field_key, 'gap audit returned unknown field ''' || field_key || '''' AS message FROM v_findings WHERE field_key NOT IN (SELECT field_key FROM v_checklist)
UNION ALL SELECT project_id, field_key, CASE WHEN uncited THEN field_key || ': claimed ' || status || ' with no usable citation, downgraded to assumed'
  ELSE field_key || ': value ''' || value || ''' does not settle the field, downgraded to assumed' END FROM v_gap_judged WHERE uncited OR vague
UNION ALL SELECT project_id, field_key, field_key || ': not reported by the gap audit, treated as a gap' FROM v_fields WHERE NOT reported""")
def _(c):
    return gaps.warnings(c.view("v_findings"), c.view("v_gap_keys"), c.view("v_gap_projects"), vocab.checklist(c.spark))


@query("gap_assumptions", "SELECT * FROM v_assumptions")
def _(c):
    return gaps.assumptions(gap_fields(c))


@query("gap_questions", "SELECT * FROM v_questions")
def _(c):
    return gaps.questions(gap_fields(c))


@query("gap_grounded_fields", "SELECT project_id, field_key, status, value FROM v_fields WHERE status IN ('explicit', 'inferred') AND value <> ''")
def _(c):
    return gaps.grounded(gap_fields(c)).select("project_id", "field_key", "status", "value")


DUCK["v_gap_coverage"] = """
SELECT p.project_id, CAST(39 AS INT) AS checked, 39 - coalesce(o, 0) AS answered, coalesce(o, 0) AS open, coalesce(o, 0) = coalesce(a, 0) AS reliable FROM v_gap_projects p
LEFT JOIN (SELECT project_id, count(DISTINCT field_key) AS o FROM v_questions GROUP BY 1) q USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS a FROM v_assumptions GROUP BY 1) a USING (project_id)"""


@query("gap_coverage", "SELECT * FROM v_gap_coverage")
def _(c):
    fields = gap_fields(c)
    return gaps.coverage(c.view("v_gap_projects"), gaps.questions(fields), gaps.assumptions(fields))


@query("gap_working_values", """
SELECT project_id, field_ord, field_key, '- ' || field_key || ': ' || CASE WHEN status <> 'assumed' AND value <> '' THEN value || ' (stated in the SOW)'
  ELSE CASE WHEN hint <> '' THEN hint ELSE default_value END || ' (assumed, not in the SOW)' END AS line FROM v_fields""")
def _(c):
    return gaps.working_values(gap_fields(c))


@query("gap_by_scope", """
SELECT p.project_id, s.scope, coalesce(n, 0) AS questions, coalesce(ks, '') AS question_keys FROM v_gap_projects p CROSS JOIN (VALUES ('merchant'), ('offer'), ('project')) s(scope)
LEFT JOIN (SELECT project_id, scope, count(*) AS n, string_agg(question_key, ',' ORDER BY question_key) AS ks FROM v_questions GROUP BY 1, 2) q ON q.project_id = p.project_id AND q.scope = s.scope""")
def _(c):
    return gaps.by_scope(c.view("v_gap_projects"), gaps.questions(gap_fields(c)))


@query("view_assumptions", "SELECT * FROM v_assumptions")
def _(c):
    return gaps.assumptions(gap_fields(c)).select("project_id", "assumption_key", "category", "value", "reason", "confidence")


# Grounding -------------------------------------------------------------------------------


@query("gr_namespace", """
SELECT c.project_id, c.task_id, 'T' || n || '-' || claim_id AS claim_key FROM v_claims c
JOIN (SELECT task_id, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS n FROM v_tasks) t USING (task_id)""")
def _(c):
    return grounding.namespaced(c.view("v_claims"), c.view("v_tasks")).select("project_id", "task_id", "claim_key")


@query("gr_index", """
SELECT l_orderkey AS project_id, chunk_key, max_by(l_partkey, (l_suppkey, l_partkey)) AS part_id FROM (SELECT *, l_orderkey || '/' || l_linenumber AS chunk_key FROM lineitem) GROUP BY 1, 2""")
def _(c):
    rows = c.table("lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_key"),
        F.col("l_partkey").alias("part_id"), F.struct("l_suppkey", "l_partkey").alias("version"))
    return grounding.latest_chunks(rows, "version").select("project_id", "chunk_key", "part_id")


def retrieved(c, k):
    vectors = c.view("v_embeddings")
    queries = vectors.select("project_id", F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = vectors.select("project_id", F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return grounding.nearest(queries, corpus, k)


@query("gr_retrieve_topk", """
SELECT project_id, query_id, chunk_id, distance, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, query_id ORDER BY distance, chunk_id) AS rank FROM (
    SELECT a.project_id, a.vec_id AS query_id, b.vec_id AS chunk_id,
           round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS distance
    FROM v_embeddings a JOIN v_embeddings b ON a.project_id = b.project_id)) WHERE rank <= 3""")
def _(c):
    return retrieved(c, 3).withColumn("distance", F.col("distance") + 0.0)


DUCK["v_retrieved"] = """
SELECT project_id, query_id, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, query_id ORDER BY distance, chunk_id) AS rank FROM (
    SELECT a.project_id, a.vec_id AS query_id, b.vec_id AS chunk_id,
           round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS distance
    FROM v_embeddings a JOIN v_embeddings b ON a.project_id = b.project_id)) WHERE rank <= 6"""


@query("gr_evidence_union", """
SELECT project_id, task_id, chunk_key, min(priority) AS priority FROM (
  SELECT project_id, vec_id AS task_id, CAST(vec_id AS STRING) AS chunk_key, CAST(1 AS INT) AS priority FROM v_embeddings
  UNION ALL SELECT project_id, query_id, CAST(chunk_id AS STRING), 2 FROM v_retrieved) GROUP BY 1, 2, 3""")
def _(c):
    # Every vector is a claim that cites its own chunk; the retriever adds the nearest ones of its project.
    cited = c.view("v_embeddings").select("project_id", F.col("vec_id").alias("task_id"), F.col("vec_id").cast("string").alias("chunk_key"))
    hits = retrieved(c, 6).select("project_id", F.col("query_id").alias("task_id"), F.col("chunk_id").cast("string").alias("chunk_key"))
    return grounding.evidence_union(cited, hits)


DUCK["v_judged"] = f"""
SELECT c.*, CASE WHEN j.verdict IS NULL OR (j.verdict = 'supported' AND k.chunk_key IS NULL) THEN 'unsupported' ELSE j.verdict END AS verdict,
       CASE WHEN j.verdict IS NULL THEN 'The verifier did not return a judgement for this claim.'
            WHEN j.verdict = 'supported' AND k.chunk_key IS NULL THEN 'Marked supported but cited no evidence that exists in the SOW. ' || j.reasoning ELSE j.reasoning END AS reasoning,
       coalesce(k.chunk_key, '') AS supporting_key
FROM v_claims c LEFT JOIN (SELECT * FROM v_judgements QUALIFY row_number() OVER (PARTITION BY project_id, task_id, claim_id ORDER BY pos DESC) = 1) j USING (project_id, task_id, claim_id)
LEFT JOIN v_chunks k ON k.project_id = c.project_id AND k.chunk_key = {norm('j.raw_key')}"""
DUCK["v_scores"] = """
SELECT t.project_id, t.task_id, coalesce(n, 0) AS claims, coalesce(CAST(s AS DOUBLE) / n, 1.0) AS score,
       CASE WHEN coalesce(x, false) THEN 'reject' WHEN coalesce(CAST(s AS DOUBLE) / n, 1.0) >= 0.9 THEN 'accept' WHEN coalesce(CAST(s AS DOUBLE) / n, 1.0) >= 0.7 THEN 'review' ELSE 'reject' END AS status
FROM v_tasks t LEFT JOIN (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'supported') AS s, bool_or(verdict = 'contradicted') AS x FROM v_judged GROUP BY 1) g USING (task_id)"""


def judged(c):
    return grounding.verdicts(c.view("v_claims"), c.view("v_judgements"), c.view("v_chunks"))


@query("gr_verdicts", "SELECT task_id, claim_id, verdict, reasoning FROM v_judged")
def _(c):
    return judged(c).select("task_id", "claim_id", "verdict", "reasoning")


@query("gr_supported_needs_evidence", "SELECT task_id, claim_id, supporting_key FROM v_judged WHERE verdict = 'supported'")
def _(c):
    return judged(c).filter(F.col("verdict") == "supported").select("task_id", "claim_id", "supporting_key")


@query("gr_task_score", "SELECT project_id, task_id, claims, score FROM v_scores")
def _(c):
    return grounding.task_scores(c.view("v_tasks"), judged(c)).select("project_id", "task_id", "claims", "score")


@query("gr_task_status", "SELECT task_id, status FROM v_scores")
def _(c):
    return grounding.task_scores(c.view("v_tasks"), judged(c)).select("task_id", "status")


@query("gr_project_score", """
SELECT p.project_id, coalesce(s, 1.0) AS score FROM v_projects p LEFT JOIN (SELECT project_id, CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) AS s FROM v_judged GROUP BY 1) j USING (project_id)""")
def _(c):
    return grounding.project_scores(c.view("v_projects"), judged(c))


@query("gr_by_team", """
SELECT j.project_id, coalesce(t.team, 'unknown') AS team, CAST(count(*) FILTER (WHERE verdict = 'supported') AS DOUBLE) / count(*) AS score, count(*) AS claims
FROM v_judged j LEFT JOIN v_kept_tasks t USING (task_id) GROUP BY 1, 2""")
def _(c):
    # Claims of tasks deleted after grading belong to no team.
    return grounding.by_team(judged(c), c.view("v_kept_tasks"))


@query("gr_status_counts", """
SELECT project_id, count(*) FILTER (WHERE status = 'accept') AS accept, count(*) FILTER (WHERE status = 'review') AS review, count(*) FILTER (WHERE status = 'reject') AS reject FROM v_scores GROUP BY 1""")
def _(c):
    scored = grounding.task_scores(c.view("v_tasks"), judged(c))
    return scored.groupBy("project_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accept", "review", "reject")])


@query("gr_failures", """
SELECT j.project_id, j.task_id, claim_id, text, verdict, is_quantitative, title AS task, team FROM v_judged j JOIN v_tasks t USING (task_id) WHERE verdict <> 'supported'""")
def _(c):
    return grounding.failures(judged(c), c.view("v_tasks"))


@query("gr_render_evidence", """
SELECT project_id, chunk_key, '[' || chunk_key || '] (' || section_title || CASE WHEN page IS NOT NULL THEN ', page ' || page ELSE '' END || ')' || chr(10) || text AS line FROM v_chunks""")
def _(c):
    return c.view("v_chunks").select("project_id", "chunk_key", grounding.evidence_line().alias("line"))


@query("gr_persist_rollup", "SELECT t.task_id, s.score AS grounding_score, s.status AS validation_status FROM v_tasks t JOIN v_scores s USING (task_id)")
def _(c):
    tasks = c.view("v_tasks")
    return grounding.rollup(tasks, grounding.task_scores(tasks, judged(c))).select("task_id", "grounding_score", "validation_status")
