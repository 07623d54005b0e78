"""Plan-domain views over the given tables.

The domain (documents, plans, boards) has no tables of its own in the test data, so each
view re-reads a given table in those terms: an order is a project, its line numbers are
tasks, suppliers are people, conversation turns are model requests. Every view covers its
whole table and grows with it. ADAPTERS hold SQL that Spark and DuckDB read alike; where
the dialects differ, SPARK_ONLY and DUCK hold the same view for each engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}


def _doc_key(project: str) -> str:
    return f"'SOW-' || lpad(CAST({project} + 1 AS STRING), 7, '0')"


def _key(project: str, line: str) -> str:
    """Chunk key of a line of a project: two chunks to a section."""
    return (
        f"{_doc_key(project)} || '-S' || lpad(CAST(CAST(floor(({line} + 1) / 2) AS INT) AS STRING), 2, '0')"
        f" || '-C' || lpad(CAST({line} AS STRING), 2, '0')"
    )


def _pick(expr: str, values: list[str]) -> str:
    """CASE over the remainder of an integer expression."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {whens} END)"


TITLES = [
    "Sign the merchant contract", "Build the accrual API endpoint", "Deliver on-ground staff training",
    "Test the API after contract sign-off", "Translate the offer catalogue", "Prepare pricing annex",
    "Go-live rollout support", "Design reporting capital plan",
]
ROLE_WORDS = [
    "backend developer", "ML Engineer", "QA", "ops manager", "trainer", "lawyer", "Software Engineer",
    "Operations Manager", "", "Account Manager", "Integration Architect",
]


def fold_sql(text: str) -> str:
    """Case folding for the SQL side; no other letter of these views folds to more than one."""
    return f"replace(lower({text}), 'ß', 'ss')"


DETAIL_WORDS = [
    "merchant", "offer", "contract", "pricing_term", "sla", "legal_requirement", "approval",
    "commercial_milestone", "api", "integration", "authentication", "data_requirement",
    "security_requirement", "performance_requirement", "infrastructure_requirement",
    "system_operation", "system_configuration", "onboarding_step", "training_topic",
    "merchant_trade", "go_live_support", "post_go_live_support",
]
VALUES = [
    "TBD", "to be confirmed", "standard scheme", "probably API keys", "", "2.5% (standard model)",
    "10 points per 1 USD, to be confirmed", "12 offers", "3 branches in Cairo", "approximately 50 per second",
    "OAuth 2.0",
]
FIELD_KEYS = [
    "merchant_count", "offer_count", "pricing_terms", "sla_targets", "earn_rate", "points_expiry",
    "auth_mechanism", "location_count", "training_duration", "team_size", "go_live_date",
    "project_start_date", "security_requirements", "no_such_field", "performance_targets",
]
ACTORS = [
    "support agent", "shopper", "bank compliance officer", "merchant operations manager", "data analyst",
    "backend developer",
]
ROSTER_TITLES = [
    "Commercial Manager", "Account Manager", "Business Development Manager", "Legal Advisor",
    "Technical Lead", "Backend Engineer", "Frontend Engineer", "AI Engineer", "QA Engineer",
    "DevOps Engineer", "Operations Manager", "Operations Specialist", "Merchant Success Specialist",
    "Support Agent", "Deployment Specialist",
]

ADAPTERS: dict[str, str] = {}

ADAPTERS["v_projects"] = """
SELECT o_orderkey AS project_id,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Project ' || CAST(o_orderkey AS STRING) END AS name,
       CASE o_orderstatus WHEN 'P' THEN 'awaiting_approval' WHEN 'F' THEN 'approved'
            ELSE 'partially_synced' END AS status,
       CASE o_custkey % 3 WHEN 0 THEN 'NorthBank S.A.E.' WHEN 1 THEN 'Customer ' || CAST(o_custkey AS STRING)
            ELSE '' END AS merchant_name,
       CAST(o_orderdate AS DATE) AS start_date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            ELSE CAST(o_orderdate AS DATE) + CAST(4 + o_orderkey % 40 AS INT) END AS go_live_date,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + CAST(60 AS INT) END AS end_date,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'B-' || CAST(o_orderkey AS STRING) END AS board_id,
       CAST(o_orderdate AS DATE) AS created_on
FROM orders"""

ADAPTERS["v_tasks"] = f"""
SELECT l_orderkey AS project_id, l_orderkey * 10 + l_linenumber AS task_id,
       CAST(l_linenumber AS INT) AS ord,
       CASE WHEN pk % 101 = 0 THEN '  ' ELSE {_pick('pk', TITLES)} || ' ' || CAST(l_linenumber AS STRING) END AS title,
       CASE WHEN sk % 6 = 0 THEN '' WHEN sk % 6 = 1 THEN 'Needs 20 offers within 2 days'
            ELSE 'Work package ' || CAST(pk AS STRING) END AS description,
       CASE WHEN pk % 53 = 0 THEN 'marketing' ELSE {_pick('sk', ['commercial', 'technical', 'operations'])} END AS team,
       CASE WHEN pk % 17 = 0 THEN 'Supplier#' || lpad(CAST(sk AS STRING), 9, '0') ELSE '' END AS assignee,
       {_pick('pk', ROLE_WORDS)} AS raw_role,
       {_pick('sk + pk', ROSTER_TITLES)} AS assignee_role,
       CASE WHEN pk % 6 = 0 THEN '' ELSE 'R-' || CAST(l_linenumber % 5 AS STRING) END AS requirement_id,
       CASE pk % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'INTEGRATION' WHEN 2 THEN 'Launch'
            WHEN 3 THEN CASE WHEN pk % 2 = 1 THEN 'ABSCHLUSS' ELSE 'Handover' END ELSE '' END AS milestone,
       CASE WHEN pk % 11 = 0 THEN NULL WHEN pk % 13 = 0 THEN 0.0 ELSE qty END AS estimated_hours,
       CASE rf WHEN 'A' THEN 'explicit' WHEN 'N' THEN 'inferred' ELSE 'assumed' END AS source_status,
       CASE sk % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' WHEN 2 THEN 'reject' ELSE 'pending' END AS validation_status,
       CASE WHEN sk % 4 = 3 THEN NULL ELSE CAST(pk % 101 AS DOUBLE) / 100 END AS grounding_score,
       CASE pk % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'edited' WHEN 2 THEN 'rejected' ELSE 'approved' END AS review_status,
       CASE WHEN pk % 4 = 0 THEN 'see note' ELSE '' END AS review_note,
       CAST(pk % 5 AS INT) AS regeneration_count,
       CASE WHEN pk % 3 = 0 OR os = 'P' THEN '' ELSE 'CARD-' || CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS external_ref,
       sk % 4 = 0 AS board_dirty,
       CAST(sd AS DATE) AS start_date,
       CASE WHEN pk % 23 = 0 THEN NULL ELSE CAST(sd AS DATE) + CAST(qty AS INT) END AS due_date,
       pk AS part_id, sk AS supplier_id
FROM (SELECT l_orderkey, l_linenumber, SUM(l_quantity) AS qty, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk,
             MIN(l_returnflag) AS rf, MIN(l_shipdate) AS sd, MIN(o_orderstatus) AS os
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber) g"""

# What is left of the tasks after some were deleted.
ADAPTERS["v_kept_tasks"] = "SELECT * FROM v_tasks WHERE part_id % 43 <> 0"

ADAPTERS["v_deps"] = f"""
SELECT project_id, task_id, slot, depends_on_id, ord * 10 + slot AS edge_ord,
       CASE WHEN slot = 1 AND supplier_id % 2 = 0 THEN 'explicit' WHEN slot = 2 THEN 'assumed'
            WHEN slot = 3 THEN '' ELSE 'inferred' END AS source_status,
       CASE WHEN part_id % 3 = 0 THEN {_key('project_id', 'ord')} WHEN part_id % 3 = 1 THEN 'section 4.2' ELSE '' END AS raw_key,
       '  because ' || CAST(part_id AS STRING) || ' ' AS rationale
FROM (
  SELECT project_id, task_id, ord, part_id, supplier_id, 1 AS slot, task_id - 1 AS depends_on_id FROM v_tasks WHERE ord > 1
  UNION ALL
  SELECT project_id, task_id, ord, part_id, supplier_id, 2 AS slot, task_id - 3 AS depends_on_id FROM v_tasks WHERE ord > 3
  UNION ALL
  SELECT project_id, task_id, ord, part_id, supplier_id, 3 AS slot, task_id - 1 AS depends_on_id FROM v_tasks WHERE ord > 1 AND project_id % 83 = 0
  UNION ALL
  SELECT project_id, task_id, ord, part_id, supplier_id, 4 AS slot, task_id AS depends_on_id FROM v_tasks WHERE task_id % 89 = 0
  UNION ALL
  SELECT project_id, task_id, ord, part_id, supplier_id, 5 AS slot, task_id + 1 AS depends_on_id FROM v_tasks
  WHERE project_id % 97 = 0 AND (ord % 2 = 1 OR project_id % 2 = 0)
) e"""

DUCK: dict[str, str] = {"v_deps": ADAPTERS["v_deps"]}
# The same rows in one pass over the tasks.
ADAPTERS["v_deps"] = ADAPTERS["v_deps"][: ADAPTERS["v_deps"].index("FROM (")] + """
FROM (
  SELECT project_id, task_id, ord, part_id, supplier_id, slot,
         CASE slot WHEN 2 THEN task_id - 3 WHEN 4 THEN task_id WHEN 5 THEN task_id + 1 ELSE task_id - 1 END AS depends_on_id
  FROM v_tasks LATERAL VIEW explode(filter(array(
    CASE WHEN ord > 1 THEN 1 END, CASE WHEN ord > 3 THEN 2 END, CASE WHEN ord > 1 AND project_id % 83 = 0 THEN 3 END,
    CASE WHEN task_id % 89 = 0 THEN 4 END, CASE WHEN project_id % 97 = 0 AND (ord % 2 = 1 OR project_id % 2 = 0) THEN 5 END),
    x -> x IS NOT NULL)) slots AS slot
) e"""

ADAPTERS["v_chunks"] = f"""
SELECT l_orderkey AS project_id, {_doc_key('l_orderkey')} AS doc_key,
       CAST(floor((l_linenumber + 1) / 2) AS INT) AS section_index,
       'Section ' || CAST(CAST(floor((l_linenumber + 1) / 2) AS INT) AS STRING) AS section_title,
       CAST(l_linenumber AS INT) AS chunk_index, {_key('l_orderkey', 'l_linenumber')} AS chunk_key,
       CASE WHEN pk % 29 = 0 THEN ' ' ELSE 'Part ' || CAST(pk AS STRING) || ' supplied by ' || CAST(sk AS STRING) END AS text,
       CASE WHEN sk % 5 = 0 THEN NULL ELSE CAST(1 + l_linenumber % 3 AS INT) END AS page,
       pk % 31 = 0 AS is_table
FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber) g
WHERE sk % 9 <> 0"""

ADAPTERS["v_citations"] = f"""
SELECT project_id, task_id, 1 AS pos, '[' || {_key('project_id', 'ord')} || ']' AS raw_key FROM v_tasks
UNION ALL
SELECT project_id, task_id, 2 AS pos, '  ' || {_key('project_id', '(ord + 1)')} || ' p' || CAST(ord AS STRING) AS raw_key FROM v_tasks WHERE part_id % 2 = 0
UNION ALL
SELECT project_id, task_id, 3 AS pos, ' section 4.2' AS raw_key FROM v_tasks WHERE part_id % 5 = 0
UNION ALL
SELECT project_id, task_id, 4 AS pos, {_key('project_id', 'ord')} AS raw_key FROM v_tasks WHERE part_id % 4 = 0"""

DUCK["v_citations"] = ADAPTERS["v_citations"]
ADAPTERS["v_citations"] = f"""
SELECT project_id, task_id, pos,
       CASE pos WHEN 1 THEN '[' || {_key('project_id', 'ord')} || ']' WHEN 2 THEN '  ' || {_key('project_id', '(ord + 1)')} || ' p' || CAST(ord AS STRING)
                WHEN 3 THEN ' section 4.2' ELSE {_key('project_id', 'ord')} END AS raw_key
FROM v_tasks LATERAL VIEW explode(filter(array(1, CASE WHEN part_id % 2 = 0 THEN 2 END, CASE WHEN part_id % 5 = 0 THEN 3 END,
    CASE WHEN part_id % 4 = 0 THEN 4 END), x -> x IS NOT NULL)) places AS pos"""

ADAPTERS["v_requirements"] = f"""
SELECT o_orderkey AS project_id, 'R-' || CAST(k AS STRING) AS requirement_id,
       {_pick('o_custkey + k', ['commercial', 'technical', 'operations'])} AS team,
       {_pick('o_orderkey + k', ['Signed contract', 'API integration', 'Staff training', 'Go-live launch', 'Test offers'])} AS title,
       CASE (o_orderkey + k) % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'assumed' END AS source_status,
       CASE WHEN (o_custkey + k) % 4 = 0 THEN 'SOW-none-S99-C01' ELSE '(' || {_key('o_orderkey', 'k')} || ')' END AS raw_key,
       k AS ord
FROM (SELECT o_orderkey, o_custkey, 1 AS k FROM orders UNION ALL SELECT o_orderkey, o_custkey, 2 AS k FROM orders
      UNION ALL SELECT o_orderkey, o_custkey, 3 AS k FROM orders) r"""

ADAPTERS["v_milestones"] = """
SELECT project_id, milestone_id, name, pos,
       CASE WHEN project_id % 13 = 0 AND pos = 2 THEN NULL ELSE start_date + CAST(gap AS INT) END AS target_date
FROM (
  SELECT project_id, project_id * 10 + 1 AS milestone_id, 'Contract' AS name, 1 AS pos, start_date, 3 + project_id % 5 AS gap FROM v_projects
  UNION ALL
  SELECT project_id, project_id * 10 + 2 AS milestone_id, 'Integration' AS name, 2 AS pos, start_date, 12 + project_id % 17 AS gap FROM v_projects
  UNION ALL
  SELECT project_id, project_id * 10 + 3 AS milestone_id, 'Launch' AS name, 3 AS pos, start_date, 26 + project_id % 11 AS gap FROM v_projects
  UNION ALL
  SELECT project_id, project_id * 10 + 4 AS milestone_id, 'LAUNCH' AS name, 4 AS pos, start_date, 40 + project_id % 3 AS gap FROM v_projects WHERE project_id % 6 = 0
  UNION ALL
  SELECT project_id, project_id * 10 + 5 AS milestone_id, 'Abschluß' AS name, 5 AS pos, start_date, 50 + project_id % 7 AS gap FROM v_projects WHERE project_id % 4 = 1
) m"""

DUCK["v_requirements"] = ADAPTERS["v_requirements"]
ADAPTERS["v_requirements"] = ADAPTERS["v_requirements"][: ADAPTERS["v_requirements"].index("FROM (")] + """
FROM (SELECT o_orderkey, o_custkey, k FROM orders LATERAL VIEW explode(array(1, 2, 3)) ks AS k) r"""
DUCK["v_milestones"] = ADAPTERS["v_milestones"]
ADAPTERS["v_milestones"] = ADAPTERS["v_milestones"][: ADAPTERS["v_milestones"].index("FROM (")] + """
FROM (
  SELECT project_id, project_id * 10 + pos AS milestone_id, pos, start_date,
         CASE pos WHEN 1 THEN 'Contract' WHEN 2 THEN 'Integration' WHEN 3 THEN 'Launch' WHEN 4 THEN 'LAUNCH' ELSE 'Abschluß' END AS name,
         CASE pos WHEN 1 THEN 3 + project_id % 5 WHEN 2 THEN 12 + project_id % 17 WHEN 3 THEN 26 + project_id % 11
                  WHEN 4 THEN 40 + project_id % 3 ELSE 50 + project_id % 7 END AS gap
  FROM v_projects LATERAL VIEW explode(filter(array(1, 2, 3, CASE WHEN project_id % 6 = 0 THEN 4 END, CASE WHEN project_id % 4 = 1 THEN 5 END),
    x -> x IS NOT NULL)) places AS pos
) m"""

ADAPTERS["v_details"] = f"""
SELECT project_id, ord, {_pick('part_id', DETAIL_WORDS)} AS category,
       CASE WHEN part_id % 7 = 6 THEN 'Maßnahme' ELSE 'Item ' || CAST(part_id % 7 AS STRING) END AS name, 'about part ' || CAST(part_id AS STRING) AS description,
       source_status, {_key('project_id', 'ord')} AS raw_key
FROM v_tasks"""

ADAPTERS["v_gap_projects"] = """
SELECT c_custkey AS project_id, 'Account ' || CAST(c_custkey AS STRING) AS name FROM customer"""

ADAPTERS["v_findings"] = f"""
SELECT o_custkey AS project_id, o_orderkey AS pos, {_pick('o_orderkey', FIELD_KEYS)} AS field_key,
       CASE o_orderstatus WHEN 'F' THEN 'explicit' WHEN 'O' THEN 'inferred' ELSE 'assumed' END AS status,
       {_pick('CAST(floor(o_totalprice) AS BIGINT)', VALUES)} AS value,
       CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 5 = 0 THEN 'section 4.2'
            ELSE '[' || {_key('o_custkey', '(1 + o_orderkey % 2)')} || ']' END AS raw_key,
       CASE WHEN o_orderkey % 2 = 0 THEN ' seen in annex ' ELSE '' END AS note,
       CASE WHEN o_orderkey % 6 = 0 THEN 'API keys' ELSE '' END AS hint
FROM orders"""

ADAPTERS["v_gap_keys"] = f"""
SELECT c_custkey AS project_id, {_key('c_custkey', '1')} AS chunk_key FROM customer
UNION ALL
SELECT c_custkey AS project_id, {_key('c_custkey', '2')} AS chunk_key FROM customer WHERE c_nationkey % 3 <> 0"""

ADAPTERS["v_claims"] = """
SELECT DISTINCT l_orderkey AS project_id, l_orderkey * 10 + l_linenumber AS task_id,
       'C' || CAST(l_partkey AS STRING) AS claim_id, 'Part ' || CAST(l_partkey AS STRING) || ' is required' AS text,
       l_partkey % 2 = 0 AS is_quantitative, l_partkey AS part_id
FROM lineitem"""

ADAPTERS["v_judgements"] = f"""
SELECT DISTINCT l_orderkey AS project_id, l_orderkey * 10 + l_linenumber AS task_id,
       'C' || CAST(l_partkey AS STRING) AS claim_id, l_suppkey AS pos,
       CASE (l_partkey + l_suppkey) % 12 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'partial'
            ELSE 'supported' END AS verdict,
       CASE WHEN l_partkey % 14 = 0 THEN 'page 3' ELSE '[' || {_key('l_orderkey', 'l_linenumber')} || ']' END AS raw_key,
       'because ' || CAST(l_suppkey AS STRING) AS reasoning
FROM lineitem WHERE l_partkey % 19 <> 0
UNION ALL
SELECT DISTINCT l_orderkey AS project_id, l_orderkey * 10 + l_linenumber AS task_id,
       'C' || CAST(l_partkey AS STRING) AS claim_id, 1000000 + l_suppkey AS pos, 'supported' AS verdict,
       {_key('l_orderkey', 'l_linenumber')} AS raw_key, 'second look' AS reasoning
FROM lineitem WHERE l_partkey % 21 = 0"""

ADAPTERS["v_stories"] = f"""
SELECT project_id, 'US-' || CAST(task_id AS STRING) AS story_key, task_id * 2 AS story_id,
       CASE WHEN part_id % 2 = 0 THEN 'client' ELSE 'engineer' END AS kind,
       CASE WHEN part_id % 2 = 0 THEN 'R-' || CAST(1 + ord % 4 AS STRING) ELSE '' END AS requirement_id,
       CASE WHEN part_id % 2 = 1 THEN CASE WHEN part_id % 15 = 0 THEN task_id + 100000000 ELSE task_id END END AS task_id,
       {_pick('supplier_id', ACTORS)} AS actor,
       CASE WHEN supplier_id % 2 = 0 THEN ' to earn points' ELSE 'establish agreements ' END AS capability,
       'work ' || CAST(part_id AS STRING) || ' is done' AS benefit,
       CASE WHEN part_id % 4 = 1 THEN ' use REST ' ELSE '' END AS technical_notes,
       'Item ' || CAST(supplier_id % 9 AS STRING) AS detail_1, CASE WHEN part_id % 7 = 6 THEN ' MASSNAHME ' ELSE ' ITEM ' || CAST(part_id % 7 AS STRING) END AS detail_2, ord
FROM v_tasks"""

ADAPTERS["v_criteria"] = """
SELECT project_id, 'US-' || CAST(task_id AS STRING) AS story_key, 'AC-' || CAST(task_id AS STRING) || '-1' AS criterion_key, 1 AS pos,
       'Responds quickly' AS text, CASE WHEN part_id % 3 = 0 THEN ' 450 TPS ' ELSE '' END AS measure,
       'item ' || CAST(supplier_id % 8 AS STRING) AS detail_1
FROM v_tasks WHERE supplier_id % 7 <> 0
UNION ALL
SELECT project_id, 'US-' || CAST(task_id AS STRING) AS story_key, 'AC-' || CAST(task_id AS STRING) || '-2' AS criterion_key, 2 AS pos,
       'Signed off' AS text, CASE WHEN part_id % 4 = 0 THEN 'p95 <= 400ms' ELSE '' END AS measure,
       'Item ' || CAST(part_id % 7 AS STRING) AS detail_1
FROM v_tasks WHERE part_id % 2 = 0"""

DUCK["v_criteria"] = ADAPTERS["v_criteria"]
ADAPTERS["v_criteria"] = """
SELECT project_id, 'US-' || CAST(task_id AS STRING) AS story_key, 'AC-' || CAST(task_id AS STRING) || '-' || CAST(pos AS STRING) AS criterion_key, pos,
       CASE pos WHEN 1 THEN 'Responds quickly' ELSE 'Signed off' END AS text,
       CASE WHEN pos = 1 AND part_id % 3 = 0 THEN ' 450 TPS ' WHEN pos = 2 AND part_id % 4 = 0 THEN 'p95 <= 400ms' ELSE '' END AS measure,
       CASE pos WHEN 1 THEN 'item ' || CAST(supplier_id % 8 AS STRING) ELSE 'Item ' || CAST(part_id % 7 AS STRING) END AS detail_1
FROM v_tasks LATERAL VIEW explode(filter(array(CASE WHEN supplier_id % 7 <> 0 THEN 1 END, CASE WHEN part_id % 2 = 0 THEN 2 END), x -> x IS NOT NULL)) places AS pos"""

ADAPTERS["v_cases"] = f"""
SELECT project_id, CASE WHEN part_id % 37 = 0 THEN '' ELSE 'US-' || CAST(task_id AS STRING) END AS story_key,
       'TC-' || CAST(task_id AS STRING) AS case_key, 'Case ' || CAST(ord AS STRING) AS title,
       CASE WHEN supplier_id % 3 = 0 THEN '10 points are added' WHEN supplier_id % 3 = 1 THEN 'balance changes' ELSE '' END AS expected_result,
       {_pick('part_id', FIELD_KEYS)} AS field_1, {_pick('supplier_id', FIELD_KEYS)} AS field_2, 1 AS pos
FROM v_tasks"""

ADAPTERS["v_people"] = """
SELECT s_suppkey AS person_id, s_name AS name, s_acctbal > 0 AS active,
       CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'acct-' || CAST(s_suppkey % 90 AS STRING) END AS account_id
FROM supplier"""

ADAPTERS["v_person_roles"] = f"""
SELECT s_suppkey AS person_id, {_pick('s_nationkey', ROSTER_TITLES)} AS role_title FROM supplier
UNION ALL
SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 5 = 0 THEN 'Astronaut' ELSE {_pick('s_suppkey * 7 + 3', ROSTER_TITLES)} END AS role_title
FROM supplier WHERE s_suppkey % 2 = 0"""

ADAPTERS["v_project_roles"] = f"""
SELECT project_id, role_id, {_pick('pick', ROSTER_TITLES)} AS role_title,
       CASE WHEN pick % 15 < 4 THEN 'commercial' WHEN pick % 15 < 10 THEN 'technical' ELSE 'operations' END AS team,
       'explicit' AS source_status,
       CASE WHEN project_id % 3 = 0 THEN holder END AS person_id
FROM (
  SELECT o_orderkey AS project_id, o_orderkey * 10 + 1 AS role_id, o_orderkey AS pick, o_custkey % 100 AS holder FROM orders WHERE o_orderkey % 8 <> 0
  UNION ALL
  SELECT o_orderkey AS project_id, o_orderkey * 10 + 2 AS role_id, o_orderkey + 4 AS pick, o_custkey % 100 AS holder FROM orders WHERE o_orderkey % 8 <> 0
  UNION ALL
  SELECT o_orderkey AS project_id, o_orderkey * 10 + 3 AS role_id, o_custkey AS pick, o_custkey % 100 AS holder FROM orders WHERE o_orderkey % 8 <> 0
) r"""

DUCK["v_project_roles"] = ADAPTERS["v_project_roles"]
ADAPTERS["v_project_roles"] = ADAPTERS["v_project_roles"][: ADAPTERS["v_project_roles"].index("FROM (")] + """
FROM (
  SELECT o_orderkey AS project_id, o_orderkey * 10 + k AS role_id, CASE k WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey + 4 ELSE o_custkey END AS pick,
         o_custkey % 100 AS holder FROM orders LATERAL VIEW explode(array(1, 2, 3)) ks AS k WHERE o_orderkey % 8 <> 0
) r"""

ADAPTERS["v_cards"] = """
SELECT 'B-' || CAST(project_id AS STRING) AS board_id, external_ref AS card_id,
       CASE WHEN supplier_id % 8 = 0 THEN 'L-done' WHEN supplier_id % 8 = 1 THEN 'L-gone' ELSE 'L-' || team END AS list_id,
       CASE WHEN supplier_id % 12 = 0 THEN title || ' (edited)' ELSE title END AS title,
       'body of ' || CAST(task_id AS STRING) AS body, part_id % 16 = 1 AS archived,
       CASE WHEN supplier_id % 6 = 0 THEN '' ELSE 'acct-' || CAST(supplier_id % 90 AS STRING) END AS member
FROM v_tasks WHERE external_ref <> '' AND supplier_id % 10 <> 0 AND project_id % 41 <> 0"""

ADAPTERS["v_board_lists"] = """
SELECT 'L-done' AS list_id, 'Done' AS list_name FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'L-commercial' AS list_id, 'Commercial' AS list_name FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'L-technical' AS list_id, 'Technical' AS list_name FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'L-operations' AS list_id, 'Operations' AS list_name FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'L-marketing' AS list_id, 'Backlog' AS list_name FROM region WHERE r_regionkey = 0"""

ADAPTERS["v_planned"] = """
SELECT t.project_id, 'B-' || CAST(t.project_id AS STRING) AS board_id, t.task_id, t.title, t.team, t.external_ref,
       CASE WHEN t.supplier_id % 3 = 0 THEN '' ELSE 'acct-' || CAST(t.supplier_id % 90 AS STRING) END AS account_id,
       CASE WHEN t.supplier_id % 3 = 1 THEN '' ELSE 'Supplier#' || lpad(CAST(t.supplier_id AS STRING), 9, '0') END AS owner,
       CASE WHEN t.part_id % 7 = 0 THEN '' ELSE substr(SHA(t.title || chr(0) || 'body of ' || CAST(t.task_id AS STRING)), 1, 32) END AS board_fingerprint
FROM v_tasks t""".replace("SHA(", "@sha(")

ADAPTERS["v_open_drift"] = """
SELECT project_id, task_id, kind, 'old wording' AS detail, start_date AS first_seen_on,
       CASE WHEN part_id % 6 = 0 THEN start_date + CAST(2 AS INT) END AS resolved_on,
       CASE WHEN part_id % 4 = 0 THEN start_date END AS notified_on
FROM (SELECT project_id, task_id, part_id, start_date, 'moved' AS kind FROM v_tasks WHERE external_ref <> '' AND supplier_id % 4 = 0
      UNION ALL SELECT project_id, task_id, part_id, start_date, 'archived' AS kind FROM v_tasks WHERE external_ref <> '' AND part_id % 8 = 1) d"""

ADAPTERS["v_requests"] = """
SELECT conv_id AS project_id, turn, role AS graph_node, CASE WHEN conv_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
       'Answer' AS schema_name, text AS prompt_text, text AS output_text, CAST(conv_id * 100 + turn AS BIGINT) AS created_at
FROM conversations"""

ADAPTERS["v_embeddings"] = """
SELECT label AS project_id, vec_id, embedding FROM embeddings"""

ADAPTERS["v_items"] = """
SELECT task_id AS card_id, 'Acceptance criteria' AS list_name, 'line ' || CAST(k AS STRING) AS item, k AS want_pos, kept, have_pos
FROM (
  SELECT task_id, 1 AS k, part_id % 3 <> 0 AS kept, CAST(16384 AS INT) AS have_pos FROM v_tasks
  UNION ALL SELECT task_id, 2 AS k, part_id % 5 <> 0 AS kept, CAST(CASE WHEN supplier_id % 4 = 0 THEN 8192 ELSE 32768 END AS INT) AS have_pos FROM v_tasks
  UNION ALL SELECT task_id, 3 AS k, part_id % 7 <> 0 AS kept, CAST(65536 AS INT) AS have_pos FROM v_tasks
) i"""

DUCK["v_items"] = ADAPTERS["v_items"]
ADAPTERS["v_items"] = """
SELECT task_id AS card_id, 'Acceptance criteria' AS list_name, 'line ' || CAST(k AS STRING) AS item, k AS want_pos,
       CASE k WHEN 1 THEN part_id % 3 <> 0 WHEN 2 THEN part_id % 5 <> 0 ELSE part_id % 7 <> 0 END AS kept,
       CASE k WHEN 1 THEN 16384 WHEN 2 THEN CASE WHEN supplier_id % 4 = 0 THEN 8192 ELSE 32768 END ELSE 65536 END AS have_pos
FROM v_tasks LATERAL VIEW explode(array(1, 2, 3)) lines AS k"""
DUCK["v_planned"] = ADAPTERS["v_planned"].replace("@sha(", "sha256(")
ADAPTERS["v_planned"] = ADAPTERS["v_planned"].replace("@sha(", "sha256(").replace("sha256(", "sha2(").replace(
    "CAST(t.task_id AS STRING)), 1, 32)", "CAST(t.task_id AS STRING), 256), 1, 32)"
)

# Every seventh line starts a section; blocks are parted by blank lines, headings underlined.
DUCK["v_docs"] = f"""
SELECT doc_id AS project_id, {_doc_key('doc_id')} AS doc_key, lang, source,
       array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
         CASE WHEN i % 7 = 4 THEN CAST(CAST(floor((i - 1) / 7) AS INT) + 1 AS STRING) || '. '
                || regexp_replace(substr(x, 1, 40), '[. ]+$', '') || chr(10) || '-----' || chr(10) || chr(10) || x
              ELSE x END), chr(10) || ' ' || chr(10)) AS text
FROM documents"""

DUCK["v_lines"] = f"""
SELECT {_doc_key('doc_id')} AS doc_key, CAST(floor((i - 1) / 20) AS INT) + 1 AS page, CAST(i AS INT) AS line_no,
       CAST(((i - 1) % 20) * 12.0 + floor(((i - 1) % 20) / 4) * 6.0 AS DOUBLE) AS top, CAST(50.0 AS DOUBLE) AS x0,
       CASE WHEN i % 7 = 5 THEN CAST(i AS STRING) || '. ' || regexp_replace(substr(lines[i], 1, 40), '[. ]+$', '') ELSE lines[i] END AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) l"""


def _spark_docs(catalog):
    line = F.split("text", "\n")

    def block(x, i):
        heading = F.concat(
            (F.floor(i / 7) + 1).cast("string"), F.lit(". "),
            F.regexp_replace(F.substring(x, 1, 40), "[. ]+$", ""), F.lit("\n-----\n\n"), x,
        )
        return F.when(i % 7 == 3, heading).otherwise(x)

    return catalog.table("documents").select(
        F.col("doc_id").alias("project_id"),
        F.expr(_doc_key("doc_id")).alias("doc_key"), "lang", "source",
        F.array_join(F.transform(line, block), "\n \n").alias("text"),
    )


def _spark_lines(catalog):
    exploded = catalog.table("documents").select(
        F.expr(_doc_key("doc_id")).alias("doc_key"), F.posexplode(F.split("text", "\n")).alias("i", "text")
    )
    on_page = F.col("i") % 20
    return exploded.select(
        "doc_key", (F.floor(F.col("i") / 20) + 1).cast("int").alias("page"), (F.col("i") + 1).alias("line_no"),
        (on_page * 12.0 + F.floor(on_page / 4) * 6.0).alias("top"), F.lit(50.0).alias("x0"),
        F.when((F.col("i") + 1) % 7 == 5, F.concat((F.col("i") + 1).cast("string"), F.lit(". "), F.regexp_replace(
            F.substring("text", 1, 40), "[. ]+$", ""))).otherwise(F.col("text")).alias("text"),
    )


SPARK_ONLY = {"v_docs": _spark_docs, "v_lines": _spark_lines}
