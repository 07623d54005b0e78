"""Roles, staffing and the directory of people."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom import vocab
from planloom.operators import roles, staffing
from planloom.plans.adapters import DUCK
from planloom.plans.registry import query

_syn = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ROLE_SYNONYMS.items())
_generic = "[" + ", ".join(f"'{w}'" for w in vocab.GENERIC_ROLE_WORDS) + "]"
_client = "[" + ", ".join(f"'{w}'" for w in vocab.CLIENT_SIDE_WORDS) + "]"


def duck_tokens(x: str) -> str:
    return (
        f"list_distinct(list_transform(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        f"lambda w: CASE w {_syn} ELSE w END))"
    )


def duck_score(a: str, b: str) -> str:
    shared = f"list_intersect({a}, {b})"
    return f"(len(list_filter({shared}, lambda w: NOT list_contains({_generic}, w))) * 10 + len(list_filter({shared}, lambda w: list_contains({_generic}, w))))"


_roster = ", ".join("(" + ", ".join([str(i), f"'{t}'", f"'{team}'", f"'{does}'", str(lead)]) + ")" for i, (t, team, does, lead) in enumerate(vocab.ROSTER, 1))
DUCK["v_roster"] = f"SELECT o AS role_ord, t AS role_title, m AS team, d AS responsibility, l AS is_lead, {duck_tokens('t')} AS toks FROM (VALUES {_roster}) x(o, t, m, d, l)"
# Roles the documents named themselves: some orders bring an architect to the technical team.
DUCK["v_named_roles"] = "SELECT project_id, role_id, CASE WHEN role_id % 4 = 0 THEN 'Integration Architect' ELSE role_title END AS role_title, CASE WHEN role_id % 4 = 0 THEN 'technical' ELSE team END AS team FROM v_project_roles"
DUCK["v_raw_roles"] = f"SELECT raw_role, team, toks, lead FROM (SELECT DISTINCT raw_role, team, {duck_tokens('raw_role')} AS toks FROM v_tasks) LEFT JOIN (SELECT team, role_title AS lead FROM v_roster WHERE is_lead) l USING (team)"
DUCK["v_options"] = f"""
SELECT w.raw_role, w.team, r.role_title, r.team AS role_team, r.role_ord AS o, {duck_score('r.toks', 'w.toks')} AS s FROM v_raw_roles w CROSS JOIN v_roster r"""
DUCK["v_matched"] = f"""
SELECT t.project_id, t.task_id, t.team, t.raw_role, w.lead, b.role_title AS own, coalesce(b.s, 0) AS own_s, x.role_title AS extra, x.s AS extra_s, ot.role_team AS other_team, len(w.toks) = 0 AS blank
FROM v_tasks t JOIN v_raw_roles w USING (raw_role, team)
LEFT JOIN (SELECT raw_role, team, arg_max(role_title, (s, -o)) AS role_title, max(s) AS s FROM v_options WHERE team = role_team GROUP BY 1, 2) b USING (raw_role, team)
LEFT JOIN (SELECT raw_role, team, arg_min(role_team, o) AS role_team FROM v_options WHERE team <> role_team AND s >= 10 GROUP BY 1, 2) ot USING (raw_role, team)
LEFT JOIN (SELECT task_id, arg_max(role_title, (s, -role_id)) AS role_title, max(s) AS s FROM (
  SELECT t.task_id, n.role_id, n.role_title, {duck_score(duck_tokens('n.role_title'), 'w.toks')} AS s FROM v_tasks t JOIN v_raw_roles w USING (raw_role, team)
  JOIN v_named_roles n ON n.project_id = t.project_id AND n.team = t.team WHERE (lower(n.role_title), n.team) NOT IN (SELECT (lower(role_title), team) FROM v_roster)) WHERE s >= 10 GROUP BY 1) x USING (task_id)"""


def named_roles(c):
    architect = F.col("role_id") % 4 == 0
    return c.view("v_project_roles").select(
        "project_id", "role_id", F.when(architect, "Integration Architect").otherwise(F.col("role_title")).alias("role_title"),
        F.when(architect, "technical").otherwise(F.col("team")).alias("team"))


@query("role_tokens", f"SELECT task_id, array_to_string(list_sort({duck_tokens('raw_role')}), ' ') AS tokens FROM v_tasks")
def _(c):
    return c.view("v_tasks").select("task_id", F.array_join(F.array_sort(roles.tokens(F.col("raw_role"))), " ").alias("tokens"))


@query("role_match", """
SELECT task_id, CASE WHEN lead IS NULL THEN raw_role WHEN coalesce(extra_s > own_s, false) THEN extra WHEN own_s >= 10 AND NOT blank THEN own ELSE lead END AS role_title,
  CASE WHEN lead IS NULL THEN 'unknown team ''' || team || '''; role left as written' WHEN blank OR coalesce(extra_s > own_s, false) OR own_s >= 10 THEN '' WHEN other_team IS NOT NULL THEN 'role ''' || raw_role || ''' belongs to the ' || other_team || ' team but the task is ' || team || '; assigned to ' || lead
       ELSE 'unknown ' || team || ' role ''' || raw_role || ''', assigned to ' || lead END AS warning FROM v_matched""")
def _(c):
    return roles.matched(c.view("v_tasks"), roles.targets(named_roles(c))).select("task_id", "role_title", "warning")


@query("role_targets", """
SELECT project_id, role_id, role_title, team FROM v_named_roles WHERE (lower(role_title), team) NOT IN (SELECT (lower(role_title), team) FROM v_roster)""")
def _(c):
    return roles.targets(named_roles(c)).select("project_id", "role_id", "role_title", "team")


@query("role_default_roster", """
SELECT p.project_id, r.role_title, r.team, r.responsibility, 'assumed' AS source_status FROM v_projects p CROSS JOIN v_roster r WHERE p.project_id NOT IN (SELECT project_id FROM v_project_roles)""")
def _(c):
    return roles.default_roster(c.view("v_projects"), c.view("v_project_roles")).drop("headcount")


@query("role_close_roster", """
SELECT DISTINCT t.project_id, t.team, t.assignee_role AS role_title, coalesce(r.responsibility, '') AS responsibility FROM v_tasks t LEFT JOIN v_roster r ON r.role_title = t.assignee_role AND r.team = t.team
WHERE NOT EXISTS (SELECT 1 FROM v_project_roles p WHERE p.project_id = t.project_id AND p.team = t.team AND lower(p.role_title) = lower(t.assignee_role))""")
def _(c):
    return roles.close_roster(c.view("v_tasks"), c.view("v_project_roles"), vocab.roster(c.spark)).drop("source_status")


DUCK["v_delivery"] = f"""
SELECT s.story_key, s.project_id, NOT list_has_any(a, {_client}) AND NOT list_has_any(a, list_filter(list_concat({duck_tokens('p.merchant_name')},
    list_transform(regexp_extract_all(p.merchant_name, '[A-Z][a-z]+|[a-z]+'), lambda w: lower(w))), lambda w: length(w) > 2)) AND coalesce(o.ours, false) AS is_delivery
FROM (SELECT *, {duck_tokens('actor')} AS a FROM v_stories) s JOIN v_projects p USING (project_id)
LEFT JOIN (SELECT actor, bool_or({duck_score('r.toks', 'k')} >= 10) AS ours FROM (SELECT DISTINCT actor, {duck_tokens('actor')} AS k FROM v_stories) CROSS JOIN v_roster r GROUP BY 1) o ON o.actor = s.actor"""


def delivery(c):
    clients = c.view("v_projects").select("project_id", "merchant_name")
    return c.view("v_stories").join(clients, "project_id").withColumn(
        "is_delivery", roles.is_delivery(F.col("actor"), F.col("merchant_name")))


@query("role_is_delivery", "SELECT story_key, is_delivery FROM v_delivery")
def _(c):
    return delivery(c).select("story_key", "is_delivery")


_titles = ", ".join(f"'{t}'" for t, *_ in vocab.ROSTER)


@query("role_capabilities", f"""
SELECT DISTINCT person_id, role_title FROM v_person_roles WHERE person_id % 2 = 0 AND role_title IN ({_titles})
UNION ALL SELECT person_id, role_title FROM v_person_roles WHERE person_id % 2 = 1""")
def _(c):
    existing = c.view("v_person_roles")
    return staffing.set_capabilities(existing.filter("person_id % 2 = 0"), existing)


DUCK["v_candidates"] = "SELECT DISTINCT role_title, person_id, name FROM v_people JOIN v_person_roles USING (person_id) WHERE active"


@query("staff_candidates", "SELECT * FROM v_candidates")
def _(c):
    return staffing.candidates(c.view("v_people"), c.view("v_person_roles")).orderBy("role_title", "name")


DUCK["v_staffed"] = """
SELECT r.project_id, r.role_id, r.role_title, CASE WHEN r.person_id IS NULL AND n = 1 THEN o ELSE r.person_id END AS person_id,
       CASE WHEN r.person_id IS NOT NULL THEN 'held' WHEN coalesce(n, 0) = 1 THEN 'filled' WHEN n > 1 THEN 'choose' ELSE 'nobody' END AS outcome, coalesce(n, 0) AS candidates
FROM v_project_roles r LEFT JOIN (SELECT role_title, count(*) AS n, max(person_id) AS o FROM v_candidates GROUP BY 1) c USING (role_title)"""


def staffed(c):
    return staffing.autostaff(c.view("v_project_roles"), c.view("v_people"), c.view("v_person_roles"))


@query("staff_auto", "SELECT * FROM v_staffed")
def _(c):
    return staffed(c)


@query("staff_notes", """
SELECT project_id, role_id, CASE outcome WHEN 'choose' THEN role_title || ': ' || candidates || ' people can do this' ELSE role_title || ': nobody in the directory does this yet' END AS note
FROM v_staffed WHERE outcome IN ('choose', 'nobody')""")
def _(c):
    return staffing.autostaff_notes(staffed(c))


DUCK["v_owned"] = """
SELECT t.*, CASE WHEN t.assignee <> '' THEN t.assignee ELSE coalesce(p.name, '') END AS owner, CASE WHEN t.assignee <> '' THEN '' ELSE coalesce(p.account_id, '') END AS account_id FROM v_tasks t
LEFT JOIN (SELECT project_id, role_title, person_id FROM v_project_roles QUALIFY row_number() OVER (PARTITION BY project_id, role_title ORDER BY role_id) = 1) r
  ON r.project_id = t.project_id AND r.role_title = t.assignee_role LEFT JOIN v_people p ON p.person_id = r.person_id"""


def owned(c):
    return staffing.owners(c.view("v_tasks"), c.view("v_project_roles"), c.view("v_people"))


@query("staff_owner", "SELECT task_id, owner, account_id FROM v_owned")
def _(c):
    return owned(c).select("task_id", "owner", "account_id")


# Requests to change who holds a role: some name nobody, some an unknown person or role.
DUCK["v_asks"] = """
SELECT o_orderkey AS project_id, o_orderkey * 10 + 1 AS role_id, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN o_custkey + 1000000 ELSE o_custkey % 50 END AS person_id FROM orders WHERE o_orderstatus = 'F'"""


def asks(c):
    cust = F.col("o_custkey")
    return c.table("orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") * 10 + 1).alias("role_id"),
        F.when(cust % 4 == 0, None).when(cust % 4 == 1, cust + 1000000).otherwise(cust % 50).alias("person_id"))


@query("staff_set_holder", """
SELECT r.project_id, r.role_id, CASE WHEN ok THEN a.person_id ELSE r.person_id END AS person_id, coalesce(ok, false) AS changed FROM v_project_roles r
LEFT JOIN (SELECT *, person_id IS NULL OR person_id IN (SELECT person_id FROM v_people) AS ok FROM v_asks) a USING (project_id, role_id)""")
def _(c):
    return staffing.set_holders(c.view("v_project_roles"), asks(c), c.view("v_people")).select("project_id", "role_id", "person_id", "changed")


@query("staff_set_holder_refused", """
SELECT project_id, role_id, 'role not found in this project' AS reason FROM v_asks WHERE role_id NOT IN (SELECT role_id FROM v_project_roles)
UNION ALL SELECT project_id, role_id, 'person not found' FROM v_asks WHERE role_id IN (SELECT role_id FROM v_project_roles) AND person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM v_people)""")
def _(c):
    return staffing.refused_holders(c.view("v_project_roles"), asks(c), c.view("v_people"))


@query("staff_mark_dirty", """
SELECT t.task_id, t.board_dirty OR (t.external_ref <> '' AND EXISTS (SELECT 1 FROM v_project_roles r JOIN v_asks a USING (role_id) WHERE r.project_id = t.project_id AND r.role_title = t.assignee_role
  AND (a.person_id IS NULL OR a.person_id IN (SELECT person_id FROM v_people)))) AS board_dirty FROM v_tasks t""")
def _(c):
    changed = staffing.set_holders(c.view("v_project_roles"), asks(c), c.view("v_people")).filter("changed")
    return staffing.mark_dirty(c.view("v_tasks"), changed).select("task_id", "board_dirty")


@query("staff_account_clash", """
SELECT account_id, person_id, name, count(*) OVER (PARTITION BY account_id) AS holders FROM v_people WHERE account_id <> '' QUALIFY count(*) OVER (PARTITION BY account_id) > 1""")
def _(c):
    return staffing.account_clashes(c.view("v_people"))


@query("people_directory", """
SELECT p.*, coalesce(r, '') AS roles FROM v_people p LEFT JOIN (SELECT person_id, string_agg(DISTINCT role_title, ', ' ORDER BY role_title) AS r FROM v_person_roles GROUP BY 1) USING (person_id)""")
def _(c):
    return staffing.directory(c.view("v_people"), c.view("v_person_roles"))


@query("staff_person_upsert", """
SELECT coalesce(p.name, a.name) AS name, person_id, CASE WHEN person_id IS NULL THEN true ELSE active OR a.name IS NOT NULL END AS active,
       CASE WHEN a.name IS NULL THEN 'unchanged' WHEN person_id IS NULL THEN 'added' WHEN active THEN 'refused' ELSE 'reactivated' END AS outcome
FROM v_people p FULL JOIN (SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION SELECT s_name FROM supplier WHERE s_nationkey < 12) a ON a.name = p.name""")
def _(c):
    new = c.table("customer").filter("c_acctbal < 0").select(F.concat(F.lit(" "), "c_name").alias("name"))
    again = c.table("supplier").filter("s_nationkey < 12").select(F.col("s_name").alias("name"))
    return staffing.upsert_people(c.view("v_people"), new.union(again))
