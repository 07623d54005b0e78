"""Review, cards, pushing, drift and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom import vocab
from planloom.operators import artifacts, board, review
from planloom.plans.adapters import DUCK
from planloom.plans.people_queries import owned
from planloom.plans.provenance_queries import norm, valid_citations
from planloom.plans.registry import query
from planloom.plans.validation_queries import cases, criteria, engineer_stories
from planloom.operators import linking, provenance

# Review ----------------------------------------------------------------------------------


@query("rev_summary", """
SELECT p.project_id, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending, coalesce(approved, 0) AS approved, coalesce(edited, 0) AS edited, coalesce(rejected, 0) AS rejected,
       coalesce(pending, 0) = 0 AND coalesce(rejected, 0) = 0 AS ready FROM v_projects p LEFT JOIN (
  SELECT project_id, count(*) AS total, count(*) FILTER (WHERE review_status = 'pending') AS pending, count(*) FILTER (WHERE review_status = 'approved') AS approved,
         count(*) FILTER (WHERE review_status = 'edited') AS edited, count(*) FILTER (WHERE review_status = 'rejected') AS rejected FROM v_tasks GROUP BY 1) USING (project_id)""")
def _(c):
    return review.summary(c.view("v_projects"), c.view("v_tasks"))


@query("rev_set_status", """
SELECT task_id, CASE WHEN hit THEN CASE WHEN supplier_id % 2 = 0 THEN 'approved' ELSE 'rejected' END ELSE review_status END AS review_status,
       CASE WHEN hit THEN 'decided in review' ELSE review_note END AS review_note FROM (SELECT *, validation_status = 'review' AS hit FROM v_tasks)""")
def _(c):
    tasks = c.view("v_tasks")
    decisions = tasks.filter("validation_status = 'review'").select(
        "project_id", "task_id", F.when(F.col("supplier_id") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.lit("decided in review").alias("note"))
    return review.set_status(tasks, decisions).select("task_id", "review_status", "review_note")


@query("rev_approve_project", """
SELECT project_id, CASE WHEN project_id IN (SELECT project_id FROM v_tasks GROUP BY 1 HAVING bool_and(review_status = 'approved')) THEN 'approved' ELSE status END AS status FROM v_projects""")
def _(c):
    ready = review.summary(c.view("v_projects"), c.view("v_tasks")).filter("total > 0 AND approved = total")
    return review.approve_projects(c.view("v_projects"), ready).select("project_id", "status")


DUCK["v_edits"] = """
SELECT project_id, task_id, CASE WHEN supplier_id % 2 = 0 THEN title || ' v2' END AS title, CAST(NULL AS STRING) AS description, CASE WHEN supplier_id % 5 = 0 THEN 'operations' END AS team,
       CASE WHEN supplier_id % 3 = 0 THEN CAST(40.0 AS DOUBLE) END AS estimated_hours FROM v_tasks WHERE review_note <> ''"""


def edits(c):
    s = F.col("supplier_id")
    return c.view("v_tasks").filter("review_note <> ''").select(
        "project_id", "task_id", F.when(s % 2 == 0, F.concat("title", F.lit(" v2"))).alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(s % 5 == 0, "operations").alias("team"), F.when(s % 3 == 0, 40.0).alias("estimated_hours"))


@query("rev_apply_edit", """
SELECT t.task_id, coalesce(e.title, t.title) AS title, t.description, coalesce(e.team, t.team) AS team, coalesce(e.estimated_hours, t.estimated_hours) AS estimated_hours,
  CASE WHEN e.task_id IS NOT NULL THEN 'edited' ELSE review_status END AS review_status, e.task_id IS NOT NULL OR board_dirty AS board_dirty,
  CASE WHEN e.task_id IS NULL THEN grounding_score END AS grounding_score, CASE WHEN e.task_id IS NOT NULL THEN 'pending' ELSE validation_status END AS validation_status
FROM v_tasks t LEFT JOIN v_edits e USING (task_id)""")
def _(c):
    return review.apply_edits(c.view("v_tasks"), edits(c)).select(
        "task_id", "title", "description", "team", "estimated_hours", "review_status", "board_dirty", "grounding_score", "validation_status")


@query("rev_drop_claims", "SELECT task_id, claim_id FROM v_claims WHERE task_id NOT IN (SELECT task_id FROM v_edits)")
def _(c):
    return review.drop_claims(c.view("v_claims"), edits(c)).select("task_id", "claim_id")


@query("rev_regen_guard", "SELECT project_id, task_id, regeneration_count FROM v_tasks WHERE regeneration_count >= 3")
def _(c):
    return review.regeneration_refused(c.view("v_tasks")).select("project_id", "task_id", "regeneration_count")


@query("rev_regen_apply", """
SELECT task_id, CASE WHEN hit AND part_id % 2 = 0 THEN 'Rewritten' ELSE title END AS title, CASE WHEN hit THEN 'new text' ELSE description END AS description,
       CASE WHEN hit AND part_id % 4 = 0 THEN 16.0 ELSE estimated_hours END AS estimated_hours, CASE WHEN hit AND part_id % 8 = 0 THEN 'K2' ELSE 'K1' END AS source_key,
       CASE WHEN hit THEN 'pending' ELSE review_status END AS review_status, hit OR board_dirty AS board_dirty, CAST(regeneration_count + CASE WHEN hit THEN 1 ELSE 0 END AS INT) AS regeneration_count
FROM (SELECT *, review_status = 'rejected' AND regeneration_count < 3 AS hit FROM v_tasks)""")
def _(c):
    tasks, pk = c.view("v_tasks").withColumn("source_key", F.lit("K1")), F.col("part_id")
    new = tasks.filter("review_status = 'rejected'").select(
        "project_id", "task_id", F.when(pk % 2 == 0, "Rewritten").otherwise("").alias("new_title"), F.lit("new text").alias("new_description"),
        F.when(pk % 4 == 0, 16.0).alias("new_hours"), F.when(pk % 8 == 0, "K2").otherwise("").alias("new_key"))
    return review.apply_regeneration(tasks, new).select(
        "task_id", "title", "description", "estimated_hours", "source_key", "review_status", "board_dirty", "regeneration_count")


# Pushing ---------------------------------------------------------------------------------


@query("push_eligible", """
SELECT t.project_id, t.task_id, t.review_status IN ('approved', 'edited') AS task_pushable, p.status IN ('approved', 'partially_synced', 'synced') AND NOT b.r AS project_pushable,
       t.external_ref = '' OR t.board_dirty AS outstanding FROM v_tasks t JOIN v_projects p USING (project_id) JOIN (SELECT project_id, bool_or(review_status = 'rejected') AS r FROM v_tasks GROUP BY 1) b USING (project_id)""")
def _(c):
    return board.eligible(c.view("v_tasks"), c.view("v_projects"))


@query("push_plan", """
SELECT project_id, task_id, CASE WHEN external_ref = '' THEN 'create' WHEN external_ref IN (SELECT card_id FROM v_cards) THEN 'update' ELSE 'gone' END AS action FROM v_tasks""")
def _(c):
    return board.push_plan(c.view("v_tasks"), c.view("v_cards"))


@query("board_status", """
SELECT p.project_id, CASE WHEN coalesce(n, 0) = 0 THEN p.status WHEN n = l THEN 'synced' ELSE 'partially_synced' END AS status FROM v_projects p
LEFT JOIN (SELECT project_id, count(*) AS l, count(*) FILTER (WHERE external_ref <> '') AS n FROM v_tasks WHERE review_status <> 'rejected' GROUP BY 1) USING (project_id)""")
def _(c):
    return board.status(c.view("v_projects"), c.view("v_tasks"))


def linked_deps(c):
    return linking.link_dependencies(c.view("v_deps"), c.view("v_tasks"))


@query("board_dangling", """
SELECT t.project_id, t.task_id, d.depends_on_id, u.title AS missing, '''' || t.title || ''' is on the board before what it depends on: ' || u.title AS message
FROM v_linked d JOIN v_tasks t ON t.task_id = d.task_id JOIN v_tasks u ON u.task_id = d.depends_on_id WHERE t.external_ref <> '' AND u.external_ref = ''""")
def _(c):
    return board.dangling(c.view("v_tasks"), linked_deps(c))


@query("board_unassignable", "SELECT project_id, owner, count(*) AS cards FROM v_owned WHERE owner <> '' AND account_id = '' GROUP BY 1, 2")
def _(c):
    return board.unassignable(owned(c))


@query("outstanding_counts", """
SELECT project_id, count(*) FILTER (WHERE external_ref <> '') AS on_board, count(*) FILTER (WHERE external_ref <> '' AND board_dirty) AS stale,
       count(*) FILTER (WHERE external_ref = '' OR board_dirty) AS outstanding FROM v_tasks GROUP BY 1""")
def _(c):
    return board.outstanding_counts(c.view("v_tasks"))


# Cards -----------------------------------------------------------------------------------

DUCK["v_labels"] = """
SELECT task_id, 'TEAM-' || upper(team) || CASE WHEN assignee_role <> '' THEN ',ROLE-' || regexp_replace(upper(assignee_role), '[^A-Z0-9]+', '-', 'g') ELSE '' END
  || CASE source_status WHEN 'explicit' THEN ',FROM-SOW' WHEN 'inferred' THEN ',INFERRED' ELSE ',ASSUMED' END
  || CASE validation_status WHEN 'accept' THEN ',GROUNDED' WHEN 'review' THEN ',REVIEW-REQUIRED' WHEN 'reject' THEN ',GROUNDING-FAILED' ELSE ',NOT-CHECKED' END AS labels FROM v_tasks"""


@query("card_labels", "SELECT * FROM v_labels")
def _(c):
    return c.view("v_tasks").select("task_id", F.array_join(board.labels(
        F.col("team"), F.col("assignee_role"), F.col("source_status"), F.col("validation_status")), ",").alias("labels"))


@query("card_label_colours", """
SELECT DISTINCT l AS label, CASE l WHEN 'TEAM-COMMERCIAL' THEN 'blue' WHEN 'TEAM-TECHNICAL' THEN 'purple' WHEN 'TEAM-OPERATIONS' THEN 'orange' WHEN 'FROM-SOW' THEN 'sky' WHEN 'INFERRED' THEN 'sky'
  WHEN 'ASSUMED' THEN 'pink' WHEN 'GROUNDED' THEN 'green' WHEN 'REVIEW-REQUIRED' THEN 'yellow' WHEN 'GROUNDING-FAILED' THEN 'red' ELSE 'black' END AS colour
FROM (SELECT unnest(string_split(labels, ',')) AS l FROM v_labels)""")
def _(c):
    label = F.explode(board.labels(F.col("team"), F.col("assignee_role"), F.col("source_status"), F.col("validation_status")))
    return c.view("v_tasks").select(label.alias("label")).distinct().withColumn("colour", board.label_colour(F.col("label")))


DUCK["v_check_items"] = """
SELECT s.project_id, s.task_id, 'Acceptance criteria' AS list_name, s.story_key, c.pos, CASE WHEN measure <> '' THEN text || ' — ' || measure ELSE text END AS item
FROM v_task_stories s JOIN v_crit c USING (project_id, story_key)
UNION ALL SELECT s.project_id, s.task_id, 'Test cases', s.story_key, k.pos, CASE WHEN rests_on_assumption THEN '⚠️ ' || b || ' [assumes ' || replace(assumed_fields, ',', ', ') || ']' ELSE b END
FROM v_task_stories s JOIN (SELECT *, CASE WHEN expected_result <> '' THEN title || ' — expect: ' || expected_result ELSE title END AS b FROM v_case_rows) k USING (project_id, story_key)"""


def task_stories(c):
    return artifacts.stories_for_tasks(c.view("v_stories"), c.view("v_tasks"))


@query("card_checklists", "SELECT * FROM v_check_items")
def _(c):
    return board.checklist_items(task_stories(c), criteria(c), cases(c))


DUCK["v_card_rows"] = """
SELECT t.*, coalesce(f.section_title, '') AS section_title, coalesce(b.blocked_by, '') AS blocked_by, coalesce(e.sentence, '') AS story_sentence, coalesce(e.technical_notes, '') AS technical_notes, coalesce(a.af, '') AS assumed_fields
FROM v_owned t LEFT JOIN v_first f ON f.task_id = t.task_id
LEFT JOIN (SELECT d.task_id, string_agg(u.title || CASE d.source_status WHEN 'inferred' THEN ' (inferred, not stated)' WHEN 'assumed' THEN ' (assumed — the SOW does not order these)' WHEN '' THEN ' (source not recorded)' ELSE '' END, '; ' ORDER BY e.edge_ord) AS blocked_by
   FROM v_linked d JOIN (SELECT task_id, depends_on_id, min(edge_ord) AS edge_ord FROM v_deps GROUP BY 1, 2) e USING (task_id, depends_on_id) JOIN v_tasks u ON u.task_id = d.depends_on_id GROUP BY 1) b ON b.task_id = t.task_id
LEFT JOIN (SELECT e.task_id, e.technical_notes, 'As a ' || e.actor || ', I want ' || CASE WHEN lower(trim(s.capability)) LIKE 'to %' THEN trim(s.capability) ELSE 'to ' || trim(s.capability) END || ' so that ' || s.benefit AS sentence
   FROM v_engineer_stories e JOIN v_stories s USING (story_key)) e ON e.task_id = t.task_id
LEFT JOIN (SELECT task_id, string_agg(DISTINCT f, ', ' ORDER BY f) AS af FROM (SELECT s.task_id, unnest(string_split(k.assumed_fields, ',')) AS f FROM v_task_stories s JOIN v_case_rows k USING (project_id, story_key)) WHERE f <> '' GROUP BY 1) a ON a.task_id = t.task_id"""


def linked_with_order(c):
    return linked_deps(c).join(
        c.view("v_deps").groupBy("project_id", "task_id", "depends_on_id").agg(F.min("edge_ord").alias("edge_ord")), ["project_id", "task_id", "depends_on_id"])


def card_rows(c):
    return c.by_project(_card_rows)


def _card_rows(c):
    c.store("v_tasks", "v_chunks")
    keys = ["project_id", "task_id"]
    chunks = c.view("v_chunks")
    sections = provenance.first_section(valid_citations(c), chunks, "task_id")
    told = engineer_stories(c).join(c.view("v_stories").select("project_id", "story_key", "capability", "benefit"), ["project_id", "story_key"]).select(
        *keys, artifacts.sentence(F.col("actor"), F.col("capability"), F.col("benefit")).alias("story_sentence"), "technical_notes")
    # At most one entry per checklist field.
    told_of = task_stories(c)
    told_of = told_of.repartition(c.parts, "project_id") if c.parts else told_of
    assumed = told_of.join(cases(c), ["project_id", "story_key"]).select(
        *keys, F.explode(F.split("assumed_fields", ",")).alias("f")).filter("f <> ''").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("f")), ", ").alias("assumed_fields"))
    stories = c.view("v_tasks").select(*keys).join(told, keys, "left").join(assumed, keys, "left")
    return board.card_rows(owned(c), sections, board.blockers(linked_deps(c), c.view("v_tasks")), stories)


@query("card_row", "SELECT task_id, section_title, owner, account_id, blocked_by, story_sentence, technical_notes, assumed_fields FROM v_card_rows")
def _(c):
    return card_rows(c).select("task_id", "section_title", "owner", "account_id", "blocked_by", "story_sentence", "technical_notes", "assumed_fields")


DUCK["v_bodies"] = """
SELECT *, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), CASE WHEN description <> '' THEN description ELSE '(no description)' END,
  CASE WHEN story_sentence <> '' THEN '**Approach**' || chr(10) || chr(10) || story_sentence END,
  CASE WHEN technical_notes <> '' THEN '**Technical notes**' || chr(10) || chr(10) || technical_notes WHEN team = 'technical' THEN '**Technical notes**' || chr(10) || chr(10) ||
   'The SOW does not specify the interfaces, protocols or environments for this work. Nothing has been assumed on your behalf — agree them before building.' END,
  CASE WHEN w <> '' OR f <> '' THEN w || CASE WHEN w <> '' AND f <> '' THEN chr(10) || chr(10) ELSE '' END || f END,
  '@@FOOTER@@') AS body
FROM (SELECT *, concat_ws(chr(10), CASE WHEN assignee_role <> '' THEN '**Owner:** ' || CASE WHEN owner <> '' THEN owner || ' (' || assignee_role || ')' ELSE assignee_role END END,
    CASE WHEN blocked_by <> '' THEN '**Blocked by:** ' || blocked_by END, CASE WHEN section_title <> '' THEN '**From SOW:** ' || section_title END) AS f,
  concat_ws(chr(10) || chr(10), CASE WHEN source_status = 'assumed' THEN '⚠️ This task is an assumption. The SOW does not ask for it — confirm before starting.' END,
    CASE WHEN validation_status IN ('review', 'reject') AND grounding_score IS NOT NULL THEN '⚠️ Only ' || CAST(part_id % 101 AS STRING) || '% of this task''s claims are supported by the SOW. Check the details before relying on them.' END,
    CASE WHEN assumed_fields <> '' THEN '⚠️ Test cases for this task rely on values the SOW never stated (' || assumed_fields || '). Confirm them before treating a passing test as acceptance.' END) AS w FROM v_card_rows)""".replace("@@FOOTER@@", vocab.CARD_FOOTER)


@query("card_body", "SELECT task_id, body FROM v_bodies")
def _(c):
    return card_rows(c).select("task_id", board.body().alias("body"))


@query("card_fingerprint", "SELECT task_id, substr(sha256(title || chr(0) || body), 1, 32) AS fingerprint FROM v_bodies")
def _(c):
    return card_rows(c).withColumn("body", board.body()).select("task_id", board.fingerprint(F.col("title"), F.col("body")).alias("fingerprint"))


DUCK["v_places"] = "SELECT task_id, CASE WHEN team IN ('commercial', 'technical', 'operations') THEN upper(substr(team, 1, 1)) || substr(team, 2) ELSE 'Backlog' END AS list_name FROM v_tasks"


@query("card_location", "SELECT * FROM v_places")
def _(c):
    return c.view("v_tasks").select("task_id", board.location(F.col("team")).alias("list_name"))


PART = 200  # so that bodies of the test tables need several parts


@query("card_payload", f"""
SELECT b.project_id, b.task_id, CAST(part_no AS INT) AS part_no, CASE WHEN external_ref = '' THEN 'create' ELSE 'update' END AS action,
       substr(title, CAST((part_no - 1) * {PART} + 1 AS BIGINT), {PART}) AS name, substr(body, CAST((part_no - 1) * {PART} + 1 AS BIGINT), {PART}) AS "desc", l.labels,
       coalesce(CAST(due_date AS STRING), '') AS due, CASE WHEN account_id <> '' THEN account_id END AS member, p.list_name
FROM (SELECT *, unnest(range(1, greatest(1, CAST(ceil(length(title) / {PART}) AS BIGINT), CAST(ceil(length(body) / {PART}) AS BIGINT)) + 1)) AS part_no FROM v_bodies) b
JOIN v_labels l USING (task_id) JOIN v_places p USING (task_id)""")
def _(c):
    return board.payload(card_rows(c).withColumn("body", board.body()), PART)


@query("checklist_diff", """
WITH w AS (SELECT card_id, list_name, item, want_pos FROM v_items),
h AS (SELECT card_id, list_name, item, have_pos FROM v_items WHERE kept UNION ALL SELECT card_id, list_name, 'old line', 99999 FROM v_items WHERE want_pos = 1 AND NOT kept
      UNION ALL SELECT card_id, 'Old list', item, have_pos FROM v_items WHERE want_pos = 2 AND NOT kept),
j AS (SELECT coalesce(w.card_id, h.card_id) AS card_id, coalesce(w.list_name, h.list_name) AS list_name, coalesce(w.item, h.item) AS item, want_pos, have_pos
      FROM w FULL JOIN h ON w.card_id = h.card_id AND w.list_name = h.list_name AND w.item = h.item),
m AS (SELECT card_id, list_name, bool_or(p > have_pos) AS moved FROM (SELECT *, lag(have_pos) OVER (PARTITION BY card_id, list_name ORDER BY want_pos) AS p FROM j WHERE want_pos IS NOT NULL AND have_pos IS NOT NULL) GROUP BY 1, 2),
l AS (SELECT card_id, list_name, bool_or(have_pos IS NULL) AS added, count(want_pos) = 0 AS leftover FROM j GROUP BY 1, 2)
SELECT j.card_id, j.list_name, j.item, j.want_pos, CASE WHEN leftover THEN 'delete_list' WHEN want_pos IS NULL THEN 'delete' WHEN have_pos IS NULL THEN 'add' WHEN added OR coalesce(moved, false) THEN 'renumber' ELSE 'keep' END AS action
FROM j JOIN l USING (card_id, list_name) LEFT JOIN m USING (card_id, list_name)""")
def _(c):
    items = c.store("v_items").view("v_items")  # read for what is wanted and for each kind of what is there
    wanted = items.select("card_id", "list_name", "item", "want_pos")
    lost = items.filter("NOT kept")
    present = (
        items.filter("kept").select("card_id", "list_name", "item", "have_pos")
        .union(lost.filter("want_pos = 1").select("card_id", "list_name", F.lit("old line"), F.lit(99999)))
        .union(lost.filter("want_pos = 2").select("card_id", F.lit("Old list"), "item", "have_pos")))
    return board.checklist_diff(wanted, present)


# Drift -----------------------------------------------------------------------------------

DUCK["v_snapshot"] = """
SELECT c.*, coalesce(l.list_name, '') AS list_name FROM v_cards c LEFT JOIN v_board_lists l USING (list_id)"""


def snapshot(c):
    members = F.when(F.col("member") != "", F.array("member")).otherwise(F.array().cast("array<string>"))
    return board.snapshot(c.view("v_cards").withColumn("members", members), c.view("v_board_lists"))


@query("src_board_snapshot", "SELECT board_id, card_id, list_name, title, archived, CAST(CASE WHEN member <> '' THEN 1 ELSE 0 END AS INT) AS member_count FROM v_snapshot")
def _(c):
    return snapshot(c).select("board_id", "card_id", "list_name", "title", "archived", F.size("members").alias("member_count"))


DUCK["v_compared"] = """
SELECT p.*, s.card_id, s.list_name, s.title AS card_title, s.archived, s.member, sha256(s.title || chr(0) || s.body)[1:32] AS card_print,
  CASE WHEN p.team IN ('commercial', 'technical', 'operations') THEN upper(substr(p.team, 1, 1)) || substr(p.team, 2) ELSE 'Backlog' END AS planned_list
FROM v_planned p LEFT JOIN v_snapshot s ON s.board_id = p.board_id AND s.card_id = p.external_ref WHERE p.external_ref <> '' AND p.board_id IN (SELECT board_id FROM v_cards)"""
DUCK["v_drift"] = """
SELECT project_id, task_id, 'deleted' AS kind, '''' || title || ''' was deleted from the board and cannot be brought back. Pushing the task makes a new card, which will not have the old one''s comments or ticked items.' AS detail FROM v_compared WHERE card_id IS NULL
UNION ALL SELECT project_id, task_id, 'archived', '''' || title || ''' was archived on the board. It can be restored exactly as it was, with its comments and ticked items intact.' FROM v_compared WHERE archived
UNION ALL SELECT project_id, task_id, 'moved', '''' || title || ''' sits in ''' || list_name || ''', but the plan has it under ' || team || ' (''' || planned_list || ''').' FROM v_compared WHERE NOT archived AND list_name <> '' AND list_name <> planned_list
UNION ALL SELECT project_id, task_id, 'reassigned', '''' || title || ''' is no longer assigned to ' || CASE WHEN owner <> '' THEN owner ELSE 'the planned owner' END || ' on the board. Pushing the task again puts them back.' FROM v_compared WHERE NOT archived AND account_id <> '' AND member <> account_id
UNION ALL SELECT project_id, task_id, 'edited', '''' || title || ''' was edited on the board. The card now reads ''' || card_title || '''. Pushing the task again will replace it.' FROM v_compared WHERE NOT archived AND board_fingerprint <> '' AND card_print <> board_fingerprint"""


def drift_found(c):
    return board.detect(c.view("v_planned"), snapshot(c))


@query("drift_detect", "SELECT * FROM v_drift")
def _(c):
    return drift_found(c)


def now():
    return F.lit("2024-02-01").cast("date")


DUCK["v_state"] = "SELECT project_id, task_id, kind, detail, first_seen_on AS first_seen_at, notified_on AS notified_at, resolved_on AS resolved_at FROM v_open_drift"
DUCK["v_reconciled"] = """
SELECT project_id, task_id, kind, detail, first_seen_at, notified_at, resolved_at, false AS fresh FROM v_state WHERE resolved_at IS NOT NULL
UNION ALL SELECT coalesce(s.project_id, d.project_id), coalesce(s.task_id, d.task_id), coalesce(s.kind, d.kind), coalesce(d.detail, s.detail), CASE WHEN s.task_id IS NULL THEN DATE '2024-02-01' ELSE s.first_seen_at END, s.notified_at,
  CASE WHEN d.task_id IS NULL AND s.task_id IN (SELECT task_id FROM v_compared) THEN DATE '2024-02-01' END, s.task_id IS NULL
FROM (SELECT * FROM v_state WHERE resolved_at IS NULL) s FULL JOIN v_drift d ON d.task_id = s.task_id AND d.kind = s.kind"""


def state(c):
    return c.view("v_open_drift").select(
        "project_id", "task_id", "kind", "detail", F.col("first_seen_on").alias("first_seen_at"),
        F.col("notified_on").alias("notified_at"), F.col("resolved_on").alias("resolved_at"))


def reconciled(c):
    readable = c.view("v_cards").select("board_id").distinct()
    checked = c.view("v_planned").filter("external_ref <> ''").join(readable, "board_id", "left_semi")
    return board.reconcile(state(c), drift_found(c), checked, now())


@query("drift_reconcile", "SELECT * FROM v_reconciled")
def _(c):
    return reconciled(c)


@query("drift_open", "SELECT project_id, task_id, kind, detail, first_seen_at FROM v_state WHERE resolved_at IS NULL")
def _(c):
    return board.open_drift(state(c)).select("project_id", "task_id", "kind", "detail", "first_seen_at")


@query("drift_notify_batch", """
SELECT project_id, CAST(part AS INT) AS part, '**The board no longer matches the plan** (' || total || ' change(s))' || chr(10) || chr(10) || string_agg('- ' || p.name || ': ' || detail, chr(10) ORDER BY n) || chr(10) || chr(10) || 'Nothing was changed on the board. Review these in the platform.' AS message
FROM (SELECT *, floor((n - 1) / 20) AS part FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY task_id, kind) AS n, count(*) OVER (PARTITION BY project_id) AS total FROM v_reconciled WHERE fresh)) r
JOIN v_projects p USING (project_id) GROUP BY project_id, part, total""")
def _(c):
    return board.notify_batch(reconciled(c).filter("fresh"), c.view("v_projects"))


@query("drift_mark_notified", """
SELECT task_id, kind, CASE WHEN resolved_at IS NULL AND kind = 'moved' THEN DATE '2024-02-01' ELSE notified_at END AS notified_at FROM v_state""")
def _(c):
    return board.mark_notified(state(c), state(c).filter("kind = 'moved'"), now()).select("task_id", "kind", "notified_at")


@query("drift_restore_resolve", """
SELECT task_id, kind, CASE WHEN kind = 'archived' AND resolved_at IS NULL AND task_id IN (SELECT task_id FROM v_tasks WHERE board_dirty) THEN DATE '2024-02-01' ELSE resolved_at END AS resolved_at FROM v_state""")
def _(c):
    return board.restore_resolve(state(c), c.view("v_tasks").filter("board_dirty"), now()).select("task_id", "kind", "resolved_at")


@query("board_badge", """
SELECT t.task_id, CASE d.kind WHEN 'moved' THEN '↔️ moved to another list on the board' WHEN 'archived' THEN '📦 archived on the board — restorable' ELSE
  CASE WHEN external_ref = '' THEN '⬜ not on the board' WHEN board_dirty THEN '🔄 on the board, out of date' ELSE '✅ on the board' END END AS badge
FROM v_tasks t LEFT JOIN (SELECT task_id, min(kind) AS kind FROM v_state WHERE resolved_at IS NULL GROUP BY 1) d USING (task_id)""")
def _(c):
    kinds = board.open_drift(state(c)).groupBy("project_id", "task_id").agg(F.min("kind").alias("kind"))
    return c.view("v_tasks").join(kinds, ["project_id", "task_id"], "left").select(
        "task_id", board.badge(F.col("kind"), F.col("external_ref"), F.col("board_dirty")).alias("badge"))
