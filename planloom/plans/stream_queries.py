"""The board watcher over three checks, as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planloom.plans.adapters import DUCK
from planloom.plans.registry import query
from planloom.session import scratch
from planloom.streaming.drift_stream import DriftWatch

CHECKS = 3

# The same cards as three checks saw them: some missing, archived, moved, some boards unreadable.
DUCK["v_checks_seen"] = """
SELECT k AS check_no, 'B-' || project_id AS board_id, external_ref AS card_id,
       CASE WHEN (supplier_id + k) % 4 = 0 THEN 'Done' WHEN team IN ('commercial', 'technical', 'operations') THEN upper(substr(team, 1, 1)) || substr(team, 2) ELSE 'Backlog' END AS list_name,
       CASE WHEN supplier_id % 12 = 0 THEN title || ' (edited)' ELSE title END AS title, 'body of ' || task_id AS body, (part_id + k) % 16 = 1 AS archived,
       CASE WHEN supplier_id % 6 = 0 THEN '' ELSE 'acct-' || (supplier_id % 90) END AS member
FROM v_tasks CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2), (3)) x(k) WHERE external_ref <> '' AND (supplier_id + k) % 10 <> 0 AND (project_id + k) % 5 <> 0"""
DUCK["v_read"] = "SELECT DISTINCT check_no, board_id FROM v_checks_seen"
DUCK["v_seen_at"] = """
SELECT r.check_no AS k, p.*, s.card_id, s.list_name, s.title AS card_title, s.archived, s.member, sha256(s.title || chr(0) || s.body)[1:32] AS card_print,
  CASE WHEN p.team IN ('commercial', 'technical', 'operations') THEN upper(substr(p.team, 1, 1)) || substr(p.team, 2) ELSE 'Backlog' END AS planned_list
FROM v_planned p JOIN v_read r ON r.board_id = p.board_id LEFT JOIN v_checks_seen s ON s.check_no = r.check_no AND s.board_id = p.board_id AND s.card_id = p.external_ref WHERE p.external_ref <> ''"""
DUCK["v_found_at"] = """
SELECT k, project_id, task_id, board_id, 'deleted' AS kind FROM v_seen_at WHERE card_id IS NULL
UNION ALL SELECT k, project_id, task_id, board_id, 'archived' FROM v_seen_at WHERE archived
UNION ALL SELECT k, project_id, task_id, board_id, 'moved' FROM v_seen_at WHERE NOT archived AND list_name <> '' AND list_name <> planned_list
UNION ALL SELECT k, project_id, task_id, board_id, 'reassigned' FROM v_seen_at WHERE NOT archived AND account_id <> '' AND member <> account_id
UNION ALL SELECT k, project_id, task_id, board_id, 'edited' FROM v_seen_at WHERE NOT archived AND board_fingerprint <> '' AND card_print <> board_fingerprint"""
# A difference lasts over consecutive readable checks of its board; each run of them is one row.
DUCK["v_watched"] = """
SELECT project_id, task_id, kind, min(k) AS first_seen_at, (SELECT min(r.check_no) FROM v_read r WHERE r.board_id = x.board_id AND r.check_no > max(x.k)) AS resolved_at FROM (
  SELECT f.*, o.n - row_number() OVER (PARTITION BY f.task_id, f.kind ORDER BY f.k) AS run FROM v_found_at f
  JOIN (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY check_no) AS n FROM v_read) o ON o.board_id = f.board_id AND o.check_no = f.k) x
GROUP BY project_id, task_id, kind, board_id, run"""


def snapshot_of(c, check: int):
    t, s, pk = c.view("v_tasks"), F.col("supplier_id"), F.col("part_id")
    named = F.concat(F.upper(F.substring("team", 1, 1)), F.substring("team", F.lit(2), F.length("team")))
    here = F.when(F.col("team").isin("commercial", "technical", "operations"), named).otherwise("Backlog")
    return t.filter((F.col("external_ref") != "") & ((s + check) % 10 != 0) & ((F.col("project_id") + check) % 5 != 0)).select(
        F.lit(check).cast("bigint").alias("check_no"), F.concat(F.lit("B-"), F.col("project_id").cast("string")).alias("board_id"),
        F.col("external_ref").alias("card_id"), F.when((s + check) % 4 == 0, "Done").otherwise(here).alias("list_name"),
        F.when(s % 12 == 0, F.concat("title", F.lit(" (edited)"))).otherwise(F.col("title")).alias("title"),
        F.concat(F.lit("body of "), F.col("task_id").cast("string")).alias("body"), ((pk + check) % 16 == 1).alias("archived"),
        F.when(s % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("acct-"), (s % 90).cast("string")))).alias("members"))


def watcher(c, together: bool = False) -> DriftWatch:
    """The watcher after all checks: one batch each, or all in one as after an outage."""
    home = f"{scratch(c.spark)}/watch-{uuid.uuid4().hex}"
    watch = DriftWatch(c.spark, home, c.view("v_planned"))
    for check in range(1, CHECKS + 1):
        snapshot_of(c, check).write.mode("append").parquet(watch.inbox)
        if not together:
            watch.rescan()
    if together:
        watch.rescan()
    return watch


def watched(c, together: bool = False):
    watch = watcher(c, together)
    return watch.state(watch.last_batch())


@query("stream_drift", "SELECT project_id, task_id, kind, first_seen_at, resolved_at FROM v_watched")
def _(c):
    return watched(c).select("project_id", "task_id", "kind", "first_seen_at", "resolved_at")


@query("stream_board_isolation", """
SELECT w.project_id, w.task_id, w.kind, w.resolved_at IS NULL AS still_open FROM v_watched w
WHERE NOT EXISTS (SELECT 1 FROM v_read r WHERE r.board_id = 'B-' || w.project_id AND r.check_no = 3)""")
def _(c):
    # Boards the last check could not read: what was open before it is open still.
    unread = snapshot_of(c, CHECKS).select("board_id").distinct()
    board_id = F.concat(F.lit("B-"), F.col("project_id").cast("string"))
    return watched(c).withColumn("board_id", board_id).join(unread, "board_id", "left_anti").select(
        "project_id", "task_id", "kind", F.col("resolved_at").isNull().alias("still_open"))


@query("stream_rescan", "SELECT project_id, task_id, kind, first_seen_at FROM v_watched WHERE resolved_at IS NULL AND first_seen_at = 3")
def _(c):
    # What the catch-up check was the first to see.
    return watched(c).filter("fresh").select("project_id", "task_id", "kind", "first_seen_at")


@query("stream_backlog", "SELECT project_id, task_id, kind, first_seen_at, resolved_at FROM v_watched")
def _(c):
    # All checks arrive at once: what came and went between them is told all the same.
    return watched(c, together=True).select("project_id", "task_id", "kind", "first_seen_at", "resolved_at")


@query("stream_board_checked", "SELECT board_id, max(check_no) AS board_checked_at FROM v_read GROUP BY 1")
def _(c):
    watch = watcher(c)
    return watch.boards(watch.last_batch())
