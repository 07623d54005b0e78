"""Dependencies, schedule, calendar and milestones."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions.workdays import (
    add_working_days, next_working_day, parse_date, working_days_between,
)
from planloom.operators import graph, linking, milestones, schedule
from planloom.plans.adapters import DUCK, fold_sql
from planloom.plans.registry import Catalog, query


def duck_next_day(d: str) -> str:
    return f"CAST({d} + CASE isodow({d}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE)"


def duck_add_days(d: str, n: str) -> str:
    """The n-th weekday after d, by listing days one by one."""
    return (
        f"CASE WHEN {n} <= 0 THEN {d} ELSE CAST(list_filter(generate_series({d} + 1, {d} + CAST({n} * 2 + 10 AS INT), "
        f"INTERVAL 1 DAY), lambda x: isodow(x) < 6)[{n}] AS DATE) END"
    )


def duck_between(s: str, e: str) -> str:
    return (
        f"CAST(CASE WHEN {e} <= {s} THEN 0 ELSE len(list_filter(generate_series({s} + 1, {e}, INTERVAL 1 DAY), "
        f"lambda x: isodow(x) < 6)) END AS INT)"
    )


# SQL side: the planted backward dependencies are exactly those that close a cycle, so the
# surviving edges are the forward ones, and the offsets follow by recursion over line numbers.
DUCK["v_edges"] = """
SELECT DISTINCT d.project_id, d.depends_on_id AS src, d.task_id AS dst
FROM v_deps d JOIN v_tasks t ON t.task_id = d.depends_on_id WHERE d.depends_on_id < d.task_id"""
DUCK["v_sized"] = """
SELECT project_id, task_id, ord, title, team,
       CAST(CASE WHEN coalesce(estimated_hours <= 0, true) THEN 1 ELSE greatest(1, ceil(estimated_hours / 8.0)) END AS INT) AS duration_days,
       coalesce(estimated_hours <= 0, true) AS duration_is_assumed
FROM v_tasks"""
DUCK["v_fwd"] = """
SELECT project_id, 0 AS k, 0 AS es, 0 AS f1, 0 AS f2, 0 AS f3 FROM (SELECT DISTINCT project_id FROM v_sized)
UNION ALL
SELECT f.project_id, f.k + 1, greatest(f.f1, f.f3),
       CASE WHEN s.task_id IS NULL THEN 0 ELSE greatest(f.f1, f.f3) + s.duration_days END, f.f1, f.f2
FROM v_fwd f LEFT JOIN v_sized s ON s.project_id = f.project_id AND s.ord = f.k + 1 WHERE f.k < 7"""
DUCK["v_bwd"] = """
SELECT project_id, 8 AS k, 0 AS after, 0 AS b1, 0 AS b2, 0 AS b3 FROM (SELECT DISTINCT project_id FROM v_sized)
UNION ALL
SELECT f.project_id, f.k - 1, greatest(f.b1, f.b3),
       CASE WHEN s.task_id IS NULL THEN 0 ELSE greatest(f.b1, f.b3) + s.duration_days END, f.b1, f.b2
FROM v_bwd f LEFT JOIN v_sized s ON s.project_id = f.project_id AND s.ord = f.k - 1 WHERE f.k > 1"""
DUCK["v_sched"] = """
SELECT s.*, f.es AS early_start, f.f1 AS early_finish, m.project_days, m.project_days - b.after AS late_finish,
       m.project_days - b.after - s.duration_days AS late_start,
       m.project_days - b.after - s.duration_days - f.es AS slack_days
FROM v_sized s JOIN v_fwd f ON f.project_id = s.project_id AND f.k = s.ord
JOIN v_bwd b ON b.project_id = s.project_id AND b.k = s.ord
JOIN (SELECT project_id, max(f1) AS project_days FROM v_fwd GROUP BY 1) m ON m.project_id = s.project_id"""
DUCK["v_dated"] = f"""
SELECT *, {duck_add_days('start_date', '(duration_days - 1)')} AS due_date FROM (
  SELECT s.*, {duck_next_day('p.start_date')} AS project_start,
         {duck_add_days(duck_next_day('p.start_date'), 's.early_start')} AS start_date
  FROM v_sched s JOIN v_projects p USING (project_id))"""
DUCK["v_spans"] = f"""
SELECT p.project_id, CASE WHEN m.project_days IS NULL THEN p.start_date ELSE {duck_next_day('p.start_date')} END AS project_start,
       CASE WHEN m.project_days IS NULL THEN p.start_date
            ELSE {duck_add_days(duck_next_day('p.start_date'), 'greatest(m.project_days - 1, 0)')} END AS project_end,
       coalesce(m.project_days, 0) AS duration_working_days
FROM v_projects p LEFT JOIN (SELECT project_id, max(project_days) AS project_days FROM v_sched GROUP BY 1) m USING (project_id)"""


def edges_of(c: Catalog, deps: str = "v_deps", tasks: str = "v_tasks"):
    """Usable edges with the places of their ends, written once: the search and what it leaves read them."""
    return c.stage(f"edges of {deps}", lambda c: graph.usable_edges(c.view(deps), c.view(tasks)))


def cycles_of(c: Catalog, deps: str = "v_deps", tasks: str = "v_tasks"):
    """(removed edges, steps of their loops), searched once for both."""
    def search(c):
        removed, steps = graph.cycles(edges_of(c, deps, tasks), c.parts)
        # One table for both: a removed edge is the last step of its own loop.
        return steps.unionByName(removed.select("*", F.lit(-1).alias("step"), F.col("src").alias("loop_src"), F.col("dst").alias("loop_dst")))

    both = c.stage(f"cycles of {deps}", search)
    return both.filter("step < 0").select("project_id", "src", "dst"), both.filter("step >= 0")


def removed_edges(c: Catalog):
    return cycles_of(c)[0]


def acyclic_edges(c: Catalog):
    """Read off the edges without what was removed: every query reads it once, so it is not written again."""
    return edges_of(c).join(removed_edges(c), ["project_id", "src", "dst"], "left_anti").select("project_id", "src", "dst")


def placed(c: Catalog):
    return c.stage("placed", lambda c: schedule.offsets(c.view("v_tasks"), acyclic_edges(c), c.parts))


def dated(c: Catalog):
    return schedule.dated(placed(c), c.view("v_projects"))


def spans(c: Catalog):
    return schedule.project_spans(placed(c), c.view("v_projects"))


@query("dep_self", "SELECT project_id, task_id, slot FROM v_deps WHERE task_id = depends_on_id")
def _(c):
    return graph.self_references(c.view("v_deps")).select("project_id", "task_id", "slot")


@query("dep_unknown", """
SELECT project_id, task_id, depends_on_id, slot FROM v_deps
WHERE task_id <> depends_on_id AND depends_on_id NOT IN (SELECT task_id FROM v_tasks)""")
def _(c):
    return graph.unknown_tasks(c.view("v_deps"), c.view("v_tasks")).select("project_id", "task_id", "depends_on_id", "slot")


DUCK["v_removed"] = """
SELECT d.project_id, d.depends_on_id AS src, d.task_id AS dst
FROM v_deps d JOIN v_tasks t ON t.task_id = d.depends_on_id WHERE d.depends_on_id > d.task_id"""


DUCK["v_levels"] = """
SELECT project_id, 0 AS k, -1 AS f1, -1 AS f2, -1 AS f3 FROM (SELECT DISTINCT project_id FROM v_sized)
UNION ALL
SELECT f.project_id, f.k + 1, CASE WHEN s.task_id IS NULL THEN -1 ELSE 1 + greatest(f.f1, f.f3) END, f.f1, f.f2
FROM v_levels f LEFT JOIN v_sized s ON s.project_id = f.project_id AND s.ord = f.k + 1 WHERE f.k < 7"""


@query("dep_topo_level", """
SELECT s.project_id, s.task_id, l.f1 AS topo_level FROM v_sized s JOIN v_levels l ON l.project_id = s.project_id AND l.k = s.ord""")
def _(c):
    nodes = c.view("v_tasks").select("project_id", "task_id", F.lit(1).alias("weight"))
    return graph.longest_paths(nodes, acyclic_edges(c)).select("project_id", "task_id", F.col("before").alias("topo_level"))


@query("dep_of", """
SELECT project_id, dst AS task_id, 'predecessor' AS side, src AS other_id FROM v_edges
UNION ALL SELECT project_id, src, 'successor', dst FROM v_edges""")
def _(c):
    def end(task, side, other):
        return F.struct(F.col(task).alias("task_id"), F.lit(side).alias("side"), F.col(other).alias("other_id"))

    return acyclic_edges(c).select("project_id", F.inline(F.array(end("dst", "predecessor", "src"), end("src", "successor", "dst"))))


@query("sched_duration", "SELECT project_id, task_id, duration_days, duration_is_assumed FROM v_sized")
def _(c):
    return c.view("v_tasks").select(
        "project_id", "task_id", schedule.duration_days(F.col("estimated_hours")).alias("duration_days"),
        schedule.is_assumed(F.col("estimated_hours")).alias("duration_is_assumed"),
    )


@query("sched_forward", "SELECT project_id, task_id, early_start, early_finish FROM v_sched")
def _(c):
    return placed(c).select("project_id", "task_id", "early_start", "early_finish")


@query("sched_backward", "SELECT project_id, task_id, late_start, late_finish FROM v_sched")
def _(c):
    return placed(c).select("project_id", "task_id", "late_start", "late_finish")


@query("sched_slack_critical", """
SELECT project_id, task_id, title, early_start, slack_days, slack_days = 0 AS is_critical FROM v_sched""")
def _(c):
    return placed(c).select("project_id", "task_id", "title", "early_start", "slack_days", "is_critical")


@query("critical_path", """
SELECT project_id, task_id, title, early_start, start_date, due_date, duration_days, duration_is_assumed FROM v_dated WHERE slack_days = 0""")
def critical_path(c):
    return (
        dated(c).filter("is_critical")
        .select("project_id", "task_id", "title", "early_start", "start_date", "due_date", "duration_days", "duration_is_assumed")
        .orderBy("project_id", "early_start", "title")
    )


@query("cal_next_working_day", f"SELECT project_id, {duck_next_day('start_date')} AS working_day FROM v_projects")
def _(c):
    return c.view("v_projects").select("project_id", next_working_day(F.col("start_date")).alias("working_day"))


@query("cal_add_working_days", f"""
SELECT task_id, {duck_add_days('start_date', '(CAST(estimated_hours AS INT) - 5)')} AS moved FROM v_tasks WHERE estimated_hours IS NOT NULL""")
def _(c):
    tasks = c.view("v_tasks").filter(F.col("estimated_hours").isNotNull())
    return tasks.select("task_id", add_working_days(F.col("start_date"), F.col("estimated_hours").cast("int") - 5).alias("moved"))


@query("cal_working_days_between", f"""
SELECT task_id, {duck_between('start_date', 'due_date')} AS forwards, {duck_between('due_date', 'start_date')} AS backwards
FROM v_tasks WHERE due_date IS NOT NULL""")
def _(c):
    s, e = F.col("start_date"), F.col("due_date")
    return c.view("v_tasks").filter(e.isNotNull()).select(
        "task_id", working_days_between(s, e).alias("forwards"), working_days_between(e, s).alias("backwards"))


@query("sched_dates", "SELECT project_id, task_id, project_start, start_date, due_date FROM v_dated")
def _(c):
    return dated(c).select("project_id", "task_id", "project_start", "start_date", "due_date")


@query("sched_span", "SELECT * FROM v_spans")
def _(c):
    return spans(c)


@query("sched_breach", """
SELECT s.project_id, CAST(s.project_end - p.go_live_date AS INT) AS overrun_days,
       'Schedule ends ' || s.project_end || ', ' || (s.project_end - p.go_live_date) || ' day(s) past the SOW date of ' || p.go_live_date || '.' AS deadline_breach
FROM v_spans s JOIN v_projects p USING (project_id) WHERE s.project_end > p.go_live_date""")
def _(c):
    return schedule.breaches(spans(c), c.view("v_projects").withColumnRenamed("go_live_date", "deadline"))


@query("sched_estimate_coverage", """
SELECT p.project_id, coalesce(1.0 - CAST(g AS DOUBLE) / n, 1.0) AS estimate_coverage, coalesce(g, 0) AS assumed_tasks
FROM v_projects p LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE duration_is_assumed) AS g FROM v_sized GROUP BY 1) c USING (project_id)""")
def _(c):
    return schedule.estimate_coverage(c.view("v_tasks"), c.view("v_projects"))


@query("sched_assumed_tasks", "SELECT project_id, task_id, title, team FROM v_sized WHERE duration_is_assumed")
def _(c):
    return c.view("v_tasks").filter(schedule.is_assumed(F.col("estimated_hours"))).select("project_id", "task_id", "title", "team")


# Dates as documents spell them, one spelling per project, some of them no date at all.
DUCK["v_date_texts"] = """
SELECT project_id, CASE project_id % 6 WHEN 0 THEN strftime(start_date, '%Y-%m-%d') WHEN 1 THEN strftime(start_date, '%d/%m/%Y')
  WHEN 2 THEN strftime(start_date, '%-d %B %Y') WHEN 3 THEN strftime(start_date, '%B %-d, %Y')
  WHEN 4 THEN strftime(start_date, '%-d %b %Y') ELSE 'not stated' END AS spelled, start_date FROM v_projects"""


def date_texts(c):
    d = F.col("start_date")
    kinds = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy"]
    spelled = F.lit("not stated")
    for i, pattern in enumerate(kinds):
        spelled = F.when(F.col("project_id") % 6 == i, F.date_format(d, pattern)).otherwise(spelled)
    return c.view("v_projects").select("project_id", spelled.alias("spelled"), "start_date")


@query("date_parse_multi", """
SELECT project_id, spelled, CASE WHEN project_id % 6 = 5 THEN NULL ELSE start_date END AS parsed FROM v_date_texts""")
def _(c):
    return date_texts(c).select("project_id", "spelled", parse_date(F.col("spelled")).alias("parsed"))


@query("sched_deadline", """
SELECT p.project_id, coalesce(p.go_live_date, CASE WHEN d.project_id % 6 < 5 THEN d.start_date END) AS deadline
FROM v_projects p JOIN v_date_texts d USING (project_id)""")
def _(c):
    assumed = date_texts(c).select(
        "project_id", F.lit("SCHEDULE").alias("category"), F.lit("A-001").alias("assumption_key"), F.col("spelled").alias("value"))
    return schedule.deadlines(c.view("v_projects"), assumed)


@query("sched_slack_list", "SELECT project_id, task_id, title, slack_days FROM v_sched WHERE slack_days > 0")
def _(c):
    return (
        placed(c).filter("slack_days > 0").select("project_id", "task_id", "title", "slack_days")
        .orderBy("project_id", F.desc("slack_days"))
    )


@query("sched_timeline_view", """
SELECT s.project_id, s.project_start, s.project_end, s.duration_working_days, p.go_live_date AS deadline,
       coalesce(s.project_end > p.go_live_date, false) AS breached,
       coalesce(c.critical, 0) AS critical_tasks, coalesce(c.slack, 0) AS slack_tasks, coalesce(1.0 - CAST(c.g AS DOUBLE) / c.n, 1.0) AS estimate_coverage
FROM v_spans s JOIN v_projects p USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE duration_is_assumed) AS g, count(*) FILTER (WHERE slack_days = 0) AS critical,
                  count(*) FILTER (WHERE slack_days > 0) AS slack FROM v_sched GROUP BY 1) c USING (project_id)""")
def _(c):
    counts = placed(c).groupBy("project_id").agg(
        F.count_if("is_critical").alias("critical"), F.count_if(F.col("slack_days") > 0).alias("slack"),
        (1.0 - F.count_if("duration_is_assumed") / F.count(F.lit(1))).alias("covered"))
    return (
        spans(c).join(c.view("v_projects").select("project_id", F.col("go_live_date").alias("deadline")), "project_id")
        .join(counts, "project_id", "left")
        .select(
            "project_id", "project_start", "project_end", "duration_working_days", "deadline",
            F.coalesce(F.col("project_end") > F.col("deadline"), F.lit(False)).alias("breached"),
            F.coalesce("critical", F.lit(0)).alias("critical_tasks"), F.coalesce("slack", F.lit(0)).alias("slack_tasks"),
            F.coalesce("covered", F.lit(1.0)).alias("estimate_coverage"),
        )
    )


# Milestones ------------------------------------------------------------------------------

DUCK["v_ms_links"] = f"""
SELECT t.project_id, t.task_id, m.milestone_id FROM v_tasks t JOIN
 (SELECT project_id, {fold_sql('name')} AS k, max_by(milestone_id, pos) AS milestone_id FROM v_milestones GROUP BY 1, 2) m
 ON m.project_id = t.project_id AND m.k = {fold_sql('t.milestone')} WHERE t.milestone <> ''"""
DUCK["v_ms"] = """
SELECT m.*, p.projected_date, coalesce(p.n, 0) AS task_count, CAST(p.projected_date - m.target_date AS INT) AS variance_days,
       CASE WHEN p.projected_date - m.target_date IS NULL THEN 'unscheduled' WHEN p.projected_date - m.target_date > 0 THEN 'late'
            WHEN p.projected_date - m.target_date < -10 THEN 'early' ELSE 'on_track' END AS status
FROM v_milestones m LEFT JOIN (
  SELECT l.milestone_id, max(d.due_date) AS projected_date, count(*) AS n FROM v_ms_links l JOIN v_dated d ON d.task_id = l.task_id GROUP BY 1) p
USING (milestone_id)"""
DUCK["v_ms_detail"] = """
SELECT project_id, milestone_id, name, pos, target_date, projected_date, variance_days, status,
  CASE WHEN projected_date IS NULL THEN name || ': no scheduled task covers this milestone'
       WHEN target_date IS NULL THEN name || ': the SOW gives no date to check against'
       WHEN variance_days > 0 THEN name || ': plan ends ' || projected_date || ', ' || variance_days || ' day(s) past the agreed ' || target_date
       WHEN variance_days < 0 THEN name || ': plan ends ' || projected_date || ', ' || (-variance_days) || ' day(s) before the agreed ' || target_date
       ELSE name || ': plan ends ' || projected_date || ', exactly as agreed' END AS detail FROM v_ms"""
DUCK["v_ms_steps"] = f"""
SELECT *, CAST(greatest(allowed_days - planned_days, 0) AS INT) AS unaccounted_days,
       CASE WHEN allowed_days > 0 THEN CAST(planned_days AS DOUBLE) / allowed_days END AS coverage,
       CASE WHEN allowed_days <= 0 THEN name || ': the SOW gives no working days for this step (' || w || '), so it cannot be compared'
            ELSE name || ': the SOW allows ' || allowed_days || ' working day(s) ' || w || ', the plan uses ' || planned_days END AS detail
FROM (SELECT project_id, milestone_id, pos, name, target_date, coalesce(pn, '') AS after,
        CASE WHEN pn IS NULL THEN 'from kickoff' ELSE 'after ' || pn END AS w,
        {duck_between('coalesce(pt, kickoff)', 'target_date')} AS allowed_days, {duck_between('coalesce(pp, kickoff)', 'projected_date')} AS planned_days
  FROM (SELECT m.*, p.start_date AS kickoff, lag(m.target_date) OVER w AS pt, lag(m.projected_date) OVER w AS pp, lag(m.name) OVER w AS pn
        FROM v_ms m JOIN v_projects p USING (project_id) WHERE m.target_date IS NOT NULL AND m.projected_date IS NOT NULL
        WINDOW w AS (PARTITION BY m.project_id ORDER BY m.target_date, m.pos)))"""


def milestone_links(c):
    return linking.milestone_links(c.view("v_tasks"), c.view("v_milestones"))


def milestones_projected(c):
    return c.by_project(lambda c: milestones.project(c.view("v_milestones"), milestone_links(c), dated(c)))


def milestone_checks(c):
    return milestones.checked(milestones_projected(c))


def milestone_steps(c):
    return c.by_project(lambda c: milestones.segments(milestone_checks(c), c.view("v_projects"), whole=bool(c.parts)))


@query("ms_project", "SELECT project_id, milestone_id, name, target_date, projected_date, task_count FROM v_ms")
def _(c):
    return milestones_projected(c).select(
        "project_id", "milestone_id", "name", "target_date", "projected_date", "task_count")


@query("ms_variance", "SELECT milestone_id, variance_days FROM v_ms")
def _(c):
    return milestone_checks(c).select("milestone_id", "variance_days")


@query("ms_status", "SELECT milestone_id, status FROM v_ms")
def _(c):
    return milestone_checks(c).select("milestone_id", "status")


@query("ms_detail", "SELECT milestone_id, detail FROM v_ms_detail")
def _(c):
    return milestone_checks(c).select("milestone_id", "detail")


@query("ms_summary", """
SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status = 'late') AS late, count(*) FILTER (WHERE status = 'early') AS early,
       count(*) FILTER (WHERE status = 'unscheduled') AS unscheduled, count(*) FILTER (WHERE status = 'on_track') AS on_track FROM v_ms GROUP BY 1""")
def _(c):
    return milestones.summary(milestone_checks(c))


@query("ms_messages", """
SELECT project_id, CASE status WHEN 'late' THEN 'breach' ELSE 'warning' END AS level,
       CASE status WHEN 'late' THEN 1 WHEN 'early' THEN 2 ELSE 3 END AS rank, pos, detail FROM v_ms_detail WHERE status <> 'on_track'""")
def _(c):
    return milestones.messages(milestone_checks(c))


@query("ms_segments", "SELECT project_id, milestone_id, name, after, allowed_days, planned_days, detail FROM v_ms_steps")
def _(c):
    return milestone_steps(c).select("project_id", "milestone_id", "name", "after", "allowed_days", "planned_days", "detail")


@query("ms_segment_metrics", "SELECT milestone_id, unaccounted_days, coverage FROM v_ms_steps")
def _(c):
    return milestone_steps(c).select("milestone_id", "unaccounted_days", "coverage")


DUCK["v_ms_totals"] = """
SELECT project_id, count(*) AS segments, CAST(sum(allowed_days) AS BIGINT) AS allowed_days, CAST(sum(planned_days) AS BIGINT) AS planned_days,
       CAST(greatest(sum(allowed_days) - sum(planned_days), 0) AS BIGINT) AS unaccounted_days,
       CASE WHEN sum(allowed_days) <> 0 THEN CAST(sum(planned_days) AS DOUBLE) / sum(allowed_days) END AS coverage
FROM v_ms_steps GROUP BY 1"""


@query("ms_calibration", "SELECT * FROM v_ms_totals")
def _(c):
    return milestones.calibration(milestone_steps(c))


@query("ms_widest_gaps", """
SELECT project_id, CAST(r AS INT) AS gap_rank, unaccounted_days, detail FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY unaccounted_days DESC, target_date, pos) AS r FROM v_ms_steps WHERE unaccounted_days > 0)
WHERE r <= 3""")
def _(c):
    return milestones.widest_gaps(milestone_steps(c))


@query("ms_verdict", """
SELECT milestone_id, CASE WHEN coverage IS NULL THEN 'no window to compare' WHEN coverage < 0.6 THEN 'likely underestimated'
       WHEN coverage > 1.0 THEN 'needs more time than agreed' ELSE 'fits' END AS verdict FROM v_ms_steps""")
def _(c):
    return milestone_steps(c).select("milestone_id", milestones.verdict().alias("verdict"))


@query("view_milestones", "SELECT project_id, name, target_date, projected_date, variance_days, status, detail FROM v_ms_detail")
def _(c):
    return milestone_checks(c).select("project_id", "name", "target_date", "projected_date", "variance_days", "status", "detail")
