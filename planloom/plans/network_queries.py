"""Dependency loops, and schedules of large projects with long chains and a hub.

v_net_tasks reads orders as the tasks of thirty projects, one of which holds a third of all rows. In a
project, tasks are chains of forty, with short cuts; some chains hold a loop, some a loop inside a
larger one; in the large project every chain hangs on one hub task. The SQL side searches the loops
itself: who reaches whom, parts in which tasks reach each other, and again on what is left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.operators import graph, schedule
from planloom.plans.adapters import ADAPTERS, DUCK
from planloom.plans.registry import query
from planloom.plans.schedule_queries import cycles_of, edges_of

ADAPTERS["v_net_tasks"] = """
SELECT project_id, task_id, ord, stride, CAST(floor(task_id / stride) AS BIGINT) AS place, 'Task ' || CAST(task_id AS STRING) AS title,
       CASE WHEN who % 3 = 0 THEN 'commercial' ELSE 'technical' END AS team,
       CASE WHEN who % 11 = 0 THEN NULL ELSE CAST(1 + who % 30 AS DOUBLE) END AS estimated_hours
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_orderkey % 29 END AS project_id, o_orderkey AS task_id, o_orderkey AS ord,
             CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 87 END AS stride, o_custkey AS who FROM orders) o"""

_SLOTS = {
    1: ("task_id - stride", "place % 40 <> 0"),
    2: ("task_id - 2 * stride", "place % 40 >= 2 AND place % 5 = 0"),
    3: ("task_id + 3 * stride", "place % 40 = 10 AND lot % 7 = 0"),
    4: ("task_id + 6 * stride", "place % 40 = 9 AND lot % 14 = 0"),
    5: ("CAST(0 AS BIGINT)", "project_id = 0 AND place % 40 = 0 AND task_id <> 0"),
}
_LOTS = "(SELECT *, CAST(floor(place / 40) AS BIGINT) + task_id % stride AS lot FROM v_net_tasks) t"
DUCK["v_net_deps"] = "\nUNION ALL ".join(
    f"SELECT project_id, task_id, {k} AS slot, {other} AS depends_on_id, ord * 10 + {k} AS edge_ord FROM {_LOTS} WHERE {when}"
    for k, (other, when) in _SLOTS.items())
_CASES = ", ".join(f"CASE WHEN {when} THEN {k} END" for k, (_, when) in _SLOTS.items())
ADAPTERS["v_net_deps"] = f"""
SELECT project_id, task_id, slot, CASE slot {' '.join(f'WHEN {k} THEN {other}' for k, (other, _) in _SLOTS.items())} END AS depends_on_id,
       ord * 10 + slot AS edge_ord
FROM {_LOTS} LATERAL VIEW explode(filter(array({_CASES}), x -> x IS NOT NULL)) s AS slot"""


def searched(prefix: str, deps: str, tasks: str, rounds: int, longest: int) -> None:
    """Views on the SQL side: {prefix}_cut, the removed edges, and {prefix}_steps, their loops."""
    DUCK[f"{prefix}_e0"] = f"""
SELECT * FROM (SELECT DISTINCT d.project_id, d.depends_on_id AS src, d.task_id AS dst FROM {deps} d
  JOIN {tasks} t ON t.task_id = d.depends_on_id AND t.project_id = d.project_id WHERE d.depends_on_id <> d.task_id)"""
    for k in range(rounds):
        e, n = f"{prefix}_e{k}", f"{prefix}_{k}"
        DUCK[f"{prefix}_in{k}"] = f"SELECT * FROM {e} WHERE (project_id, src) IN (SELECT (project_id, dst) FROM {e}) AND (project_id, dst) IN (SELECT (project_id, src) FROM {e})"
        DUCK[f"{prefix}_reach{k}"] = f"""
SELECT project_id, src AS a, dst AS b FROM {prefix}_in{k}
UNION SELECT r.project_id, r.a, i.dst FROM {prefix}_reach{k} r JOIN {prefix}_in{k} i ON i.project_id = r.project_id AND i.src = r.b"""
        DUCK[f"{n}_root"] = f"""
SELECT x.project_id, x.a AS task_id, min(x.b) AS root FROM {prefix}_reach{k} x JOIN {prefix}_reach{k} y ON y.project_id = x.project_id AND y.a = x.b AND y.b = x.a
GROUP BY 1, 2"""
        DUCK[f"{n}_part"] = f"""
SELECT i.project_id, i.src, i.dst, p.root FROM {prefix}_in{k} i JOIN {n}_root p ON p.project_id = i.project_id AND p.task_id = i.src
JOIN {n}_root q ON q.project_id = i.project_id AND q.task_id = i.dst AND q.root = p.root"""
        DUCK[f"{n}_walk"] = f"""
SELECT project_id, root, root AS task_id, 0 AS far FROM {n}_root
UNION SELECT w.project_id, w.root, p.dst, w.far + 1 FROM {n}_walk w JOIN {n}_part p ON p.project_id = w.project_id AND p.src = w.task_id WHERE w.far < {longest}"""
        DUCK[f"{n}_far"] = f"SELECT project_id, root, task_id, min(far) AS far FROM {n}_walk GROUP BY 1, 2, 3"
        DUCK[f"{n}_came"] = f"""
SELECT f.project_id, f.task_id, f.far, min(p.src) AS came FROM {n}_far f JOIN {n}_part p ON p.project_id = f.project_id AND p.dst = f.task_id
JOIN {n}_far g ON g.project_id = f.project_id AND g.task_id = p.src AND g.far = f.far - 1 GROUP BY 1, 2, 3"""
        DUCK[f"{n}_back"] = f"""
SELECT project_id, src, dst, src AS at FROM {n}_part WHERE dst = root
UNION SELECT b.project_id, b.src, b.dst, c.came FROM {n}_back b JOIN {n}_came c ON c.project_id = b.project_id AND c.task_id = b.at"""
        DUCK[f"{n}_steps"] = f"""
SELECT p.project_id, p.src, p.dst, f.far AS step, p.src AS loop_src, p.dst AS loop_dst FROM {n}_part p
JOIN {n}_far f ON f.project_id = p.project_id AND f.task_id = p.src WHERE p.dst = p.root
UNION ALL SELECT b.project_id, b.src, b.dst, c.far - 1, c.came, c.task_id FROM {n}_back b JOIN {n}_came c ON c.project_id = b.project_id AND c.task_id = b.at"""
        DUCK[f"{prefix}_e{k + 1}"] = f"SELECT project_id, src, dst FROM {n}_part WHERE dst <> root AND src <> root"
    DUCK[f"{prefix}_cut"] = " UNION ALL ".join(f"SELECT project_id, src, dst FROM {prefix}_{k}_part WHERE dst = root" for k in range(rounds))
    DUCK[f"{prefix}_steps"] = " UNION ALL ".join(f"SELECT project_id, src, dst, CAST(step AS INTEGER) AS step, loop_src, loop_dst FROM {prefix}_{k}_steps" for k in range(rounds))


searched("v_loop", "v_deps", "v_tasks", 6, 8)
searched("v_netloop", "v_net_deps", "v_net_tasks", 3, 9)


@query("dep_cycles", "SELECT project_id, src, dst FROM v_loop_cut")
def _(c):
    return cycles_of(c)[0].select("project_id", "src", "dst")


@query("dep_loops", "SELECT * FROM v_loop_steps")
def _(c):
    return cycles_of(c)[1]


def net_cycles(c):
    return cycles_of(c.store("v_net_tasks"), "v_net_deps", "v_net_tasks")


def net_edges(c):
    def build(c):
        removed = net_cycles(c)[0]
        edges = edges_of(c, "v_net_deps", "v_net_tasks")
        return edges.join(removed, ["project_id", "src", "dst"], "left_anti").select("project_id", "src", "dst")

    return c.stage("net_edges", build)


@query("dep_cycles_networks", "SELECT * FROM v_netloop_cut")
def _(c):
    return net_cycles(c)[0]


@query("dep_loops_networks", "SELECT * FROM v_netloop_steps")
def _(c):
    return net_cycles(c)[1]


DUCK["v_net_edges"] = "SELECT * FROM v_netloop_e0 WHERE (project_id, src, dst) NOT IN (SELECT (project_id, src, dst) FROM v_netloop_cut)"
DUCK["v_net_sized"] = """
SELECT project_id, task_id, title, coalesce(estimated_hours <= 0, true) AS duration_is_assumed,
       CAST(CASE WHEN coalesce(estimated_hours <= 0, true) THEN 1 ELSE greatest(1, ceil(estimated_hours / 8.0)) END AS INT) AS days FROM v_net_tasks"""
# All distinct lengths of ways into a task, and out of it.
DUCK["v_net_before"] = """
SELECT project_id, task_id, 0 AS v, 0 AS level FROM v_net_sized
UNION SELECT b.project_id, e.dst, b.v + s.days, b.level + 1 FROM v_net_before b JOIN v_net_edges e ON e.project_id = b.project_id AND e.src = b.task_id
JOIN v_net_sized s ON s.task_id = b.task_id"""
DUCK["v_net_after"] = """
SELECT project_id, task_id, 0 AS v FROM v_net_sized
UNION SELECT b.project_id, e.src, b.v + s.days FROM v_net_after b JOIN v_net_edges e ON e.project_id = b.project_id AND e.dst = b.task_id
JOIN v_net_sized s ON s.task_id = b.task_id"""


@query("dep_topo_level_networks", "SELECT project_id, task_id, max(level) AS topo_level FROM v_net_before GROUP BY 1, 2")
def _(c):
    nodes = c.view("v_net_tasks").select("project_id", "task_id", F.lit(1).alias("weight"))
    return graph.longest_paths(nodes, net_edges(c)).select("project_id", "task_id", F.col("before").alias("topo_level"))


@query("sched_offsets_networks", """
SELECT s.project_id, s.task_id, b.v AS early_start, b.v + s.days AS early_finish, m.n - a.v - s.days AS late_start, m.n - a.v AS late_finish,
       m.n - a.v - s.days - b.v AS slack_days, m.n - a.v - s.days = b.v AS is_critical
FROM v_net_sized s JOIN (SELECT project_id, task_id, max(v) AS v FROM v_net_before GROUP BY 1, 2) b USING (project_id, task_id)
JOIN (SELECT project_id, task_id, max(v) AS v FROM v_net_after GROUP BY 1, 2) a USING (project_id, task_id)
JOIN (SELECT b.project_id, max(b.v + s.days) AS n FROM v_net_before b JOIN v_net_sized s USING (task_id) GROUP BY 1) m USING (project_id)""")
def _(c):
    placed = c.stage("net_placed", lambda c: schedule.offsets(c.view("v_net_tasks"), net_edges(c)))
    return placed.select("project_id", "task_id", "early_start", "early_finish", "late_start", "late_finish", "slack_days", "is_critical")
