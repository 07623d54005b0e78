"""Hand-computed cases for graphs, schedules, calendar and milestones."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from planloom.functions.workdays import add_working_days, next_working_day, parse_date, working_days_between
from planloom.operators import graph, milestones, schedule, staffing, windows

MONDAY = date(2026, 10, 5)


def plan(spark, hours, deps, project=1):
    """Tasks named by letter in the order given; deps as (task, depends on)."""
    order = {name: i for i, name in enumerate(hours)}
    tasks = spark.createDataFrame(
        [(project, n, order[n], n, "technical", float(h) if h is not None else None) for n, h in hours.items()],
        "project_id int, task_id string, ord int, title string, team string, estimated_hours double")
    edges = spark.createDataFrame(
        [(project, t, d, order[t] * 10 + i) for i, (t, d) in enumerate(deps)],
        "project_id int, task_id string, depends_on_id string, edge_ord int")
    return tasks, edges


def scheduled(spark, hours, deps, start=MONDAY):
    tasks, edges = plan(spark, hours, deps)
    kept, _ = graph.clean_edges(edges, tasks)
    starts = spark.createDataFrame([(1, start)], "project_id int, start_date date")
    placed = schedule.offsets(tasks, kept)
    return {r.task_id: r for r in schedule.dated(placed, starts).collect()}, schedule.project_spans(placed, starts).first()


def removed(spark, names, deps):
    tasks, edges = plan(spark, {n: 8 for n in names}, deps)
    return {(r.src, r.dst) for r in graph.cycle_edges(graph.usable_edges(edges, tasks)).collect()}


def test_chain(spark):
    rows, span = scheduled(spark, {"A": 16, "B": 16, "C": 16}, [("B", "A"), ("C", "B")])
    assert (rows["A"].start_date, rows["A"].due_date) == (date(2026, 10, 5), date(2026, 10, 6))
    assert rows["B"].start_date == date(2026, 10, 7)
    assert span.project_end == date(2026, 10, 12) and span.duration_working_days == 6
    assert all(r.slack_days == 0 for r in rows.values())


def test_diamond(spark):
    rows, span = scheduled(spark, {"A": 8, "B": 8, "C": 32, "D": 8}, [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C")])
    assert span.duration_working_days == 6
    assert rows["B"].slack_days == 3
    assert {n for n, r in rows.items() if r.is_critical} == {"A", "C", "D"}


def test_durations(spark):
    df = spark.createDataFrame([(1.0,), (8.0,), (9.0,), (16.0,), (40.0,), (0.0,), (-4.0,), (None,)], "h double")
    got = df.select(schedule.duration_days(F.col("h")).alias("d"), schedule.is_assumed(F.col("h")).alias("a")).collect()
    assert [r.d for r in got] == [1, 1, 2, 2, 5, 1, 1, 1]
    assert [r.a for r in got] == [False] * 5 + [True] * 3


def test_weekend_start_and_empty_project(spark):
    rows, _ = scheduled(spark, {"A": 8}, [], start=date(2026, 10, 3))
    assert rows["A"].start_date == MONDAY
    starts = spark.createDataFrame([(2, date(2026, 10, 3))], "project_id int, start_date date")
    tasks, _ = plan(spark, {"A": 8}, [])
    placed = schedule.offsets(tasks, spark.createDataFrame([], "project_id int, src string, dst string"))
    span = schedule.project_spans(placed, starts).first()
    assert span.project_end == date(2026, 10, 3) and span.duration_working_days == 0
    assert schedule.estimate_coverage(tasks, starts).first().estimate_coverage == 1.0


def test_self_ghost_and_cycles(spark):
    tasks, deps = plan(spark, {"A": 8}, [("A", "A"), ("A", "GHOST")])
    assert graph.self_references(deps).count() == 1
    assert graph.unknown_tasks(deps, tasks).count() == 1
    assert removed(spark, "ABC", [("A", "C"), ("B", "A"), ("C", "B")]) == {("C", "A")}
    # The same ring listed the other way round: still one edge, the one into the first task.
    assert removed(spark, "ABC", [("A", "B"), ("B", "C"), ("C", "A")]) == {("B", "A")}
    assert len(removed(spark, "ABCD", [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")])) == 2
    assert removed(spark, "ABCD", [("B", "A"), ("C", "B"), ("D", "C")]) == set()


def test_cycles_against_brute_force(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        names = [f"N{i:02d}" for i in range(14)]
        deps = list({(rng.choice(names), rng.choice(names)) for _ in range(26)})
        tasks, edges = plan(spark, {n: 8 for n in names}, deps)
        usable = graph.usable_edges(edges, tasks)
        gone = {(r.src, r.dst) for r in graph.cycle_edges(usable).collect()}
        left = {(d, t) for t, d in deps if t != d} - gone
        after = {n: {d for s, d in left if s == n} for n in names}
        reach = {n: set(after[n]) for n in names}
        for _ in names:
            for n in names:
                reach[n] |= set().union(*(reach[m] for m in reach[n])) if reach[n] else set()
        assert all(n not in reach[n] for n in names), "a cycle is left"
        # Only edges that close a cycle go.
        full = {n: {t for t, d in deps if d == n and t != d} for n in names}
        reach = {n: set(full[n]) for n in names}
        for _ in names:
            for n in names:
                reach[n] |= set().union(*(reach[m] for m in reach[n])) if reach[n] else set()
        assert all(s in reach[d] for s, d in gone)


def test_schedule_respects_dependencies(spark):
    import random

    rng = random.Random(3)
    names = [f"N{i:02d}" for i in range(30)]
    deps = [(names[i], names[rng.randrange(i)]) for i in range(1, 30) for _ in range(2)]
    hours = {n: rng.choice([None, 4, 8, 17, 40]) for n in names}
    rows, span = scheduled(spark, hours, deps)
    for task, dependency in deps:
        assert rows[task].early_start >= rows[dependency].early_finish
    assert all(r.slack_days >= 0 for r in rows.values())
    assert max(r.early_finish for r in rows.values()) == span.duration_working_days


def test_calendar(spark):
    def by_hand(day, n):
        while n > 0:
            day += timedelta(days=1)
            n -= day.weekday() < 5
        return day

    rows = [(MONDAY + timedelta(days=i), n) for i in range(9) for n in range(-2, 13)]
    df = spark.createDataFrame(rows, "d date, n int")
    for r in df.select("d", "n", add_working_days(F.col("d"), F.col("n")).alias("x"), next_working_day(F.col("d")).alias("w")).collect():
        assert r.x == by_hand(r.d, r.n)
        assert r.w.weekday() < 5 and 0 <= (r.w - r.d).days <= 2
    pairs = spark.createDataFrame([(MONDAY, date(2026, 10, 12)), (MONDAY, MONDAY), (date(2026, 10, 9), date(2026, 10, 5))], "s date, e date")
    assert [r[0] for r in pairs.select(working_days_between(F.col("s"), F.col("e"))).collect()] == [5, 0, 0]


def test_dates(spark):
    texts = ["2026-10-05", "5/10/2026", "5 October 2026", "October 5, 2026", "5 Oct 2026", "soon", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_date(F.col("t"))).collect()] == [MONDAY] * 5 + [None] * 2


def test_milestones(spark):
    rows = [
        (1, "a", 1, date(2026, 11, 10), date(2026, 11, 20), "late", 10), (1, "b", 2, date(2026, 11, 10), date(2026, 10, 5), "early", -36),
        (1, "c", 3, date(2026, 11, 10), date(2026, 11, 5), "on_track", -5), (1, "d", 4, date(2026, 11, 10), date(2026, 11, 10), "on_track", 0),
        (1, "e", 5, date(2026, 11, 10), date(2026, 10, 31), "on_track", -10), (1, "f", 6, date(2026, 11, 10), None, "unscheduled", None),
        (1, "g", 7, None, date(2026, 10, 5), "unscheduled", None),
    ]
    df = spark.createDataFrame(rows, "project_id int, name string, pos int, target_date date, projected_date date, want string, days int")
    for r in df.withColumn("got", milestones.status()).withColumn("v", milestones.variance_days()).collect():
        assert (r.got, r.v) == (r.want, r.days)


def test_calibration(spark):
    df = spark.createDataFrame(
        [(1, 1, "Contract", 1, date(2026, 10, 1), date(2026, 10, 1)), (1, 2, "Integration", 2, date(2026, 11, 10), date(2026, 10, 14))],
        "project_id int, milestone_id int, name string, pos int, target_date date, projected_date date")
    starts = spark.createDataFrame([(1, date(2026, 10, 1))], "project_id int, start_date date")
    step = milestones.segments(df, starts).filter("name = 'Integration'").first()
    assert (step.allowed_days, step.planned_days, step.after) == (28, 9, "Contract")


def clashes(spark, rows):
    df = spark.createDataFrame(
        [(1, "Sam", i, f"T{i}", date(2026, 10, s), date(2026, 10, d), i) for i, (s, d) in enumerate(rows)],
        "project_id int, owner string, task_id int, title string, start_date date, due_date date, ord int")
    return sorted((r.first_task_id, r.second_task_id, r.overlap_days) for r in staffing.overlaps(df).collect())


def test_staffing_overlaps(spark):
    assert clashes(spark, [(1, 20), (15, 25)]) == [(0, 1, 6)]
    assert clashes(spark, [(1, 30), (3, 4), (20, 22)]) == [(0, 1, 28), (0, 2, 11)]
    assert clashes(spark, [(1, 5), (6, 9)]) == []
    assert clashes(spark, [(1, 5), (5, 9)]) == [(0, 1, 1)]


def test_bucketed_windows_equal_plain_ones(spark):
    """One group over many buckets gives what an undivided window gives."""
    from pyspark.sql import Window as W

    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 37 % 500).alias("o"), (F.col("id") * 91 % 101).alias("v"))
    order, bucket, w = [F.col("o")], windows.by_width(F.col("o"), 20), W.partitionBy("k").orderBy("o")
    cases = [
        (windows.row_number(df, ["k"], bucket, order, "x"), F.row_number().over(w)),
        (windows.running_sum(df, ["k"], bucket, order, F.col("v"), "x"), F.sum("v").over(w).cast("int")),
        (windows.running_max_before(df, ["k"], bucket, order, F.col("v"), "x"), F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1))),
        (windows.lag(df, ["k"], bucket, order, F.col("v"), "x"), F.lag("v").over(w)),
    ]
    for got, want in cases:
        assert sorted(map(tuple, got.select("k", "o", "x").collect()), key=str) == sorted(
            map(tuple, df.withColumn("x", want).select("k", "o", "x").collect()), key=str)


def test_longest_paths_of_a_cycle_end_with_an_error(spark):
    import pytest

    names = list("ABC")
    nodes = spark.createDataFrame([(1, n, 8) for n in names], "project_id int, task_id string, weight int")
    ring = spark.createDataFrame([(1, "A", "B"), (1, "B", "C"), (1, "C", "A")], "project_id int, src string, dst string")
    with pytest.raises(ValueError):
        graph.longest_paths(nodes, ring)


def test_loops_are_named_step_by_step(spark):
    tasks, edges = plan(spark, {n: 8 for n in "ABCDEF"}, [("B", "A"), ("C", "B"), ("D", "C"), ("A", "D"), ("D", "B"), ("F", "E"), ("E", "F")])
    gone, steps = graph.cycles(graph.usable_edges(edges, tasks))
    assert {(r.src, r.dst) for r in gone.collect()} == {("D", "A"), ("F", "E")}
    rows = sorted((r.src, r.dst, r.step, r.loop_src, r.loop_dst) for r in steps.collect())
    # From A back to A over the short cut B -> D.
    assert rows == [("D", "A", 0, "A", "B"), ("D", "A", 1, "B", "D"), ("D", "A", 2, "D", "A"), ("F", "E", 0, "E", "F"), ("F", "E", 1, "F", "E")]
    details = {r.detail for r in graph.issues(edges, tasks, gone, steps).filter("kind = 'cycle'").collect()}
    assert "circular dependency of 3 tasks; removed D -> A" in details
    none = graph.cycles(graph.usable_edges(edges.filter("task_id = 'B'"), tasks))
    assert none[0].count() == none[1].count() == 0


def test_loops_of_random_graphs_are_loops(spark):
    import random

    rng = random.Random(9)
    names = [f"N{i:02d}" for i in range(16)]
    deps = list({(rng.choice(names), rng.choice(names)) for _ in range(40)})
    tasks, edges = plan(spark, {n: 8 for n in names}, deps)
    gone, steps = graph.cycles(graph.usable_edges(edges, tasks))
    loops = {}
    for r in steps.collect():
        loops.setdefault((r.src, r.dst), {})[r.step] = (r.loop_src, r.loop_dst)
    assert set(loops) == {(r.src, r.dst) for r in gone.collect()} and loops
    for edge, walk in loops.items():
        walk = [walk[k] for k in range(len(walk))]
        assert walk[-1] == edge and walk[0][0] == edge[1]
        assert all((b, a) in deps for a, b in walk)
        assert all(x[1] == y[0] for x, y in zip(walk, walk[1:], strict=False))


def test_peeling_moves_each_task_once_and_splits_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_A_SHARE", 7)
    nodes = spark.createDataFrame([(1, k, 1 + k % 3) for k in range(120)], "project_id int, task_id int, weight int")
    pairs = [(0, k) for k in range(1, 120)] + [(k, k + 1) for k in range(1, 30)] + [(k, 119) for k in range(40, 100)]
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "project_id int, src int, dst int")
    told = []
    found = {r.task_id: (r.before, r.after) for r in graph.longest_paths(nodes, edges, told).collect()}
    before, after = {}, {}
    for t in range(120):
        before[t] = max((before[a] + 1 + a % 3 for a, b in pairs if b == t), default=0)
    for t in reversed(range(120)):
        after[t] = max((after[b] + 1 + b % 3 for a, b in pairs if a == t), default=0)
    assert found == {t: (before[t], after[t]) for t in range(120)}
    assert sum(final for final, _ in told) == 240 and len(told) == 31


def test_buckets_of_even_depth(spark):
    """One owner, project and month hold a third of the rows: no bucket holds twice the median of the others."""
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).alias("project_id"),
        F.when(F.col("id") % 3 == 0, (F.col("id") * 7919) % 2_592_000).otherwise(F.col("id") * 1000).alias("o"), "id")
    cut = windows.by_depth(rows, ["project_id"], F.col("o"), "part", rows=300, most=100)
    sizes = cut.groupBy("project_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("a"), F.max("o").alias("b"))
    hot = sorted((r.part, r.n, r.a, r.b) for r in sizes.filter("project_id = 1").collect())
    assert len(hot) == 10 and max(n for _, n, _, _ in hot) < 2 * sorted(n for _, n, _, _ in hot)[5]
    assert all(x[3] < y[2] for x, y in zip(hot, hot[1:], strict=False))
    assert sizes.filter("project_id <> 1 AND part <> 0").count() == 0
    got = windows.row_number(cut, ["project_id"], F.col("part"), [F.col("o"), F.col("id")], "n")
    from pyspark.sql import Window as W

    want = rows.withColumn("n", F.row_number().over(W.partitionBy("project_id").orderBy("o", "id")))
    assert got.select("id", "n").exceptAll(want.select("id", "n")).count() == 0


def test_only_stretches_of_backward_steps_are_searched(spark, monkeypatch):
    monkeypatch.setattr(graph, "STRETCH", 7)
    n = 200
    steps = [(k, k + 1) for k in range(n)] + [(12, 10), (11, 9), (100, 96), (90, 150), (160, 160), (190, 185)]
    edges = spark.createDataFrame([(p, a, b, a, b) for p in (1, 2) for a, b in steps], "project_id int, src int, dst int, src_ord int, dst_ord int")
    got = {(r.project_id, r.src, r.dst) for r in graph._in_stretches(edges).collect()}
    inside = [range(9, 13), range(96, 101), range(160, 161), range(185, 191)]
    assert got == {(p, a, b) for p in (1, 2) for a, b in steps if any(a in s and b in s for s in inside)}
    cut = {(r.src, r.dst) for r in graph.cycle_edges(edges.filter("project_id = 1 AND src <> dst")).collect()}
    assert cut == {(11, 9), (12, 10), (100, 96), (190, 185)}


def test_small_projects_are_solved_whole_and_large_ones_peeled_alike(spark, monkeypatch):
    rnd = random.Random(5)
    nodes, edges = [(None, 1, 4), (None, 1, 4), (None, 2, 1)], [(None, 1, 2)]
    for project in range(60):
        size = rnd.randrange(1, 40)
        nodes += [(project, t, rnd.randrange(1, 9)) for t in range(size)]
        edges += [(project, a, b) for a in range(size) for b in range(a + 1, size) if rnd.random() < 0.1]
    nodes = spark.createDataFrame(nodes, "project_id bigint, task_id bigint, weight int")
    edges = spark.createDataFrame(edges, "project_id bigint, src bigint, dst bigint")

    def got(told=None):
        return sorted(map(tuple, graph.longest_paths(nodes, edges, told).collect()), key=str)

    peeled = got([])
    monkeypatch.setattr(graph, "peel", None)
    assert got() == peeled
    monkeypatch.undo()
    monkeypatch.setattr(graph, "WHOLE", 50)
    assert got() == peeled


def test_cycles_of_whole_projects_are_those_found_by_joins(spark, monkeypatch):
    rng = random.Random(11)
    rows = {(p, rng.randrange(6), rng.randrange(6)) for p in range(30) for _ in range(rng.choice([5, 12]))}
    # A loop that only a detour through another one closes, and both directions between neighbours.
    rows |= {(90, a, b) for k in range(3) for a, b in ((k, k + 1), (k + 1, k))} | {(91, 0, 5), (91, 5, 7), (91, 7, 5), (91, 7, 0)}
    edges = spark.createDataFrame(
        [(p, a, b, 10 * a, 10 * b) for p, a, b in sorted(rows) if a != b], "project_id long, src long, dst long, src_ord int, dst_ord int")
    found = []
    for most, joined in ((100, False), (5, True)):
        seen = []
        by_joins = graph._cycles_by_joins
        monkeypatch.setattr(graph, "WHOLE", most)
        monkeypatch.setattr(graph, "_cycles_by_joins", lambda e, by_joins=by_joins: (seen.append(1), by_joins(e))[1])
        gone, steps = graph.cycles(edges)
        assert bool(seen) is joined
        found.append((sorted(map(tuple, gone.collect())), sorted(map(tuple, steps.collect()))))
        monkeypatch.undo()
    assert found[0][0] and found[0] == found[1]
