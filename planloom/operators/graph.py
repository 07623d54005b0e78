"""Dependency graphs of all projects at once, as edge tables.

tasks(project_id, task_id, ord, ...); deps(project_id, task_id, depends_on_id, edge_ord).
Work flows from `src` (the dependency) to `dst` (the dependent).

Schedules and cycles of small projects are solved whole. Larger ones are peeled from their roots for their schedule (see peel()): a task is
final once, and an edge carries one value once. Their cycles are looked for by rounds of joins over the stretches that can hold one; several
rounds are planned in one job, and between jobs the state is written to the checkpoint folder, so
neither the lineage nor the number of jobs grows with each round.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.operators import windows
from planloom.session import discard, drop_bucketed, scratch, stored, stored_bucketed

ROUNDS_PER_JOB = 4
# Links of a hub task travel in shares of about so many.
LINKS_A_SHARE = 10_000
# Projects of at most so many tasks and links are solved whole by one task of the job.
WHOLE = 100_000
# Insertion order is gone through in pieces of so many places.
STRETCH = 50_000


def self_references(deps: DataFrame) -> DataFrame:
    return deps.filter(F.col("task_id") == F.col("depends_on_id"))


def unknown_tasks(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    known = tasks.select("project_id", F.col("task_id").alias("depends_on_id"))
    return deps.filter(F.col("task_id") != F.col("depends_on_id")).join(
        known, ["project_id", "depends_on_id"], "left_anti"
    )


def usable_edges(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distinct (project_id, src, dst) between different, known tasks."""
    src = tasks.select("project_id", F.col("task_id").alias("src"), F.col("ord").alias("src_ord"))
    dst = tasks.select("project_id", F.col("task_id").alias("dst"), F.col("ord").alias("dst_ord"))
    return (
        deps.filter(F.col("task_id") != F.col("depends_on_id"))
        .select("project_id", F.col("depends_on_id").alias("src"), F.col("task_id").alias("dst"))
        .distinct()
        .join(src, ["project_id", "src"])
        .join(dst, ["project_id", "dst"])
    )


def _spread(state: DataFrame, links: DataFrame) -> DataFrame:
    """Spread the least value along links, with how many links it has come, until nothing changes.

    state(project_id, fwd, task_id, value); links(project_id, fwd, task_id, to). Returns the state with
    `least`, a pair of value and distance. Every task gets a link to itself, so a round is one join and
    one aggregation with map-side combine, and refers to the state once: rounds can be chained in a
    plan of linear size. Joins are left to adaptive execution, which splits the links of a hub task.
    """
    keys = ["project_id", "fwd", "task_id"]
    own = state.select(*keys, F.col("task_id").alias("to"), F.lit(0).alias("add"))
    steps = stored(links.withColumn("add", F.lit(1)).unionByName(own))
    state = state.select(*keys, F.struct("value", F.lit(0).alias("far")).alias("least"))
    last, changed = None, 1
    while changed:
        for _ in range(ROUNDS_PER_JOB):
            come = F.struct(F.col("least.value").alias("value"), (F.col("least.far") + F.col("add")).alias("far"))
            state = (
                state.select(*keys, "least").join(steps, keys)
                .groupBy("project_id", "fwd", F.col("to").alias("task_id"))
                .agg(F.min(come).alias("least"), F.max(F.when(F.col("add") == 0, F.col("least"))).alias("last"))
            )
        seen = Observation()
        state = stored(state.observe(seen, F.count_if(F.col("least") != F.col("last")).alias("n")))
        changed = seen.get["n"]
        if last is not None:
            discard(last)
        last = state
    discard(steps)
    return state.drop("last")


def _shares(links: Column) -> Column:
    return F.greatest(F.ceil(links / LINKS_A_SHARE), F.lit(1)).cast("int")


def _share_of(end: Column, links: Column) -> Column:
    return F.pmod(F.xxhash64(end), _shares(links)).cast("int")


def peel(nodes: DataFrame, edges: DataFrame, told: list | None = None) -> DataFrame:
    """(project_id, fwd, task_id, value): the heaviest work before each task (fwd) and after it (not fwd),
    in rounds from the tasks without links upwards.

    nodes(project_id, task_id, weight), edges(project_id, src, dst). A round joins only the tasks that
    became final in the last one with their links; a task is final when all links into it have spoken.
    Links are bucketed once by the task they leave, a hub's in shares, so that rounds do not shuffle
    them: what moves in all rounds together is one value per link, summed per task before it moves, and a
    row per round for tasks that wait for others. Rounds are as many as the longest chain has tasks.

    told: gets (tasks final, tasks waiting) of every round. Raises ValueError where the edges hold a cycle.
    """
    spark = nodes.sparkSession
    ends = edges.select("project_id", F.col("dst").alias("task_id"), F.lit(1).alias("ins"), F.lit(0).alias("outs")).union(
        edges.select("project_id", F.col("src").alias("task_id"), F.lit(0).alias("ins"), F.lit(1).alias("outs")))
    degrees = ends.groupBy("project_id", "task_id").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
    known = stored(nodes.select("project_id", "task_id", "weight").join(degrees, ["project_id", "task_id"], "left").na.fill(0, ["ins", "outs"]))

    def of(end: str) -> DataFrame:
        return known.select("project_id", F.col("task_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("weight", "ins", "outs")))

    full = edges.select("project_id", "src", "dst").join(of("src"), ["project_id", "src"]).join(of("dst"), ["project_id", "dst"])

    def link(fwd: bool, a: str, b: str, into: str, out: str) -> DataFrame:
        return full.select(
            "project_id", F.lit(fwd).alias("fwd"), F.col(a).alias("task_id"), _share_of(F.col(b), F.col(f"{a}_{out}")).alias("share"),
            F.col(b).alias("to"), F.col(f"{a}_weight").alias("add"), F.col(f"{b}_{into}").alias("need"), _shares(F.col(f"{b}_{out}")).alias("shares"),
        )

    keys = ["project_id", "fwd", "task_id", "share"]
    links = stored_bucketed(link(True, "src", "dst", "ins", "outs").union(link(False, "dst", "src", "outs", "ins")), keys)
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"

    def kept(rows: DataFrame, number: int) -> tuple[DataFrame, int, int]:
        seen = Observation()
        final = F.col("heard") == F.col("need")
        path = f"{folder}/round={number}"
        rows.observe(seen, F.count_if(final).alias("final"), F.count_if(~final).alias("waiting")).write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), seen.get["final"], seen.get["waiting"]

    both = known.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"))
    roots = both.filter(F.when(F.col("fwd"), F.col("ins")).otherwise(F.col("outs")) == 0).select(
        "project_id", "fwd", "task_id", F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("heard"),
        F.lit(0).cast("long").alias("need"), _shares(F.when(F.col("fwd"), F.col("outs")).otherwise(F.col("ins"))).alias("shares"),
    )
    state, final, waiting = kept(roots, 0)
    schema, settled, rounds = state.schema, final, 0
    while final:
        if told is not None:
            told.append((final, waiting))
        front = state.filter("heard = need").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        said = front.select(*keys, "value").join(links, keys).select(
            "project_id", "fwd", F.col("to").alias("task_id"), (F.col("value") + F.col("add")).alias("value"),
            F.lit(1).cast("long").alias("heard"), F.col("need").cast("long").alias("need"), "shares")
        # Waiting rows are a task each already; only what is new is summed before it moves.
        heard = said.union(state.filter("heard < need")).groupBy("project_id", "fwd", "task_id").agg(
            F.max("value").alias("value"), F.sum("heard").alias("heard"), F.max("need").alias("need"), F.max("shares").alias("shares"))
        rounds += 1
        state, final, waiting = kept(heard.select(*schema.names), rounds)
        settled += final
    drop_bucketed(links)
    if settled != 2 * known.count():
        raise ValueError("the edges hold a cycle: some tasks wait for each other")
    discard(known)
    return spark.read.schema(schema).parquet(*(f"{folder}/round={k}" for k in range(rounds + 1))).filter("heard = need").select(
        "project_id", "fwd", "task_id", "value")


def _in_stretches(edges: DataFrame) -> DataFrame:
    """The edges with both ends in one stretch of insertion order that backward steps cover.

    A cycle comes back from its last task to its first by backward steps that overlap or touch, so it lies
    within one stretch of them. An edge is in a stretch if it ends no later than the last stretch that
    starts no later than the edge does.
    """
    lo, hi = F.least("src_ord", "dst_ord").alias("_lo"), F.greatest("src_ord", "dst_ord").alias("_hi")
    place, key = windows.by_width(F.col("_lo"), STRETCH), ["project_id"]
    back = stored(edges.filter(F.col("src_ord") >= F.col("dst_ord")).groupBy("project_id", F.col("dst_ord").alias("_lo")).agg(F.max("src_ord").alias("_hi")))
    begun = windows.running_max_before(back, key, place, [F.col("_lo")], F.col("_hi"), "_top")
    first = F.when(F.col("_top") >= F.col("_lo"), 0).otherwise(1)
    numbered = windows.running_sum(begun, key, place, [F.col("_lo")], first, "_number")
    stretches = numbered.groupBy("project_id", "_number").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_end"))
    asked = edges.join(back.select("project_id").distinct(), "project_id", "left_semi").select(
        "project_id", "src", "dst", "src_ord", "dst_ord", lo, hi, F.lit(1).alias("_edge"))
    both = asked.unionByName(stretches.select("project_id", "_lo", "_end", F.lit(0).alias("_edge")), allowMissingColumns=True)
    met = windows.running_max_before(both, key, place, [F.col("_lo"), F.col("_edge")], F.col("_end"), "_top")
    return met.filter((F.col("_edge") == 1) & (F.col("_hi") <= F.col("_top"))).select("project_id", "src", "dst", "src_ord", "dst_ord")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """One edge per cycle: within each strongly connected part, those entering its earliest task.

    A cycle must step back in insertion order somewhere, and its steps back cover all of the stretch
    it lies in, so only the stretches that overlapping backward steps make up are looked at, each by
    itself (see _in_stretches()). There, each task learns the
    lowest task that reaches it and the lowest task it reaches. Tasks on one cycle agree in
    both, so edges between tasks that differ are set aside. A task that is its own lowest,
    entered from a task it reaches, closes a cycle. The rest is searched again.
    """
    return cycles(edges)[0]


def cycles(edges: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """cycle_edges(), and the loop that each of them closes, as rows (project_id, src, dst, step, loop_src,
    loop_dst): steps 0, 1, ... lead from the edge's end back to its start by the fewest edges of what is left
    in that search, over the earlier task where two are as near; the last step is the edge itself.

    Projects with a step back and at most WHOLE edges are moved once and searched whole; larger ones are
    searched by all tasks together (see _cycles_by_joins()). parts: the edges lie by project in so many parts,
    and are searched there.
    """
    kinds = dict(edges.dtypes)
    back = stored(edges.filter(F.col("src_ord") >= F.col("dst_ord")).select("project_id").distinct())  # so that its size is known
    asked = edges.select("project_id", "src", "dst", "src_ord", "dst_ord").join(back, "project_id", "left_semi")
    asked = asked if parts else stored(asked)
    large = stored(asked.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("project_id"))
    some = not large.isEmpty()
    small = asked.join(large, "project_id", "left_anti") if some else asked
    order = ["src_ord", "dst_ord"]
    small = _lying(small, order) if parts else small.repartition("project_id").sortWithinPartitions("project_id", *order)
    steps = stored(small.mapInArrow(
        _search, f"project_id {kinds['project_id']}, src {kinds['src']}, dst {kinds['dst']}, step int, loop_src {kinds['src']}, loop_dst {kinds['dst']}"))
    removed = steps.filter("loop_src = src AND loop_dst = dst").select("project_id", "src", "dst")
    if some:
        theirs = _cycles_by_joins(asked.join(large, "project_id", "left_semi"))
        removed, steps = removed.unionByName(theirs[0]), steps.unionByName(theirs[1])
    return removed, steps


def _lying(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in order, each project in one task, of rows that lie by project. A window asks for that, where a
    repartition is dropped with buckets that then nothing seems to need."""
    return rows.withColumn("_at", F.row_number().over(W.partitionBy("project_id").orderBy(*order)))


def _reached(links: dict, order: dict) -> dict:
    """For each task the lowest order that reaches it along links, and over how many of them."""
    found: dict = {}
    for place, same in groupby(sorted(order, key=order.get), key=order.get):
        front, far = [task for task in same if task not in found], 0
        while front:
            found.update((task, (place, far)) for task in front)
            front, far = list(dict.fromkeys(to for task in front for to in links[task] if to not in found)), far + 1
    return found


def _loops_of(core: list[tuple]) -> list[tuple]:
    """The steps (src, dst, step, loop_src, loop_dst) of the cycles of one project's edges (src, dst, src_ord, dst_ord)."""
    steps = []
    while core:
        order, ahead, behind, before = {}, defaultdict(list), defaultdict(list), {}
        for src, dst, src_ord, dst_ord in core:
            order[src], order[dst] = src_ord, dst_ord
            ahead[src].append(dst)
            behind[dst].append(src)
        come, go = _reached(ahead, order), _reached(behind, order)
        alike = [e for e in core if come[e[0]][0] == come[e[1]][0] and go[e[0]][0] == go[e[1]][0]]
        for src, dst, src_ord, _ in alike:
            if come[src][1] == come[dst][1] - 1 and (dst not in before or src_ord < order[before[dst]]):
                before[dst] = src
        for src, dst, _, dst_ord in core:
            if come[src][0] == come[dst][0] == dst_ord:
                steps.append((src, dst, come[src][1], src, dst))
                at = src
                while come[at][1] and at in before:
                    steps.append((src, dst, come[at][1] - 1, before[at], at))
                    at = before[at]
        # Edges into and out of a part's earliest task go; what is left of the part is searched again.
        core = [e for e in alike if come[e[1]][0] != e[3] and come[e[0]][0] != e[2]]
    return steps


def _search(batches):
    """Batches sorted by project: the steps of the loops of each whole project."""
    kinds = []

    def rows():
        for batch in batches:
            kinds[:] = batch.schema.types
            yield from zip(*(column.to_pylist() for column in batch.columns[:5]))

    def told(steps):
        project, task = kinds[0], kinds[1]
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*steps), [project, task, task, pa.int32(), task, task])]
        return pa.RecordBatch.from_arrays(arrays, names=["project_id", "src", "dst", "step", "loop_src", "loop_dst"])

    held = []
    for project, edges in groupby(rows(), key=lambda row: row[0]):
        held.extend((project, *step) for step in _loops_of([edge[1:] for edge in edges]))
        if len(held) >= 10_000:
            yield told(held)
            held = []
    if held:
        yield told(held)


def _cycles_by_joins(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cycles() of projects of any size, every round over the edges of all of them together."""
    core = stored(_in_stretches(edges))
    columns = core.columns
    parts, closings = [], []
    while not core.isEmpty():
        turn = F.lit(len(parts)).alias("turn")
        marked = stored(_marked(core))
        agree = (F.col("src_from") == F.col("dst_from")) & (F.col("src_to") == F.col("dst_to"))
        into_root = F.col("dst_from") == F.col("dst_ord")
        out_of_root = F.col("src_from") == F.col("src_ord")
        closings.append(marked.filter(into_root & (F.col("src_from") == F.col("dst_ord"))).select("project_id", "src", "dst", "src_far", turn))
        parts.append(marked.filter(agree).select("project_id", "src", "dst", "src_ord", "src_far", "dst_far", turn))
        core = marked.filter(agree & ~into_root & ~out_of_root).select(*columns)
    if not parts:
        removed = core.select("project_id", "src", "dst")
        return removed, removed.select("*", F.lit(0).alias("step"), F.col("src").alias("loop_src"), F.col("dst").alias("loop_dst"))
    closing = stored(reduce(DataFrame.unionByName, closings))
    return closing.select("project_id", "src", "dst"), _loops(reduce(DataFrame.unionByName, parts), closing)


def _loops(edges: DataFrame, closing: DataFrame) -> DataFrame:
    """The loops of the closing edges, of all turns of the search together.

    The lowest order of a part comes from its root, so a task's distance is that from the root, and the
    task before it on a shortest way is the earliest one that is one edge nearer. From the start of a
    closing edge tasks 1, 2, 4, ... steps back are reached by jumps that double in length, so a loop of n
    tasks is complete after log n joins.
    """
    place = ["project_id", "turn", "at"]
    back = stored(edges.filter(F.col("src_far") == F.col("dst_far") - 1).groupBy("project_id", "turn", F.col("dst").alias("at")).agg(
        F.min_by("src", "src_ord").alias("before")))
    # Jumps of tasks nearer to the root than a jump is long lead nowhere and end.
    walks = stored(closing.select("project_id", "turn", "src", "dst", F.col("src").alias("at"), F.col("src_far").alias("step")))
    jumps, length = back, 1
    most = closing.agg(F.max("src_far")).first()[0]
    while length <= most:
        on = walks.join(jumps, place).select("project_id", "turn", "src", "dst", F.col("before").alias("at"), (F.col("step") - length).alias("step"))
        walks = stored(walks.unionByName(on))
        length *= 2
        if length <= most:
            further = jumps.select("project_id", "turn", F.col("at").alias("_at"), F.col("before").alias("at")).join(jumps, place)
            jumps = stored(further.select("project_id", "turn", F.col("_at").alias("at"), "before"))
    # Every task of a walk but the root with the edge that leads to it, and the closing edge.
    into = walks.filter("step > 0").join(back, place).select(
        "project_id", "src", "dst", (F.col("step") - 1).alias("step"), F.col("before").alias("loop_src"), F.col("at").alias("loop_dst"))
    return into.unionByName(closing.select("project_id", "src", "dst", F.col("src_far").alias("step"), F.col("src").alias("loop_src"), F.col("dst").alias("loop_dst")))


def _marked(core: DataFrame) -> DataFrame:
    """Edges with, for either end, the lowest order that reaches it (`from`, over so many edges: `far`) and
    that it reaches (`to`)."""
    ends = core.select("project_id", F.col("src").alias("task_id"), F.col("src_ord").alias("value")).union(
        core.select("project_id", F.col("dst").alias("task_id"), F.col("dst_ord").alias("value"))
    ).distinct()
    state = ends.select("project_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"), "task_id", "value")
    links = core.select("project_id", F.lit(True).alias("fwd"), F.col("src").alias("task_id"), F.col("dst").alias("to")).union(
        core.select("project_id", F.lit(False).alias("fwd"), F.col("dst").alias("task_id"), F.col("src").alias("to")))
    lowest = stored(_spread(state, links).groupBy("project_id", "task_id").agg(
        F.max(F.when(F.col("fwd"), F.col("least"))).alias("reached"),
        F.max(F.when(~F.col("fwd"), F.col("least.value"))).alias("reaches_to"),
    ))

    def at(end: str) -> DataFrame:
        return lowest.select("project_id", F.col("task_id").alias(end), F.col("reached.value").alias(f"{end}_from"),
                             F.col("reached.far").alias(f"{end}_far"), F.col("reaches_to").alias(f"{end}_to"))

    return core.join(at("src"), ["project_id", "src"]).join(at("dst"), ["project_id", "dst"])


def clean_edges(deps: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acyclic edges, removed cycle edges)."""
    edges = usable_edges(deps, tasks)
    removed = cycle_edges(edges)
    kept = edges.join(removed, ["project_id", "src", "dst"], "left_anti")
    return kept.select("project_id", "src", "dst"), removed


def issues(deps: DataFrame, tasks: DataFrame, removed: DataFrame, steps: DataFrame) -> DataFrame:
    """(project_id, kind, src, dst, detail) of everything that was dropped. The detail of a cycle names the
    removed edge and how many tasks are on its loop; the loop itself is rows of cycles()."""
    own = self_references(deps).select(
        "project_id", F.lit("self_reference").alias("kind"),
        F.col("depends_on_id").alias("src"), F.col("task_id").alias("dst"),
        F.concat(F.col("task_id").cast("string"), F.lit(" depends on itself")).alias("detail"),
    )
    ghost = unknown_tasks(deps, tasks).select(
        "project_id", F.lit("unknown_task").alias("kind"),
        F.col("depends_on_id").alias("src"), F.col("task_id").alias("dst"),
        F.concat(
            F.col("task_id").cast("string"), F.lit(" depends on unknown task "),
            F.col("depends_on_id").cast("string"),
        ).alias("detail"),
    )
    sizes = steps.groupBy("project_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    loop = removed.join(sizes, ["project_id", "src", "dst"]).select(
        "project_id", F.lit("cycle").alias("kind"), "src", "dst",
        F.concat(
            F.lit("circular dependency of "), F.col("n").cast("string"), F.lit(" tasks; removed "), F.col("src").cast("string"), F.lit(" -> "),
            F.col("dst").cast("string"),
        ).alias("detail"),
    )
    return own.unionByName(ghost).unionByName(loop)


def _waves(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n tasks with links a -> b: the heaviest work before each, and which wait for each other for ever."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts, need, value = np.searchsorted(a, np.arange(n + 1)), np.bincount(b, minlength=n), np.zeros(n, np.int64)
    front = np.flatnonzero(need == 0)
    while len(front):
        count = starts[front + 1] - starts[front]
        out = np.repeat(starts[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
        to = b[out]
        np.maximum.at(value, to, value[a[out]] + weight[a[out]])
        np.subtract.at(need, to, 1)
        reached = np.unique(to)
        front = reached[need[reached] == 0]
    return value, need > 0


def _solved(rows: pa.Table) -> pa.RecordBatch:
    """Paths of whole projects: rows(project_id, task_id, to, weight, linked), tasks and links in one."""
    linked = rows["linked"].to_numpy()
    place = rows["project_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    ids = pa.concat_arrays([rows["task_id"].combine_chunks(), rows["to"].combine_chunks()]).dictionary_encode(null_encoding="encode")
    names = ids.indices.to_numpy().astype(np.int64)
    first, second = (place * len(ids.dictionary) + part for part in np.split(names, 2))
    tasks, at, number = np.unique(first[~linked], return_index=True, return_inverse=True)
    weight = np.zeros(len(tasks), np.int64)
    np.maximum.at(weight, number, rows["weight"].to_numpy()[~linked])
    src, dst = (np.minimum(np.searchsorted(tasks, x[linked]), len(tasks) - 1) for x in (first, second))
    if len(src) and not ((tasks[src] == first[linked]).all() and (tasks[dst] == second[linked]).all()):
        raise ValueError("a link of a task that is not there")
    before, stuck = _waves(len(tasks), src, dst, weight)
    after, _ = _waves(len(tasks), dst, src, weight)
    kept = rows.select(["project_id", "task_id"]).take(pa.array(np.flatnonzero(~linked)[at])).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [kept["project_id"].combine_chunks(), kept["task_id"].combine_chunks(), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(stuck)],
        names=["project_id", "task_id", "before", "after", "stuck"])


def _solve(batches):
    """Batches sorted by project: each project is solved with all others that end in the same batch."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not len(rows):
            continue
        project = rows["project_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        begun = int(np.searchsorted(project, project[-1]))  # places are numbered as they come
        if begun:
            yield _solved(rows.slice(0, begun))
        rest = rows.slice(begun)
    if rest is not None and len(rest):
        yield _solved(rest)


def longest_paths(nodes: DataFrame, edges: DataFrame, told: list | None = None, parts: int | None = None) -> DataFrame:
    """For each task, the heaviest work `before` it and `after` it, both in one loop.

    nodes(project_id, task_id, weight), edges(project_id, src, dst), acyclic and each once. Projects of at
    most WHOLE tasks and links are moved once and solved whole, thousands in a batch; larger ones are
    peeled by all tasks together (see peel()), and so is every one where told asks for the rounds. parts: both
    lie by project in so many parts, every task in a project that one task can hold; the paths are written in the same parts.
    """
    if told is not None:
        return _peeled(nodes, edges, told)
    kinds = dict(nodes.select("project_id", "task_id").dtypes)
    edges = edges.select("project_id", "src", "dst").dropna()
    items = (nodes.select("project_id", "task_id", F.lit(None).cast(kinds["task_id"]).alias("to"), F.col("weight").cast("bigint").alias("weight"), F.lit(False).alias("linked"))
                   .union(edges.select("project_id", "src", "dst", F.lit(0).cast("bigint"), F.lit(True))))
    if parts:
        some, dealt = False, _lying(items, ["linked"])
    else:
        items = stored(items)
        large = stored(items.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > WHOLE) & F.col("project_id").isNotNull()).select("project_id"))
        some = not large.isEmpty()
        small = items.join(large, "project_id", "left_anti") if some else items
        # Tasks of no project have no links; they are dealt out by themselves.
        dealt = small.repartition(
            F.coalesce(F.xxhash64("project_id"), F.lit(0)), F.when(F.col("project_id").isNull(), F.col("task_id"))).sortWithinPartitions("project_id")
    seen = Observation()
    solved = dealt.mapInArrow(
        _solve, f"project_id {kinds['project_id']}, task_id {kinds['task_id']}, before int, after int, stuck boolean")
    solved = solved.observe(seen, F.count_if("stuck").alias("n")).drop("stuck")
    solved = stored_bucketed(solved, ["project_id"], parts) if parts else stored(solved)
    if seen.get["n"]:
        raise ValueError("the edges hold a cycle: some tasks wait for each other")
    if some:
        theirs = items.join(large, "project_id", "left_semi")
        solved = solved.unionByName(_peeled(
            theirs.filter("NOT linked").select("project_id", "task_id", "weight"),
            theirs.filter("linked").select("project_id", F.col("task_id").alias("src"), F.col("to").alias("dst")), None))
    return solved


def _peeled(nodes: DataFrame, edges: DataFrame, told: list | None) -> DataFrame:
    return peel(nodes, edges, told).groupBy("project_id", "task_id").agg(
        F.max(F.when(F.col("fwd"), F.col("value"))).cast("int").alias("before"),
        F.max(F.when(~F.col("fwd"), F.col("value"))).cast("int").alias("after"),
    )
