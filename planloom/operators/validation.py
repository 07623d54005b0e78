"""The validation report: stages over whole tables, offenders as rows.

Each stage yields offenders(project_id, stage, item). A project passes a stage it has no
offender in. Offenders stay rows: a project with millions of them never becomes one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.text import blank, has_digit, mentions_any

VERSION = "v1"
STAGES = [
    "schema", "grounding", "evidence", "business_rules", "dependencies", "timeline", "milestones", "staffing",
    "derived_artifacts",
]


def offending(df: DataFrame, stage: str, item: str | Column) -> DataFrame:
    item = F.col(item) if isinstance(item, str) else item
    return df.select("project_id", F.lit(stage).alias("stage"), item.cast("string").alias("item")).distinct()


def schema(tasks: DataFrame) -> DataFrame:
    return offending(tasks.filter(blank(F.col("title")) | ~F.col("team").isin(vocab.TEAMS)), "schema", "task_id")


def grounding(scored: DataFrame) -> DataFrame:
    return offending(scored.filter("status = 'reject'"), "grounding", "task_id")


def evidence(missing: DataFrame) -> DataFrame:
    return offending(missing, "evidence", "task_id")


def signalled_teams(title: Column, description: Column) -> Column:
    text = F.lower(F.concat(title, F.lit(" "), description))
    hits = F.array(*[F.when(mentions_any(text, words), team) for team, words in vocab.TEAM_SIGNALS.items()])
    return F.filter(hits, lambda t: t.isNotNull())


def business_rules(tasks: DataFrame) -> DataFrame:
    """The wording points at exactly one team, and it is not the task's."""
    marked = tasks.withColumn("teams", signalled_teams(F.col("title"), F.col("description")))
    wrong = marked.filter((F.size("teams") == 1) & (F.get("teams", F.lit(0)) != F.col("team")))
    return offending(wrong, "business_rules", "task_id")


def dependencies(issues: DataFrame, tasks: DataFrame, unsourced: DataFrame) -> DataFrame:
    """Any fault in its graph marks every task of a project; so does an explicit arrow that cites nothing its own."""
    broken = tasks.join(issues.select("project_id").distinct(), "project_id", "left_semi")
    return offending(broken.select("project_id", "task_id").union(unsourced.select("project_id", "task_id")), "dependencies", "task_id")


def late(dated: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Tasks that end after their project's deadline."""
    due = dated.select("project_id", "task_id", "due_date").join(deadlines.select("project_id", "deadline"), "project_id")
    return due.filter(F.col("due_date") > F.col("deadline"))


def timeline(dated: DataFrame, deadlines: DataFrame) -> DataFrame:
    return offending(late(dated, deadlines), "timeline", "task_id")


def milestones(checks: DataFrame) -> DataFrame:
    return offending(checks.filter("status = 'late'"), "milestones", "milestone_id")


def staffing(overlaps: DataFrame) -> DataFrame:
    both = overlaps.select("project_id", F.explode(F.array("first_task_id", "second_task_id")).alias("task_id"))
    return offending(both, "staffing", "task_id")


def derived(stories: DataFrame, criteria: DataFrame, cases: DataFrame, tasks: DataFrame) -> DataFrame:
    """(project_id, rule, item) of the nine checks on derived artifacts.

    stories(project_id, story_key, kind, requirement_id, task_id, delivery_side, technical_notes,
    notes_keys, source_key); criteria(story_key, criterion_key, measure, source_key);
    cases(story_key, case_key, expected_result, assumed_fields). '' and NULL links are no links.
    """
    keys = ["project_id", "story_key"]
    no_link = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    has = lambda flag: F.coalesce(F.col(flag), F.lit(False))

    def broken(df: DataFrame, item: str, rules: dict[str, Column]) -> DataFrame:
        """Every row's broken rules, from one pass over the rows."""
        names = F.filter(F.array(*[F.when(when, name) for name, when in rules.items()]), lambda name: name.isNotNull())
        return df.select("project_id", F.explode(names).alias("rule"), F.col(item).alias("item"))

    with_criteria = criteria.select(*keys, F.lit(True).alias("_criteria")).distinct()
    sourced = stories.filter(~no_link("source_key")).select(*keys, F.lit(True).alias("_sourced")).distinct()
    rejected = tasks.filter(F.col("validation_status").isin("reject", "unsupported")).select(
        "project_id", "task_id", F.lit(True).alias("_rejected")).distinct()
    engineer = F.col("kind") == "engineer"
    of_stories = broken(stories.join(with_criteria, keys, "left").join(rejected, ["project_id", "task_id"], "left"), "story_key", {
        "story_without_requirement": ~engineer & no_link("requirement_id"),
        "engineer_story_without_task": engineer & no_link("task_id"),
        "story_without_criteria": ~has("_criteria"),
        "story_from_delivery_side": ~engineer & F.col("delivery_side"),
        "notes_uncited": (F.col("technical_notes") != "") & no_link("notes_keys"),
        "criteria_of_rejected_task": engineer & has("_rejected") & has("_criteria"),
    })
    of_criteria = broken(criteria, "criterion_key", {"threshold_uncited": (F.col("measure") != "") & no_link("source_key")})
    of_cases = broken(cases.join(sourced, keys, "left"), "case_key", {
        "case_without_story": no_link("story_key"),
        "number_unexplained": has_digit(F.col("expected_result")) & (F.col("assumed_fields") == "") & ~has("_sourced"),
    })
    return of_stories.unionByName(of_criteria).unionByName(of_cases)


#: Stages whose offenders are tasks: the bits of a task's marks.
MARKED = ["schema", "grounding", "evidence", "business_rules", "dependencies", "timeline", "staffing"]


def _bit(stage: str) -> int:
    return 1 << MARKED.index(stage)


def marks(tasks: DataFrame, found: dict[str, DataFrame], broken_projects: DataFrame, parts: int | None = None) -> DataFrame:
    """(project_id, task_id, marks): for every task a bit for each stage it offends, in one aggregation.

    What a task's own row tells is marked in one pass over the tasks; found holds, by stage, the tasks
    (project_id, task_id) that other tables tell of. A fault in a project's graph marks all its tasks. parts: marks
    are dealt out by project into so many, where those of a project can meet in one task.
    """
    hits = signalled_teams(F.col("title"), F.col("description"))
    wrong = (F.size("teams") == 1) & (F.get("teams", F.lit(0)) != F.col("team"))
    own = tasks.withColumn("teams", hits).select("project_id", "task_id", F.lit(True).alias("known"), (
        F.when(blank(F.col("title")) | ~F.col("team").isin(vocab.TEAMS), _bit("schema")).otherwise(0)
        .bitwiseOR(F.when(wrong, _bit("business_rules")).otherwise(0))).alias("marks"))
    for stage, rows in found.items():
        own = own.unionByName(rows.select("project_id", "task_id", F.lit(False).alias("known"), F.lit(_bit(stage)).alias("marks")))
    own = own.repartition(parts, "project_id") if parts else own
    each = own.groupBy("project_id", "task_id").agg(F.bit_or("marks").alias("marks"), F.bool_or("known").alias("known"))
    faulty = broken_projects.select("project_id", F.lit(_bit("dependencies")).alias("fault")).distinct()
    return each.join(faulty, "project_id", "left").select(
        "project_id", "task_id", F.col("marks").bitwiseOR(F.when(F.col("known"), F.coalesce("fault", F.lit(0))).otherwise(0)).alias("marks"))


def opened(marked: DataFrame) -> DataFrame:
    """Marks as offenders, one for each bit."""
    stages = F.filter(
        F.array(*[F.when(F.col("marks").bitwiseAND(_bit(s)) != 0, s) for s in MARKED]), lambda s: s.isNotNull())
    return marked.filter("marks <> 0").select("project_id", F.explode(stages).alias("stage"), F.col("task_id").cast("string").alias("item"))


def report(projects: DataFrame, *offenders: DataFrame) -> DataFrame:
    """One row per project and stage. Each table of offenders is counted by project, a column for each stage, and
    the counts are opened into stages last: what meets is a row for each project."""
    rows, counts = projects.select("project_id"), {s: [] for s in STAGES}
    for i, found in enumerate(offenders):
        counted = found.groupBy("project_id").agg(*[F.count_if(F.col("stage") == s).alias(f"_{i}_{s}") for s in STAGES])
        rows = rows.join(counted, "project_id", "left")
        for s in STAGES:
            counts[s].append(F.coalesce(f"_{i}_{s}", F.lit(0)))
    each = F.array(*[F.struct(F.lit(s).alias("stage"), sum(counts[s][1:], counts[s][0]).alias("offenders")) for s in STAGES])
    return rows.select("project_id", F.inline(each)).select(
        "project_id", "stage", (F.col("offenders") == 0).alias("passed"), "offenders", F.lit(VERSION).alias("validator_version"))


def failed_stages(reported: DataFrame) -> DataFrame:
    """Per project the stages that failed, in the order they are run, as one line; '' if none did."""
    failed = reported.groupBy("project_id").agg(F.collect_set(F.when(~F.col("passed"), F.col("stage"))).alias("_failed"))
    in_order = F.array_intersect(F.array(*[F.lit(s) for s in STAGES]), "_failed")
    return failed.select("project_id", F.array_join(in_order, ", ").alias("failed_stages"))


def verdict(reported: DataFrame) -> DataFrame:
    return reported.groupBy("project_id").agg(
        F.bool_and("passed").alias("passed"),
        # One entry per stage at most.
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("stage")))), ",").alias("failed_stages"))
