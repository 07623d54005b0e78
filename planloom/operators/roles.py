"""Free-text roles matched to the roles a team has."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.text import folded, quoted


def tokens(text: Column) -> Column:
    """Distinct lower-case words, with synonyms replaced."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    synonyms = F.create_map(*[F.lit(x) for pair in vocab.ROLE_SYNONYMS.items() for x in pair])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(synonyms, w), w)))


def fixed_tokens(text: str) -> list[str]:
    """tokens() of a text of the vocabulary, found once and not in every row."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(vocab.ROLE_SYNONYMS.get(w, w) for w in words))


def score(title_tokens: Column, wanted: Column) -> Column:
    shared = F.array_intersect(title_tokens, wanted)
    generic = F.array(*[F.lit(w) for w in vocab.GENERIC_ROLE_WORDS])
    return (
        F.size(F.array_except(shared, generic)) * vocab.DISTINCTIVE_POINTS
        + F.size(F.array_intersect(shared, generic)) * vocab.GENERIC_POINTS
    )


def _roster_array() -> Column:
    """The roster as a constant array, so that scoring against it needs no join."""
    return F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(title).alias("title"), F.lit(team).alias("team"),
                 F.lit(lead).alias("is_lead"), F.array(*[F.lit(w) for w in fixed_tokens(title)]).alias("tokens"))
        for i, (title, team, _, lead) in enumerate(vocab.ROSTER, start=1)
    ])


def lead_of(team: Column) -> Column:
    lead = F.lit(None).cast("string")
    for title, owner, _, is_lead in vocab.ROSTER:
        if is_lead:
            lead = F.when(team == owner, title).otherwise(lead)
    return lead


def targets(project_roles: DataFrame) -> DataFrame:
    """Roles the documents named beyond the default ones of the same team."""
    default = F.array(*[F.struct(folded(F.lit(t)).alias("title"), F.lit(team).alias("team")) for t, team, _, _ in vocab.ROSTER])
    asked = F.struct(folded(F.col("role_title")).alias("title"), F.col("team").alias("team"))
    return project_roles.filter(~F.array_contains(default, asked))


def matched(tasks: DataFrame, extra_roles: DataFrame) -> DataFrame:
    """The best role of the task's team, default or named by the document, else the team's lead. A task
    of a team that no default role belongs to keeps its wording, with a warning.

    tasks(project_id, task_id, team, raw_role); extra_roles(project_id, role_id, role_title, team)
    as `targets` returns them.
    """
    # Wordings repeat: each is scored once per team, and the outcome joined back.
    wordings = tasks.select("team", "raw_role").distinct().withColumn("wanted", tokens(F.col("raw_role"))).withColumn(
        "roster", _roster_array())

    def scored(r: Column) -> Column:
        # Highest score first, then the order of the roster.
        return F.struct(score(r["tokens"], F.col("wanted")).alias("score"), (-r["ord"]).alias("neg_ord"),
                        r["title"].alias("title"), r["team"].alias("team"))

    wordings = wordings.withColumn("scored", F.transform("roster", scored))
    own = F.array_max(F.filter("scored", lambda r: r["team"] == F.col("team")))
    other = F.filter("scored", lambda r: (r["team"] != F.col("team")) & (r["score"] >= vocab.DISTINCTIVE_POINTS))
    wordings = wordings.select(
        "team", "raw_role", "wanted", own.alias("own"), F.get(other, F.lit(0))["team"].alias("other_team"))
    named = tasks.select("project_id", "task_id", "team", "raw_role").join(wordings, ["team", "raw_role"])
    extra = (
        named.select("project_id", "task_id", "team", "wanted")
        .join(extra_roles.select("project_id", "role_id", "role_title", "team"), ["project_id", "team"])
        .withColumn("extra_score", score(tokens(F.col("role_title")), F.col("wanted")))
        .filter(F.col("extra_score") >= vocab.DISTINCTIVE_POINTS)
        .groupBy("project_id", "task_id")
        .agg(F.max_by(F.struct("extra_score", "role_title"), F.struct("extra_score", -F.col("role_id"))).alias("extra"))
    )
    joined = named.join(extra, ["project_id", "task_id"], "left")
    lead, blank = lead_of(F.col("team")), F.size("wanted") == 0
    own_score = F.coalesce("own.score", F.lit(0))
    # The document's own roles stand behind the defaults, so they win only by a higher score.
    by_extra = F.coalesce(F.col("extra.extra_score") > own_score, F.lit(False))
    found = own_score >= vocab.DISTINCTIVE_POINTS
    return joined.select(
        "project_id", "task_id", "team", "raw_role",
        F.when(lead.isNull(), F.col("raw_role")).when(by_extra, F.col("extra.role_title")).when(found & ~blank, F.col("own.title")).otherwise(lead).alias("role_title"),
        F.when(lead.isNull(), F.concat(F.lit("unknown team "), quoted(F.col("team")), F.lit("; role left as written"))).when(
            blank | by_extra | found, "").when(
            F.col("other_team").isNotNull(),
            F.concat(F.lit("role "), quoted(F.col("raw_role")), F.lit(" belongs to the "), F.col("other_team"),
                     F.lit(" team but the task is "), F.col("team"), F.lit("; assigned to "), lead),
        ).otherwise(F.concat(F.lit("unknown "), F.col("team"), F.lit(" role "), quoted(F.col("raw_role")),
                             F.lit(", assigned to "), lead)).alias("warning"),
    )


def default_roster(projects: DataFrame, project_roles: DataFrame) -> DataFrame:
    """Projects that list no roles get the default ones, marked as assumed."""
    rows = F.array(*[
        F.struct(F.lit(title).alias("role_title"), F.lit(team).alias("team"), F.lit(does).alias("responsibility"))
        for title, team, does, _ in vocab.ROSTER
    ])
    empty = projects.select("project_id").join(project_roles.select("project_id"), "project_id", "left_anti")
    return empty.select("project_id", F.explode(rows).alias("r")).select(
        "project_id", "r.*", F.lit(1).alias("headcount"), F.lit("assumed").alias("source_status"))


def close_roster(tasks: DataFrame, project_roles: DataFrame, roster: DataFrame) -> DataFrame:
    """Roles that tasks use and the roster lacks, once each, marked as assumed."""
    listed = project_roles.select("project_id", "team", folded(F.col("role_title")).alias("_key")).distinct()
    used = (
        tasks.filter(F.coalesce("assignee_role", F.lit("")) != "")
        .groupBy("project_id", "team", folded(F.col("assignee_role")).alias("_key"))
        .agg(F.min_by("assignee_role", "ord").alias("role_title"))
    )
    does = F.broadcast(roster.select("role_title", "team", "responsibility"))
    return used.join(listed, ["project_id", "team", "_key"], "left_anti").join(does, ["role_title", "team"], "left").select(
        "project_id", "team", "role_title", F.coalesce("responsibility", F.lit("")).alias("responsibility"),
        F.lit("assumed").alias("source_status"))


def client_tokens(name: Column) -> Column:
    """Words that name the client, compound names split at their capitals; short words left out."""
    parts = F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z][a-z]+|[a-z]+"), F.lit(0)), F.lower)
    return F.filter(F.array_union(tokens(name), parts), lambda w: F.length(w) > 2)


def is_delivery(actor: Column, client: Column) -> Column:
    """Whether an actor is on the delivery side rather than the client's."""
    theirs = F.array(*[F.lit(w) for w in vocab.CLIENT_SIDE_WORDS])

    def judged(wanted: Column) -> Column:
        ours = F.exists(_roster_array(), lambda r: score(r["tokens"], wanted) >= vocab.DISTINCTIVE_POINTS)
        return ~F.arrays_overlap(wanted, theirs) & ~F.arrays_overlap(wanted, client_tokens(client)) & ours

    # The actor's words are found once, not for every role of the roster.
    return F.get(F.transform(F.array(tokens(actor)), judged), F.lit(0))
