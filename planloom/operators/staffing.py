"""People on roles: candidates, automatic staffing, owners and the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.text import or_none
from planloom.operators import windows


def set_capabilities(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Replace what the named people can do by the known titles asked for."""
    titles = [t for t, *_ in vocab.ROSTER]
    known = wanted.filter(F.col("role_title").isin(titles)).select("person_id", "role_title").distinct()
    touched = wanted.select("person_id").distinct()
    return existing.join(touched, "person_id", "left_anti").select("person_id", "role_title").unionByName(known)


def candidates(people: DataFrame, person_roles: DataFrame) -> DataFrame:
    return people.filter("active").join(person_roles.select("person_id", "role_title").distinct(), "person_id").select(
        "role_title", "person_id", "name")


def autostaff(project_roles: DataFrame, people: DataFrame, person_roles: DataFrame) -> DataFrame:
    """Open roles with exactly one active candidate are filled; a held role is never touched."""
    able = candidates(people, person_roles).groupBy("role_title").agg(
        F.count(F.lit(1)).alias("able"), F.max("person_id").alias("only"))
    joined = project_roles.join(able, "role_title", "left")
    open_role, n = F.col("person_id").isNull(), F.coalesce("able", F.lit(0))
    return joined.select(
        "project_id", "role_id", "role_title",
        F.when(open_role & (n == 1), F.col("only")).otherwise(F.col("person_id")).alias("person_id"),
        F.when(~open_role, "held").when(n == 1, "filled").when(n > 1, "choose").otherwise("nobody").alias("outcome"),
        n.alias("candidates"),
    )


def autostaff_notes(staffed: DataFrame) -> DataFrame:
    return staffed.filter(F.col("outcome").isin("choose", "nobody")).select(
        "project_id", "role_id",
        F.when(F.col("outcome") == "choose", F.concat(F.col("role_title"), F.lit(": "), F.col("candidates").cast("string"),
                                                      F.lit(" people can do this")))
        .otherwise(F.concat(F.col("role_title"), F.lit(": nobody in the directory does this yet"))).alias("note"))


def owners(tasks: DataFrame, project_roles: DataFrame, people: DataFrame) -> DataFrame:
    """The named assignee, else whoever holds the task's role in the project, else nobody."""
    first = project_roles.groupBy("project_id", F.col("role_title").alias("assignee_role")).agg(
        F.min_by(F.struct("person_id"), "role_id").alias("r"))
    held = first.select("project_id", "assignee_role", F.col("r.person_id").alias("person_id")).join(
        people.select("person_id", F.col("name").alias("holder"), F.col("account_id").alias("holder_account")), "person_id")
    explicit = F.col("assignee") != ""
    return tasks.join(held.drop("person_id"), ["project_id", "assignee_role"], "left").withColumn(
        "owner", F.coalesce(or_none(F.col("assignee")), "holder", F.lit(""))
    ).withColumn("account_id", F.when(explicit, "").otherwise(F.coalesce("holder_account", F.lit("")))).drop(
        "holder", "holder_account")


def set_holders(project_roles: DataFrame, requests: DataFrame, people: DataFrame) -> DataFrame:
    """Put people on roles or clear them; requests for unknown roles or people are refused."""
    known = people.select(F.col("person_id").alias("wanted"), F.lit(True).alias("_known"))
    asked = requests.select("project_id", "role_id", F.col("person_id").alias("wanted"), F.lit(True).alias("_asked"))
    joined = project_roles.join(asked, ["project_id", "role_id"], "left").join(known, "wanted", "left")
    allowed = F.col("_asked") & (F.col("wanted").isNull() | F.col("_known").isNotNull())
    return joined.withColumn(
        "person_id", F.when(F.coalesce(allowed, F.lit(False)), F.col("wanted")).otherwise(F.col("person_id"))
    ).withColumn("changed", F.coalesce(allowed, F.lit(False))).drop("wanted", "_known", "_asked")


def refused_holders(project_roles: DataFrame, requests: DataFrame, people: DataFrame) -> DataFrame:
    no_role = requests.join(project_roles.select("project_id", "role_id"), ["project_id", "role_id"], "left_anti").select(
        "project_id", "role_id", F.lit("role not found in this project").alias("reason"))
    no_person = (
        requests.filter(F.col("person_id").isNotNull())
        .join(project_roles.select("project_id", "role_id"), ["project_id", "role_id"], "left_semi")
        .join(people.select("person_id"), "person_id", "left_anti")
        .select("project_id", "role_id", F.lit("person not found").alias("reason"))
    )
    return no_role.unionByName(no_person)


def mark_dirty(tasks: DataFrame, changed_roles: DataFrame) -> DataFrame:
    """Cards on the board that name a role whose holder changed are out of date."""
    changed = changed_roles.select("project_id", F.col("role_title").alias("assignee_role"), F.lit(True).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("external_ref") != "")
    return tasks.join(changed, ["project_id", "assignee_role"], "left").withColumn(
        "board_dirty", F.col("board_dirty") | hit).drop("_hit")


def account_clashes(people: DataFrame) -> DataFrame:
    """Accounts linked to more than one person, and who has them."""
    linked = people.filter(F.col("account_id") != "")
    shared = linked.groupBy("account_id").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    return linked.join(shared, "account_id").select("account_id", "person_id", "name", "holders")


def directory(people: DataFrame, person_roles: DataFrame) -> DataFrame:
    """Active people first, by name; a person has at most as many roles as the roster."""
    roles = person_roles.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("role_title")), ", ").alias("roles"))
    return people.join(roles, "person_id", "left").select(
        "person_id", "name", "active", "account_id", F.coalesce("roles", F.lit("")).alias("roles")
    ).orderBy(F.col("active").desc(), "name")


def upsert_people(people: DataFrame, additions: DataFrame) -> DataFrame:
    """Re-adding an inactive name brings the person back; an active duplicate is refused."""
    added = additions.select(F.trim("name").alias("name"), F.lit(True).alias("_added")).filter("name <> ''").distinct()
    return people.join(added, "name", "full").select(
        "name", "person_id",
        F.when(F.col("person_id").isNull(), True).otherwise(F.col("active") | F.col("_added").isNotNull()).alias("active"),
        F.when(F.col("_added").isNull(), "unchanged").when(F.col("person_id").isNull(), "added")
        .when(F.col("active"), "refused").otherwise("reactivated").alias("outcome"),
    )


def overlaps(owned: DataFrame, whole: bool = False) -> DataFrame:
    """One owner in two places: each task against the longest-running one started before it.

    owned(project_id, owner, task_id, title, start_date, due_date, ord). Dates are inclusive. A
    task that runs exactly as long as an earlier one does not take its place. whole: as of windows.lag_by().
    """
    ready = owned.filter(F.col("start_date").isNotNull() & F.col("due_date").isNotNull() & (F.col("owner") != ""))
    # Of equal due dates the one that started first is the greater.
    running = F.struct(
        F.col("due_date").alias("due"), (-F.unix_date("start_date")).alias("early"), (-F.col("ord")).alias("neg_ord"),
        F.col("task_id").alias("id"), F.col("title").alias("title"))
    keys = ["project_id", "owner"]
    carried = windows.running_max_before_by(
        ready, keys, F.unix_date("start_date"), [F.col("start_date"), F.col("ord")], running, "with", whole)
    return carried.filter(F.col("start_date") <= F.col("with.due")).select(
        "project_id", "owner", F.col("with.id").alias("first_task_id"), F.col("task_id").alias("second_task_id"),
        (F.datediff("with.due", "start_date") + 1).alias("overlap_days"),
        F.concat(F.col("owner"), F.lit(" is on '"), F.col("with.title"), F.lit("' and '"), F.col("title"),
                 F.lit("' at the same time ("), (F.datediff("with.due", "start_date") + 1).cast("string"),
                 F.lit(" day(s) overlapping)")).alias("message"),
    )
