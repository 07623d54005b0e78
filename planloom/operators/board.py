"""Cards, what to push, and how the board differs from the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.text import percent, quoted, strip
from planloom.operators import windows

PUSHABLE = ["approved", "edited"]
APPROVED_PROJECT = ["approved", "partially_synced", "synced"]
# The board takes so many characters in one field; longer texts go out in parts.
FIELD_LIMIT = 16_384
# Checklists of at most so many lines are compared whole by one task.
WHOLE = 100_000


# Cards -----------------------------------------------------------------------------------


def role_label(title: Column) -> Column:
    slug = F.regexp_replace(F.upper(title), r"[^\p{L}\p{N}]+", "-")
    return F.concat(F.lit("ROLE-"), F.regexp_replace(slug, "^-+|-+$", ""))


def labels(team: Column, role: Column, source: Column, verdict: Column) -> Column:
    """Team, role, provenance and verdict labels, as an array of three or four."""
    provenance = (
        F.when(source == "explicit", "FROM-SOW").when(source == "inferred", "INFERRED").when(source == "assumed", "ASSUMED")
        .otherwise("SOURCE-UNKNOWN"))
    held = (
        F.when(verdict == "accept", "GROUNDED").when(verdict == "review", "REVIEW-REQUIRED")
        .when(verdict == "reject", "GROUNDING-FAILED").otherwise("NOT-CHECKED"))
    every = F.array(F.concat(F.lit("TEAM-"), F.upper(team)), F.when(role != "", role_label(role)), provenance, held)
    return F.filter(every, lambda x: x.isNotNull())


def label_colour(name: Column) -> Column:
    colour = F.lit("black")
    for label, value in vocab.LABEL_COLOURS.items():
        colour = F.when(name == label, value).otherwise(colour)
    return colour


def case_item(title: Column, expected: Column, rests: Column, fields: Column) -> Column:
    line = F.when(expected != "", F.concat(title, F.lit(" — expect: "), expected)).otherwise(title)
    marked = F.when(fields != "", F.concat(F.lit("⚠️ "), line, F.lit(" [assumes "), F.replace(fields, F.lit(","), F.lit(", ")), F.lit("]")))
    return F.when(rests, F.coalesce(marked, F.concat(F.lit("⚠️ "), line))).otherwise(line)


def checklist_items(task_stories: DataFrame, criteria: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per line of a card's checklists; tasks reach both through their stories."""
    keys = ["project_id", "story_key"]
    of_criteria = task_stories.join(criteria, keys).select(
        "project_id", "task_id", F.lit("Acceptance criteria").alias("list_name"), "story_key", "pos",
        F.when(F.col("measure") != "", F.concat("text", F.lit(" — "), "measure")).otherwise(F.col("text")).alias("item"))
    of_cases = task_stories.join(cases, keys).select(
        "project_id", "task_id", F.lit("Test cases").alias("list_name"), "story_key", "pos",
        case_item(F.col("title"), F.col("expected_result"), F.col("rests_on_assumption"), F.col("assumed_fields")).alias("item"))
    return of_criteria.unionByName(of_cases)


def blocker_text(title: Column, status: Column) -> Column:
    note = (
        F.when(status == "inferred", " (inferred, not stated)")
        .when(status == "assumed", " (assumed — the SOW does not order these)")
        .when(status == "", " (source not recorded)").otherwise(""))
    return F.concat(title, note)


def blockers(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task, what it waits on, in one line: the direct dependencies of one task."""
    up = tasks.select("project_id", F.col("task_id").alias("depends_on_id"), F.col("title").alias("upstream"))
    return deps.join(up, ["project_id", "depends_on_id"]).groupBy("project_id", "task_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("edge_ord", blocker_text(F.col("upstream"), F.col("source_status")).alias("line")))),
            lambda x: x["line"]), "; ").alias("blocked_by"))


def card_rows(tasks: DataFrame, sections: DataFrame, blocked: DataFrame, stories: DataFrame) -> DataFrame:
    """Everything a card says about a task; tasks carry owner and account, stories one row per task."""
    keys = ["project_id", "task_id"]
    out = tasks.join(sections.select(*keys, "section_title"), keys, "left").join(blocked, keys, "left").join(
        stories.select(*keys, "story_sentence", "technical_notes", "assumed_fields"), keys, "left")
    for name in ["section_title", "blocked_by", "story_sentence", "technical_notes", "assumed_fields"]:
        out = out.withColumn(name, F.coalesce(name, F.lit("")))
    return out


def body() -> Column:
    """The card body over the columns of `card_rows`: silent when all is well, loud when not."""
    def named(prefix: str, value: Column, shown: Column) -> Column:
        return F.when(shown, F.concat(F.lit(prefix), value))

    text, role, name = strip(F.coalesce("description", F.lit(""))), F.col("assignee_role"), F.col("owner")
    owner = F.when(name != "", F.concat(name, F.lit(" ("), role, F.lit(")"))).otherwise(role)
    notes = F.col("technical_notes")
    facts = F.concat_ws(
        "\n", named("**Owner:** ", owner, role != ""), named("**Blocked by:** ", F.col("blocked_by"), F.col("blocked_by") != ""),
        named("**From SOW:** ", F.col("section_title"), F.col("section_title") != ""))
    score = F.col("grounding_score")
    warnings = F.concat_ws(
        "\n\n",
        F.when(F.col("source_status") == "assumed",
               "⚠️ This task is an assumption. The SOW does not ask for it — confirm before starting."),
        F.when(F.col("validation_status").isin("review", "reject") & score.isNotNull(), F.concat(
            F.lit("⚠️ Only "), percent(score),
            F.lit(" of this task's claims are supported by the SOW. Check the details before relying on them."))),
        F.when(F.col("assumed_fields") != "", F.concat(
            F.lit("⚠️ Test cases for this task rely on values the SOW never stated ("), F.col("assumed_fields"),
            F.lit("). Confirm them before treating a passing test as acceptance."))))
    known = F.concat(warnings, F.when((warnings != "") & (facts != ""), "\n\n").otherwise(""), facts)
    return F.concat_ws(
        "\n\n---\n\n", F.when(text != "", text).otherwise("(no description)"),
        named("**Approach**\n\n", F.col("story_sentence"), F.col("story_sentence") != ""),
        F.when(notes != "", F.concat(F.lit("**Technical notes**\n\n"), notes)).when(
            F.col("team") == "technical",
            "**Technical notes**\n\nThe SOW does not specify the interfaces, protocols or environments for this work. "
            "Nothing has been assumed on your behalf — agree them before building."),
        F.when(known != "", known), F.lit(vocab.CARD_FOOTER))


def fingerprint(title: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(title, F.char(F.lit(0)), text), 256), 1, 32)


def location(team: Column) -> Column:
    named = F.concat(F.upper(F.substring(team, 1, 1)), F.lower(F.substring(team, F.lit(2), F.length(team))))
    return F.when(named.isin(vocab.TEAM_LISTS), named).otherwise("Backlog")


def payload(cards: DataFrame, limit: int = FIELD_LIMIT) -> DataFrame:
    """What is sent. No due date clears the field; an unknown account leaves the members alone.

    A field takes `limit` characters: what is longer goes out in further rows, numbered by part_no,
    so no text is lost. Part 1 is the card itself.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.length("title") / limit), F.ceil(F.length("body") / limit)).cast("int")
    start = (F.col("part_no") - 1) * limit + 1
    cards = cards.withColumn("part_no", F.explode(F.sequence(F.lit(1), parts)))
    return cards.select(
        "project_id", "task_id", "part_no", F.when(F.col("external_ref") == "", "create").otherwise("update").alias("action"),
        F.substring("title", start, F.lit(limit)).alias("name"), F.substring("body", start, F.lit(limit)).alias("desc"),
        F.array_join(labels(F.col("team"), F.col("assignee_role"), F.col("source_status"), F.col("validation_status")), ",").alias("labels"),
        F.coalesce(F.col("due_date").cast("string"), F.lit("")).alias("due"),
        F.when(F.col("account_id") != "", F.col("account_id")).alias("member"), location(F.col("team")).alias("list_name"))


# Pushing ---------------------------------------------------------------------------------


def eligible(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """May a task be pushed alone, may its project be pushed, and does it need to be."""
    blocked = tasks.groupBy("project_id").agg(F.bool_or(F.col("review_status") == "rejected").alias("_rejected"))
    ready = projects.select("project_id", F.col("status").isin(APPROVED_PROJECT).alias("_approved"))
    return tasks.join(blocked, "project_id").join(ready, "project_id").select(
        "project_id", "task_id", F.col("review_status").isin(PUSHABLE).alias("task_pushable"),
        (F.col("_approved") & ~F.col("_rejected")).alias("project_pushable"),
        ((F.col("external_ref") == "") | F.col("board_dirty")).alias("outstanding"))


def push_plan(tasks: DataFrame, cards: DataFrame) -> DataFrame:
    """Unplaced tasks carry no join key, so they do not meet in one task of the join."""
    on_board = cards.select(F.col("card_id").alias("_card"), F.lit(True).alias("_there"))
    placed = tasks.withColumn("_ref", F.nullif(F.col("external_ref"), F.lit("")))
    return placed.join(on_board, F.col("_ref") == F.col("_card"), "left").select(
        "project_id", "task_id",
        F.when(F.col("_ref").isNull(), "create").when(F.col("_there"), "update").otherwise("gone").alias("action"))


def status(projects: DataFrame, tasks: DataFrame) -> DataFrame:
    live = tasks.filter("review_status <> 'rejected'").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("live"), F.count_if(F.col("external_ref") != "").alias("placed"))
    return projects.select("project_id", "status").join(live, "project_id", "left").select(
        "project_id", F.when(F.coalesce("placed", F.lit(0)) == 0, F.col("status"))
        .when(F.col("placed") == F.col("live"), "synced").otherwise("partially_synced").alias("status"))


def dangling(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks on the board ahead of what they depend on: one row for each task that is missing there."""
    missing = tasks.filter("external_ref = ''").select("project_id", F.col("task_id").alias("depends_on_id"), F.col("title").alias("missing"))
    ahead = tasks.filter("external_ref <> ''").select("project_id", "task_id", "title")
    pairs = deps.select("project_id", "task_id", "depends_on_id").join(ahead, ["project_id", "task_id"]).join(
        missing, ["project_id", "depends_on_id"])
    return pairs.select("project_id", "task_id", "depends_on_id", "missing", F.concat(
        quoted(F.col("title")), F.lit(" is on the board before what it depends on: "), F.col("missing")).alias("message"))


def unassignable(owned: DataFrame) -> DataFrame:
    return owned.filter("owner <> '' AND account_id = ''").groupBy("project_id", "owner").agg(F.count(F.lit(1)).alias("cards"))


def outstanding_counts(tasks: DataFrame) -> DataFrame:
    placed, dirty = F.col("external_ref") != "", F.col("board_dirty")
    return tasks.groupBy("project_id").agg(
        F.count_if(placed).alias("on_board"), F.count_if(placed & dirty).alias("stale"),
        F.count_if(~placed | dirty).alias("outstanding"))


def checklist_diff(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Per line: keep, add, delete or renumber; a list the plan no longer has goes whole.

    wanted(card_id, list_name, item, want_pos), present(card_id, list_name, item, have_pos). A
    list is renumbered when a line was added or the kept lines changed their order. Lines of either side are dealt
    out by list once; lists of more than WHOLE lines, which would be much work for one task, are compared by all tasks
    together (see _diff_by_joins()). Lines of no card or list are left out.
    """
    keys, names = ["card_id", "list_name"], ["card_id", "list_name", "item"]
    crowded = windows.crowded(wanted.select(*keys).unionAll(present.select(*keys)), WHOLE)
    if crowded is None:
        return _diff_whole(wanted, present)
    few, many = ([side.join(crowded, keys, how) for side in (wanted, present)] for how in ("left_anti", "left_semi"))
    return _diff_whole(*few).unionByName(_diff_by_joins(*many))


def _diff_whole(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """checklist_diff() of lists that one task can hold."""
    keys, names = ["card_id", "list_name"], ["card_id", "list_name", "item"]
    kinds = dict(wanted.dtypes) | dict(present.dtypes)
    nothing = {name: F.lit(None).cast(kinds[name]).alias(name) for name in ("want_pos", "have_pos")}
    lines = wanted.select(*names, F.lit(True).alias("_wanted"), "want_pos", nothing["have_pos"]).unionByName(
        present.select(*names, F.lit(False).alias("_wanted"), nothing["want_pos"], "have_pos")).dropna(subset=keys)
    # Lines without a text are no line of the other side.
    side = F.when(F.col("item").isNull(), F.col("_wanted")).alias("_side")
    met = lines.repartition(*keys).groupBy(*names, side).agg(*[
        F.collect_list(F.when(when, F.struct(name))).alias(name) for name, when in (("want_pos", F.col("_wanted")), ("have_pos", ~F.col("_wanted")))])

    def some(name: str) -> Column:
        return F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.struct(nothing[name])))

    pairs = F.flatten(F.transform(some("want_pos"), lambda w: F.transform(some("have_pos"), lambda h: F.struct(
        w["want_pos"].alias("want_pos"), h["have_pos"].alias("have_pos")))))
    both = met.select(*names, F.inline(pairs)).withColumn("_kept", F.col("want_pos").isNotNull() & F.col("have_pos").isNotNull())
    of_list = W.partitionBy(*keys)
    before = F.lag("have_pos").over(W.partitionBy(*keys, "_kept").orderBy("want_pos"))
    marked = both.withColumn("_before", F.when(F.col("_kept"), before)).select(
        *names, "want_pos", "have_pos", F.bool_or(F.col("_before") > F.col("have_pos")).over(of_list).alias("_moved"),
        F.bool_or(F.col("have_pos").isNull()).over(of_list).alias("_added"), (F.count("want_pos").over(of_list) == 0).alias("_leftover"))
    return marked.select(*names, "want_pos", _action())


def _action() -> Column:
    renumber = F.col("_added") | F.coalesce("_moved", F.lit(False))
    return (
        F.when(F.col("_leftover"), "delete_list").when(F.col("want_pos").isNull(), "delete")
        .when(F.col("have_pos").isNull(), "add").when(renumber, "renumber").otherwise("keep").alias("action"))


def _diff_by_joins(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """checklist_diff() of lists of any length."""
    keys, names = ["card_id", "list_name"], ["card_id", "list_name", "item"]
    both = wanted.join(present, names, "full")
    kept = both.filter("want_pos IS NOT NULL AND have_pos IS NOT NULL")
    moved = windows.lag(
        kept, keys, windows.by_width(F.col("want_pos"), 10_000), [F.col("want_pos")], F.col("have_pos"), "_before"
    ).groupBy(*keys).agg(F.bool_or(F.col("_before") > F.col("have_pos")).alias("_moved"))
    lists = both.groupBy(*keys).agg(
        F.bool_or(F.col("have_pos").isNull()).alias("_added"), (F.count("want_pos") == 0).alias("_leftover"))
    return both.join(lists, keys).join(moved, keys, "left").select(*names, "want_pos", _action())


# Drift -----------------------------------------------------------------------------------


def snapshot(cards: DataFrame, lists: DataFrame) -> DataFrame:
    """Cards with the name of their list; '' where the list is unknown."""
    return cards.join(lists, "list_id", "left").withColumn("list_name", F.coalesce("list_name", F.lit("")))


def detect(planned: DataFrame, cards: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Differences (project_id, task_id, kind, detail) between the plan and boards that could be read; with
    `by`, columns of cards that tell several readings of a board apart, for each of them, and with the board.

    planned(project_id, board_id, task_id, title, team, external_ref, account_id, owner,
    board_fingerprint); cards(board_id, card_id, list_name, title, body, archived, members). A
    board without a single card was not read: nothing is said about it.
    """
    readable = cards.select("board_id", *by).distinct()
    seen = cards.select(
        "board_id", *by, F.col("card_id").alias("external_ref"), "list_name", F.col("title").alias("card_title"),
        fingerprint(F.col("title"), F.col("body")).alias("card_print"), "archived", "members")
    placed = planned.filter("external_ref <> ''").join(readable, "board_id", "inner" if by else "left_semi")
    joined = placed.join(seen, ["board_id", "external_ref", *by], "left")
    title, due_list = quoted(F.col("title")), location(F.col("team"))
    owner = F.when(F.col("owner") != "", F.col("owner")).otherwise("the planned owner")

    def difference(kind: str, when: Column, *detail) -> Column:
        text = F.concat(*[d if isinstance(d, Column) else F.lit(d) for d in detail])
        return F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("detail")))

    gone = F.col("card_print").isNull()
    here = ~gone & ~F.col("archived")
    found = F.array(
        difference("deleted", gone, title, " was deleted from the board and cannot be brought back. Pushing the task makes a new "
                   "card, which will not have the old one's comments or ticked items."),
        difference("archived", ~gone & F.col("archived"), title, " was archived on the board. It can be restored exactly as it "
                   "was, with its comments and ticked items intact."),
        difference("moved", here & (F.col("list_name") != "") & (F.col("list_name") != due_list), title, " sits in ",
                   quoted(F.col("list_name")), ", but the plan has it under ", F.col("team"), " (", quoted(due_list), ")."),
        difference("reassigned", here & (F.col("account_id") != "") & ~F.array_contains(F.col("members"), F.col("account_id")),
                   title, " is no longer assigned to ", owner, " on the board. Pushing the task again puts them back."),
        difference("edited", here & (F.col("board_fingerprint") != "") & (F.col("card_print") != F.col("board_fingerprint")),
                   title, " was edited on the board. The card now reads ", quoted(F.col("card_title")),
                   ". Pushing the task again will replace it."),
    )
    keys = ["project_id", "task_id", *(["board_id", *by] if by else [])]
    return joined.select(*keys, F.explode(F.filter(found, lambda d: d.isNotNull())).alias("d")).select(*keys, "d.*")


def reconcile(state: DataFrame, found: DataFrame, checked: DataFrame, now: Column) -> DataFrame:
    """Stored differences brought in line with one check; adds `fresh` to rows that are news.

    state(project_id, task_id, kind, detail, first_seen_at, notified_at, resolved_at); checked
    (project_id, task_id): only tasks the check looked at may be settled by it. Resolved rows are
    history and pass through.
    """
    keys = ["project_id", "task_id", "kind"]
    closed = state.filter("resolved_at IS NOT NULL").withColumn("fresh", F.lit(False))
    open_rows = state.filter("resolved_at IS NULL")
    looked = checked.select("project_id", "task_id", F.lit(True).alias("_looked")).distinct()
    seen = found.select(*keys, F.col("detail").alias("_detail"), F.lit(True).alias("_seen"))
    merged = open_rows.withColumn("_open", F.lit(True)).join(seen, keys, "full").join(looked, ["project_id", "task_id"], "left")
    settled = F.col("_open").isNotNull() & F.col("_seen").isNull() & F.col("_looked").isNotNull()
    fresh = F.col("_open").isNull()
    current = merged.select(
        *keys, F.coalesce("_detail", "detail").alias("detail"), F.when(fresh, now).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        "notified_at", F.when(settled, now).alias("resolved_at"), fresh.alias("fresh"))
    return closed.select(*current.columns).unionByName(current)


def replay(state: DataFrame, planned: DataFrame, cards: DataFrame) -> DataFrame:
    """Open differences brought in line with any number of checks at once, as if reconciled one by one.

    state(project_id, task_id, kind, detail, first_seen_at, notified_at, resolved_at) of open rows;
    cards(check_no, ...) as for detect(). A difference lasts over consecutive readings of its board: each
    run of readings that see it is a row. A run from the first reading on carries on the open row; a run
    that ends is settled by the next reading of the board. A window spans a board's or a
    difference's readings in these checks, a few, never its cards.
    """
    keys = ["project_id", "task_id", "kind"]
    in_order = W.partitionBy("board_id").orderBy("check_no")
    reads = cards.select("board_id", "check_no").distinct().select(
        "board_id", "check_no", F.row_number().over(in_order).alias("_n"), F.lead("check_no").over(in_order).alias("_next"))
    found = detect(planned, cards, ("check_no",)).join(reads, ["board_id", "check_no"])
    ordered = W.partitionBy(*keys).orderBy("check_no")
    runs = found.withColumn("_run", F.col("_n") - F.row_number().over(ordered)).groupBy(*keys, "_run").agg(
        F.min("check_no").alias("_first"), F.min("_n").alias("_n"), F.max_by("detail", "check_no").alias("_detail"),
        F.max_by("_next", "check_no").alias("_ended"))
    first = reads.filter("_n = 1").select("board_id", F.col("check_no").alias("_looked_at"))
    looked = planned.filter("external_ref <> ''").join(first, "board_id").select("project_id", "task_id", "_looked_at").distinct()
    known = state.select(*keys, "detail", "first_seen_at", "notified_at", F.lit(1).alias("_n"), F.lit(True).alias("_open"))
    merged = known.join(runs, [*keys, "_n"], "full").join(looked, ["project_id", "task_id"], "left")
    seen, fresh = F.col("_run").isNotNull(), F.col("_open").isNull()
    return merged.select(
        *keys, F.coalesce("_detail", "detail").alias("detail"), F.coalesce("first_seen_at", "_first").alias("first_seen_at"), "notified_at",
        F.when(seen, F.col("_ended")).otherwise(F.col("_looked_at")).alias("resolved_at"), fresh.alias("fresh"))


def open_drift(state: DataFrame) -> DataFrame:
    return state.filter("resolved_at IS NULL").orderBy("first_seen_at")


def notify_batch(fresh: DataFrame, projects: DataFrame, per_message: int = 20) -> DataFrame:
    """Messages per project, grouped: numbered parts of up to `per_message` lines, none left out.

    task_id is a number; projects are cut along it (see operators/windows.py).
    """
    part = F.floor((F.col("n") - 1) / per_message).cast("int")
    numbered = windows.row_number(
        windows.by_depth(fresh, ["project_id"], F.col("task_id"), "_part"), ["project_id"], F.col("_part"), [F.col("task_id"), F.col("kind")], "n")
    total = fresh.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    names = projects.select("project_id", "name")
    lines = numbered.withColumn("part", part).join(names, "project_id").groupBy("project_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("detail")).alias("line")))),
                                 lambda x: x["line"]), "\n").alias("lines"))
    return lines.join(total, "project_id").select("project_id", "part", F.concat(
        F.lit("**The board no longer matches the plan** ("), F.col("total").cast("string"), F.lit(" change(s))\n\n"), F.col("lines"),
        F.lit("\n\nNothing was changed on the board. Review these in the platform.")).alias("message"))


def mark_notified(state: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    keys = ["project_id", "task_id", "kind"]
    return state.join(sent.select(*keys, F.lit(True).alias("_sent")).distinct(), keys, "left").withColumn(
        "notified_at", F.when(F.col("_sent") & F.col("resolved_at").isNull(), now).otherwise(F.col("notified_at"))).drop("_sent")


def restore_resolve(state: DataFrame, restored: DataFrame, now: Column) -> DataFrame:
    """Putting an archived card back settles the task's open 'archived' rows."""
    hit = restored.select("project_id", "task_id", F.lit(True).alias("_back")).distinct()
    settles = F.col("_back").isNotNull() & (F.col("kind") == "archived") & F.col("resolved_at").isNull()
    return state.join(hit, ["project_id", "task_id"], "left").withColumn(
        "resolved_at", F.when(settles, now).otherwise(F.col("resolved_at"))).drop("_back")


def badge(drift_kind: Column, external_ref: Column, dirty: Column) -> Column:
    known = {
        "archived": "📦 archived on the board — restorable", "deleted": "🗑️ deleted from the board",
        "moved": "↔️ moved to another list on the board", "edited": "✏️ edited on the board",
        "reassigned": "👤 assigned to somebody else on the board",
    }
    out = F.when(external_ref == "", "⬜ not on the board").when(dirty, "🔄 on the board, out of date").otherwise("✅ on the board")
    special = F.concat(F.lit("⚠️ "), drift_kind)
    for kind, text in known.items():
        special = F.when(drift_kind == kind, text).otherwise(special)
    return F.when(F.coalesce(drift_kind, F.lit("")) != "", special).otherwise(out)


def review_ready(summaries: DataFrame) -> DataFrame:
    """summaries(project_id, name, commercial, technical, operations, critical, assumptions, score,
    failed_stages): failed_stages is '' where all passed, score null where nothing was grounded."""
    teams = [F.when(F.col(t) > 0, F.concat(F.lit(f"{t} "), F.col(t).cast("string"))) for t in vocab.TEAMS]
    total = sum((F.col(t) for t in vocab.TEAMS[1:]), F.col(vocab.TEAMS[0]))
    mix = F.concat_ws(", ", *teams)
    return summaries.select("project_id", F.concat_ws(
        "\n", F.lit("**New project ready for review**"), F.concat(F.lit("Project: "), F.col("name")),
        F.concat(F.lit("Tasks: "), total.cast("string"), F.when(mix != "", F.concat(F.lit(" ("), mix, F.lit(")"))).otherwise("")),
        F.concat(F.lit("Critical path: "), F.col("critical").cast("string"), F.lit(" tasks")),
        F.concat(F.lit("Assumptions: "), F.col("assumptions").cast("string")),
        F.when(F.col("score").isNotNull(), F.concat(F.lit("Grounding score: "), percent(F.col("score")))),
        F.concat(F.lit("Validation: "), F.when(F.col("failed_stages") != "", F.concat(F.col("failed_stages"), F.lit(" failed")))
                 .otherwise("all stages passed")),
        F.lit("Status: awaiting PM approval")).alias("message"))
