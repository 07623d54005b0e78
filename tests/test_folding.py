"""Names that differ in case only are the same name, whatever their letters."""

import itertools

from pyspark.sql import functions as F

from planloom.functions.text import folded
from planloom.operators import artifacts, evaluate, linking, roles

NAMES = [
    "Abschluß", "ABSCHLUSS", "abschluss", "Abschlus", "ﬁnal", "FINAL", "Final", "ΟΔΟΣ", "οδος", "οδοσ", "İzmir", "i̇zmir", "Izmir", "ızmir",
    "ǅ", "ǆ", "Ŀ", "ſet", "SET", "K", "k", "ŉ", "ʼn", "", " ", "é", "É", "Ꭰ", "ꭰ",
]


def test_keys_agree_with_case_folding(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", folded(F.col("name")).alias("key")).collect()
    keys = {r["name"]: r["key"] for r in rows}
    for a, b in itertools.combinations(NAMES, 2):
        assert (keys[a] == keys[b]) == (a.casefold() == b.casefold()), (a, b)


def test_every_letter(spark):
    """All letters with a case: two have one key just if they fold to the same."""
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).lower() != chr(i) or chr(i).upper() != chr(i))]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", folded(F.col("c")).alias("key")).collect()
    by_key, by_fold = {}, {}
    for r in rows:
        by_key.setdefault(r.key, set()).add(r.c)
        by_fold.setdefault(r.c.casefold(), set()).add(r.c)
    assert {frozenset(v) for v in by_key.values()} == {frozenset(v) for v in by_fold.values()}


def test_milestones_details_and_roles(spark):
    tasks = spark.createDataFrame(
        [(1, 1, 1, "Close", "ABSCHLUSS", "technical", "GROSSHÄNDLER"), (1, 2, 2, "Open", "Abschlus", "technical", "großhändler"), (1, 3, 3, "x", "", "technical", "Gast")],
        "project_id int, task_id int, ord int, title string, milestone string, team string, assignee_role string")
    milestones = spark.createDataFrame([(1, 7, "Abschluß", 1), (1, 8, "Start", 2)], "project_id int, milestone_id int, name string, pos int")
    links = linking.milestone_links(tasks, milestones)
    assert [(r.task_id, r.milestone_id) for r in links.collect()] == [(1, 7)]
    assert [r.task_id for r in linking.milestone_warnings(tasks, milestones).collect()] == [2]
    assert [r.milestone_id for r in linking.milestones_without_task(milestones, links).collect()] == [8]
    listed = spark.createDataFrame([(1, "Großhändler", "technical")], "project_id int, role_title string, team string")
    assert [r.role for r in evaluate.off_roster(tasks, listed).collect()] == ["technical/Gast"]
    roster = spark.createDataFrame([("Gast", "technical", "visits")], "role_title string, team string, responsibility string")
    assert [r.role_title for r in roles.close_roster(tasks, listed, roster).collect()] == ["Gast"]
    details = spark.createDataFrame([(1, 1, " Maßnahme", "K1")], "project_id int, ord int, name string, chunk_key string")
    cited = spark.createDataFrame([(1, "S", 1, "MASSNAHME ")], "project_id int, story_key string, pos int, name string")
    assert [(r.found, r.detail_key) for r in artifacts.resolved_details(cited, details).collect()] == [(True, "K1")]
