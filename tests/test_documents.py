"""Segmentation, quality, citations, gaps and roles on small texts."""

from pyspark.sql import functions as F

from planloom.functions.citations import normalize
from planloom.operators import gaps, quality, roles, segment
from planloom.sources import readers

BODY = "This sentence is long enough to be kept as a chunk of its own."
TEXT = f"""Scope of the loyalty programme, third version of the document
=====

1. BACKGROUND
-------------

{BODY}

2. Short section
----------------

tiny

2.1 Offers
----------

Offer list to be provided by the marketing team of the merchant.

Offer list to be provided by the marketing team of the merchant.

FWD: RE: RE: training dates
---------------------------

Staff can only be released for training on Mondays, please plan for that.
"""


def segmented(spark, text):
    return segment.segment(spark.createDataFrame([(1, "SOW-001", text)], "project_id int, doc_key string, text string"))


def test_sections_and_keys(spark):
    rows = segment.section_rows(segmented(spark, TEXT)).collect()
    # The empty section vanishes and its number is used again; a preamble with text is number 0.
    assert [(r.section_index, r.section_title) for r in rows] == [
        (0, "(preamble)"), (2, "1. BACKGROUND"), (3, "2.1 Offers"), (4, "FWD: RE: RE: training dates")]
    keys = [r.chunk_key for r in segment.chunk_rows(segmented(spark, TEXT)).collect()]
    assert keys == ["SOW-001-S00-C01", "SOW-001-S02-C01", "SOW-001-S03-C01", "SOW-001-S03-C02", "SOW-001-S04-C01"]


def test_headings(spark):
    texts = {
        "4. Commercial Requirements": True, "2.1 Offers": True, "FWD: RE: RE: training dates": True, "GENERAL TERMS": True,
        "The Merchant will launch 20 loyalty offers at go-live.": False, "": False, "3 The work ends here.": False,
        "A" * 121: False,
    }
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, want boolean")
    for r in df.withColumn("got", segment.is_heading(F.col("t"))).collect():
        assert r.got == r.want, r.t


def test_long_paragraphs_are_packed_whole(spark):
    text = " ".join(f"Sentence number {i} says something about the work." for i in range(120))
    df = spark.createDataFrame([(text,), ("x" * 3000,)], "t string")
    packed, single = (r[0] for r in df.select(segment.split_long(F.col("t"))).collect())
    assert " ".join(packed) == text and all(len(p) <= 1200 for p in packed) and len(packed) > 3
    assert single == ["x" * 3000]


def test_quality(spark):
    checks = {r.check: r for r in quality.checks(quality.measures(segmented(spark, TEXT))).collect()}
    assert not checks["no_duplicate_chunks"].passed and checks["no_duplicate_chunks"].detail.startswith("1 ")
    assert not checks["page_references"].passed and checks["sections_detected"].passed
    short = quality.parsing_status(quality.checks(quality.measures(segmented(spark, "nothing here")))).first()
    assert short.parsing_status == "parsing_failed"


def test_cells(spark):
    df = spark.createDataFrame([([["Merchant onboarding\nquestionnaires", "a\nb\nc", None], [None, ""]],)], "rows array<array<string>>")
    assert df.select(segment.flatten_rows(F.col("rows"))).first()[0] == "Merchant onboarding questionnaires | a b c | "


def test_layout_blocks(spark):
    lines = spark.createDataFrame(
        [("d", 1, 1, 10.0, 50.0, "First line of"), ("d", 1, 2, 22.0, 50.0, "a paragraph"), ("d", 1, 3, 40.0, 50.0, "second paragraph"),
         ("d", 1, 4, 61.0, 50.0, "cell text"), ("d", 1, 5, 90.0, 50.0, "2.1 Offers"), ("d", 1, 6, 102.0, 50.0, "after the heading")],
        "doc_key string, page int, line_no int, top double, x0 double, text string")
    tables = spark.createDataFrame([("d", 1, 40.0, 60.0, 500.0, 70.0, [["a", "b"]])],
                                   "doc_key string, page int, x0 double, top double, x1 double, bottom double, rows array<array<string>>")
    out = segment.layout_blocks(lines, tables).orderBy("block_no").collect()
    assert [r.text for r in out] == ["First line of a paragraph", "second paragraph", "a | b", "2.1 Offers", "after the heading"]
    assert [r.is_table for r in out] == [False, False, True, False, False]


def test_citations(spark):
    raw = ["SOW-001-S04-C02 p1", "[SOW-001-S04-C02]", "  SOW-001-S04-C02  ", "SOW-R01-S12-C03 p12", "section 4.2"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r[0] for r in df.select(normalize(F.col("r"))).collect()] == ["SOW-001-S04-C02"] * 3 + ["SOW-R01-S12-C03", "section 4.2"]


def test_non_committal(spark):
    vague = ["TBD", "to be confirmed", "standard scheme", "probably API keys", "industry-standard", "", "5 days (TBD)",
             "10 points per 1 USD, to be confirmed"]
    firm = ["2.5% of each offer (standard model)", "10 points per 1 USD, the standard scheme", "approximately 50 transactions per second"]
    df = spark.createDataFrame([(v, True) for v in vague] + [(v, False) for v in firm], "v string, want boolean")
    for r in df.withColumn("got", gaps.non_committal(F.col("v"))).collect():
        assert r.got == r.want, r.v


def test_roles(spark):
    asked = [
        ("technical", "backend developer", "Backend Engineer", ""), ("technical", "ML Engineer", "AI Engineer", ""),
        ("technical", "QA", "QA Engineer", ""), ("operations", "ops manager", "Operations Manager", ""),
        ("operations", "trainer", "Merchant Success Specialist", ""), ("commercial", "lawyer", "Legal Advisor", ""),
        ("technical", "Software Engineer", "Technical Lead", "unknown"), ("technical", "Operations Manager", "Technical Lead", "belongs to the operations"),
        ("commercial", "", "Commercial Manager", ""), ("technical", "Integration Architect", "Integration Architect", ""),
    ]
    tasks = spark.createDataFrame([(1, i, t, r) for i, (t, r, *_) in enumerate(asked)], "project_id int, task_id int, team string, raw_role string")
    extra = spark.createDataFrame([(1, 1, "Integration Architect", "technical")], "project_id int, role_id int, role_title string, team string")
    got = {r.task_id: r for r in roles.matched(tasks, extra).collect()}
    for i, (_, raw, title, warning) in enumerate(asked):
        assert got[i].role_title == title, raw
        assert warning in got[i].warning and (warning != "" or got[i].warning == "")


def test_delivery_side(spark):
    cases = [("support agent", "", True), ("merchant operations manager", "", False), ("bank compliance officer", "NorthBank S.A.E.", False),
             ("shopper", "", False), ("", "", False), ("compliance officer", "Acme", True)]
    df = spark.createDataFrame(cases, "actor string, client string, want boolean")
    for r in df.withColumn("got", roles.is_delivery(F.col("actor"), F.col("client"))).collect():
        assert r.got == r.want, r.actor


def test_text_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.MD").write_bytes(b"bad \xff byte")
    (tmp_path / "c.rtf").write_text("no")
    documents, rejected = readers.text_documents(spark, str(tmp_path))
    texts = {r.filename: r.text for r in documents.collect()}
    assert texts["a.txt"] == TEXT and texts["b.MD"] == "bad � byte"
    assert [r.filename for r in rejected.collect()] == ["c.rtf"]


def test_checklist_is_opened_after_its_findings_have_met(spark):
    findings = spark.createDataFrame(
        [(1, 1, "offer_count", "explicit", "12 offers", "SOW-1-S01-C01", "", ""), (1, 2, "offer_count", "explicit", "15 offers", "SOW-1-S01-C01", "n", ""),
         (1, 3, "team_size", "explicit", "4", "elsewhere", "", ""), (None, 4, "team_size", "explicit", "4", "SOW-1-S01-C01", "", "")],
        "project_id int, pos int, field_key string, status string, value string, raw_key string, note string, hint string")
    keys = spark.createDataFrame([(1, "SOW-1-S01-C01")], "project_id int, chunk_key string")
    projects = spark.createDataFrame([(1,), (2,), (2,), (None,)], "project_id int")
    checklist = gaps.spine(projects.limit(1), None).select("field_key")
    fields = gaps.validated(findings, keys, projects, checklist)
    assert fields.count() == 4 * checklist.count()
    told = {(r.project_id, r.field_key): (r.status, r.value, r.note) for r in fields.filter("reported").collect()}
    assert told == {(1, "offer_count"): ("explicit", "15 offers", "n"), (1, "team_size"): ("assumed", "", "")}
    # Each project is joined once, not once for each of its fields.
    plan = gaps.grounded(fields)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join ")
