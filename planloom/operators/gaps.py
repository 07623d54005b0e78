"""The gap audit: a checklist against what was found, and what follows from the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom import vocab
from planloom.functions.citations import normalize
from planloom.functions.text import contains_any, has_digit, or_none, quoted, strip


def non_committal(value: Column) -> Column:
    """Whether a value gestures at an answer without giving one."""
    low = F.lower(strip(value))
    return (
        (low == "") | contains_any(low, vocab.DEFERRING_MARKERS)
        | (contains_any(low, vocab.HEDGE_WORDS) & ~has_digit(low))
    )


def judged_findings(findings: DataFrame, keys: DataFrame, checklist: DataFrame) -> DataFrame:
    """Known findings with unsupported or undecided ones demoted; `why` says which."""
    # Keys are built from short columns and held to be small, however many there are.
    known = keys.select("project_id", F.col("chunk_key"), F.lit(True).alias("_known")).hint("merge")
    fields = F.broadcast(checklist.select("field_key"))
    cited = (
        findings.join(fields, "field_key", "left_semi").withColumn("chunk_key", normalize(F.col("raw_key")))
        .join(known, ["project_id", "chunk_key"], "left")
    )
    claims = F.col("status").isin("explicit", "inferred")
    uncited = claims & F.col("_known").isNull()
    vague = claims & ~uncited & non_committal(F.col("value"))
    return cited.withColumn("why", F.when(uncited, "no usable citation").when(vague, "does not settle the field")).select(
        "project_id", "pos", "field_key", "note", F.col("status").alias("claimed"), F.col("value").alias("stated"), "why",
        F.when(uncited | vague, "assumed").otherwise(F.col("status")).alias("status"),
        F.when(uncited | vague, "").otherwise(F.col("value")).alias("value"),
        F.when(vague, F.coalesce(or_none(F.col("hint")), "value")).otherwise(F.col("hint")).alias("hint"),
        F.when(F.col("_known"), F.col("chunk_key")).otherwise("").alias("evidence_key"),
    )


def validated(findings: DataFrame, keys: DataFrame, projects: DataFrame, checklist: DataFrame) -> DataFrame:
    """One row per project and checklist field: the last finding, or a gap where none was reported."""
    last = judged_findings(findings, keys, checklist).groupBy("project_id", "field_key").agg(
        F.max_by(F.struct("status", "value", "hint", "note", "evidence_key"), "pos").alias("f"))
    # A project's findings meet it as one map, no longer than the checklist, before it is opened into its fields:
    # the fields of all projects, many times their rows, are neither shuffled nor taken for a small table.
    of_project = last.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "f"))).alias("_found"))
    known = projects.select("project_id").join(of_project, "project_id", "left")
    fields = known.select("project_id", "_found", F.explode(_rows()).alias("x")).select("project_id", "x.*", F.try_element_at("_found", F.col("x.field_key")).alias("f"))
    return fields.select(
        "project_id", "field_ord", "field_key", "category", "question", "team", "default_value", "scope",
        F.col("f").isNotNull().alias("reported"),
        F.coalesce("f.status", F.lit("assumed")).alias("status"), F.coalesce("f.value", F.lit("")).alias("value"),
        F.coalesce("f.hint", F.lit("")).alias("hint"),
        F.coalesce("f.note", F.lit("The audit did not report on this field.")).alias("note"),
        F.coalesce("f.evidence_key", F.lit("")).alias("evidence_key"),
    )


def _rows() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("field_ord"), F.lit(key).alias("field_key"), F.lit(category).alias("category"),
                 F.lit(question).alias("question"), F.lit(team).alias("team"), F.lit(default).alias("default_value"),
                 F.lit(scope).alias("scope"))
        for i, (key, category, question, team, default, scope) in enumerate(vocab.CHECKLIST, start=1)
    ])


def spine(projects: DataFrame, checklist: DataFrame) -> DataFrame:
    """Every project against the fixed checklist, written as an explode of a constant."""
    return projects.select("project_id", F.explode(_rows()).alias("x")).select("project_id", "x.*")


def warnings(findings: DataFrame, keys: DataFrame, projects: DataFrame, checklist: DataFrame) -> DataFrame:
    unknown = findings.join(F.broadcast(checklist.select("field_key")), "field_key", "left_anti").select(
        "project_id", "field_key", F.concat(F.lit("gap audit returned unknown field "), quoted(F.col("field_key"))).alias("message"))
    demoted = judged_findings(findings, keys, checklist).filter("why IS NOT NULL").select(
        "project_id", "field_key",
        F.when(F.col("why") == "no usable citation", F.concat(
            F.col("field_key"), F.lit(": claimed "), F.col("claimed"), F.lit(" with no usable citation, downgraded to assumed")))
        .otherwise(F.concat(F.col("field_key"), F.lit(": value "), quoted(F.col("stated")),
                            F.lit(" does not settle the field, downgraded to assumed"))).alias("message"))
    silent = validated(findings, keys, projects, checklist).filter("NOT reported").select(
        "project_id", "field_key",
        F.concat(F.col("field_key"), F.lit(": not reported by the gap audit, treated as a gap")).alias("message"))
    return unknown.unionByName(demoted).unionByName(silent)


def _open(fields: DataFrame) -> DataFrame:
    """Unsettled fields numbered in checklist order: at most as many rows per project as the checklist has."""
    return fields.filter(F.col("status") == "assumed").withColumn(
        "n", F.row_number().over(W.partitionBy("project_id").orderBy("field_ord"))
    ).withColumn("hint", strip(F.col("hint")))


def working_value() -> Column:
    return F.when(F.col("hint") != "", F.col("hint")).otherwise(F.col("default_value"))


def assumptions(fields: DataFrame) -> DataFrame:
    confidence = F.lit(vocab.DEFAULT_CONFIDENCE)
    for category, value in vocab.CONFIDENCE_BY_CATEGORY.items():
        confidence = F.when(F.col("category") == category, value).otherwise(confidence)
    hinted = F.col("hint") != ""
    note = strip(F.col("note"))
    reason = F.when(note != "", note).otherwise(
        F.concat(F.lit("The SOW does not specify the "), F.replace(F.col("field_key"), F.lit("_"), F.lit(" ")), F.lit(".")))
    return _open(fields).select(
        "project_id", F.format_string("A-%03d", "n").alias("assumption_key"), "category", working_value().alias("value"),
        F.when(hinted, F.concat(reason, F.lit(" Using the direction the SOW indicates rather than a default.")))
        .otherwise(reason).alias("reason"),
        F.round(F.when(hinted, F.least(confidence + 0.1, F.lit(1.0))).otherwise(confidence), 6).alias("confidence"),
    )


def questions(fields: DataFrame) -> DataFrame:
    return _open(fields).select(
        "project_id", F.format_string("Q-%03d", "n").alias("question_key"), "scope", "category", "field_key", "team",
        F.col("question").alias("text"), working_value().alias("working_assumption"))


def grounded(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("status").isin("explicit", "inferred") & (F.col("value") != ""))


def coverage(projects: DataFrame, open_questions: DataFrame, assumption_rows: DataFrame) -> DataFrame:
    """Checked, answered and open fields; reliable when the assumptions agree in number."""
    checked = len(vocab.CHECKLIST)
    known = [row[0] for row in vocab.CHECKLIST]
    opened = open_questions.filter(F.col("field_key").isin(known)).groupBy("project_id").agg(
        F.count_distinct("field_key").alias("open"))
    assumed = assumption_rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("assumed"))
    joined = projects.select("project_id").join(opened, "project_id", "left").join(assumed, "project_id", "left")
    n = F.coalesce("open", F.lit(0))
    return joined.select(
        "project_id", F.lit(checked).alias("checked"), (F.lit(checked) - n).alias("answered"), n.alias("open"),
        (n == F.coalesce("assumed", F.lit(0))).alias("reliable"))


def working_values(fields: DataFrame) -> DataFrame:
    stated = (F.col("status") != "assumed") & (F.col("value") != "")
    return fields.select(
        "project_id", "field_ord", "field_key",
        F.when(stated, F.concat(F.lit("- "), F.col("field_key"), F.lit(": "), F.col("value"), F.lit(" (stated in the SOW)")))
        .otherwise(F.concat(F.lit("- "), F.col("field_key"), F.lit(": "), working_value(),
                            F.lit(" (assumed, not in the SOW)"))).alias("line"))


def by_scope(projects: DataFrame, question_rows: DataFrame) -> DataFrame:
    """Question counts per scope; every scope is there even when empty."""
    scopes = projects.select("project_id", F.explode(F.array(*[F.lit(s) for s in vocab.SCOPES])).alias("scope"))
    counts = question_rows.groupBy("project_id", "scope").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("question_key")), ",").alias("keys"))
    return scopes.join(counts, ["project_id", "scope"], "left").select(
        "project_id", "scope", F.coalesce("n", F.lit(0)).alias("questions"), F.coalesce("keys", F.lit("")).alias("question_keys"))
