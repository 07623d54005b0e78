"""Quality gate on segmentation, one row per document and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import strip
from planloom.operators.segment import PREAMBLE, all_chunks

MIN_TOTAL_CHARS = 500
MIN_SECTIONS = 2


def measures(segmented: DataFrame) -> DataFrame:
    """Numbers the checks rest on, read off each document's own row."""
    # Looked up by position below, so these are columns, computed once per document.
    segmented = segmented.withColumn("_chunks", all_chunks())
    segmented = segmented.withColumn("_texts", F.array_sort(F.transform("_chunks", lambda c: strip(c["text"]))))
    chunks, texts = F.col("_chunks"), F.col("_texts")
    titles = F.filter(F.transform("sections", lambda s: s["title"]), lambda t: t != PREAMBLE)
    # In sorted order a text is a repeat if it equals its left neighbour, and counts once
    # where the neighbour before that differs.
    repeats = F.filter(
        F.transform(texts, lambda t, i: (i > 0) & (t == F.get(texts, i - 1)) & ((i == 1) | (t != F.get(texts, i - 2)))),
        lambda x: x,
    )
    pages = F.array_distinct(F.filter(F.transform(chunks, lambda c: c["page"]), lambda p: p.isNotNull()))
    page_count = F.col("page_count") if "page_count" in segmented.columns else F.lit(None).cast("int")
    return segmented.select(
        "project_id", "doc_key", page_count.alias("page_count"), F.size(chunks).alias("chunk_count"),
        F.aggregate(chunks, F.lit(0), lambda a, c: a + F.length(c["text"])).alias("total_chars"),
        F.size("sections").alias("section_count"),
        F.size(F.filter(chunks, lambda c: c["is_table"])).alias("table_count"),
        F.size(repeats).alias("duplicate_count"), F.size(titles).alias("titled_count"),
        F.array_join(titles, "; ").alias("all_titles"),
        F.when(
            F.coalesce(page_count, F.lit(0)) > 0,
            F.array_join(F.array_except(F.sequence(F.lit(1), page_count), pages), ", "),
        ).alias("empty_pages"),
    )


def _says(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def checks(measured: DataFrame) -> DataFrame:
    """(project_id, doc_key, check, passed, fatal, detail)."""
    n, chars, secs = F.col("chunk_count"), F.col("total_chars"), F.col("section_count")
    paged = F.coalesce(F.col("page_count"), F.lit(0)) > 0

    def check(name: str, passed: Column, detail: Column, fatal: bool = False, when: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("check"), passed.alias("passed"), F.lit(fatal).alias("fatal"), detail.alias("detail"))
        return row if when is None else F.when(when, row)

    rows = F.array(
        check("text_extracted", n > 0, _says(n, " chunks, ", chars, " characters"), True),
        check("sufficient_text", chars >= MIN_TOTAL_CHARS, _says(chars, f" characters (minimum {MIN_TOTAL_CHARS})"), True),
        check("sections_detected", secs >= MIN_SECTIONS, _says(secs, f" sections detected (minimum {MIN_SECTIONS})"), True),
        check("tables_readable", F.lit(True), _says(F.col("table_count"), " tables detected")),
        check("no_empty_pages", F.col("empty_pages") == "",
              F.when(F.col("empty_pages") != "", _says("pages without text: ", F.col("empty_pages")))
              .otherwise(_says("all ", F.col("page_count"), " pages have text")), when=paged),
        check("page_references", paged, F.when(paged, _says(F.col("page_count"), " pages tracked"))
              .otherwise("no page numbers available for this format")),
        check("no_duplicate_chunks", F.col("duplicate_count") == 0,
              F.when(F.col("duplicate_count") > 0, _says(F.col("duplicate_count"), " duplicated chunk(s) found"))
              .otherwise("no duplicates")),
        check("headings_detected", F.col("titled_count") > 0,
              _says(F.col("titled_count"), " titled sections: ", F.col("all_titles"))),
    )
    return measured.select("project_id", "doc_key", F.explode_outer(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(
        "project_id", "doc_key", "r.*"
    )


def parsing_status(checked: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checked.groupBy("project_id", "doc_key").agg(
        F.when(F.bool_or(failed & F.col("fatal")), "parsing_failed").when(F.bool_or(failed), "warn")
        .otherwise("valid").alias("parsing_status"),
        F.count_if(failed).alias("failures"),
    )


def gate(statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that go on, documents that wait for a person)."""
    failed = F.col("parsing_status") == "parsing_failed"
    return statuses.filter(~failed), statuses.filter(failed)
