"""Documents into sections and citable chunks.

A document arrives as one row, and everything here happens inside that row with array
functions. Segmenting a corpus is therefore a narrow pass over the text: no shuffle, no
window, and a long document costs only its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.functions.citations import chunk_key
from planloom.functions.text import LINE_BREAK, SPACE, collapse_space, strip
from planloom.operators import windows

MAX_CHUNK_CHARS = 1200
MIN_CHUNK_CHARS = 40
PREAMBLE = "(preamble)"

# What a heading looks like, tried in this order.
EMAIL_HEADING = r"^(?i:FWD|RE|FW)[%s]*:" % SPACE
NUMBERED_HEADING = r"^\p{Nd}+(?:\.\p{Nd}+)*\.?[%s]+[^%s]" % (SPACE, SPACE)
CAPITALS_HEADING = r"^[A-Z][A-Z%s&/,'-]{3,}$" % SPACE


def blocks(text: Column) -> Column:
    """Blocks between blank lines, without underline rows."""
    parts = F.transform(F.split(text, rf"\n[{SPACE}]*\n"), strip)
    real = F.filter(parts, lambda b: F.btrim(b, F.lit("-= ")) != "")

    def without_rules(block: Column) -> Column:
        lines = F.filter(F.split(block, LINE_BREAK), lambda line: F.btrim(strip(line), F.lit("-=")) != "")
        # Most blocks are a single line and pass as they are.
        return F.when(block.rlike(LINE_BREAK), strip(F.array_join(lines, "\n"))).otherwise(block)

    return F.filter(F.transform(real, without_rules), lambda b: b != "")


def is_heading(line: Column) -> Column:
    """Whether a stripped text is a heading."""
    numbered = line.rlike(NUMBERED_HEADING)
    return (line != "") & (F.length(line) <= 120) & (
        F.when(line.rlike(EMAIL_HEADING), F.lit(True))
        # A numbered line that ends like a sentence is body text, whatever else it looks like.
        .when(numbered, ~line.endswith("."))
        .otherwise(line.rlike(CAPITALS_HEADING))
    )


def split_long(text: Column) -> Column:
    """Greedy packing of sentences into pieces; a single long sentence stays whole."""
    sentences = F.split(text, rf"(?<=[.!?])[{SPACE}]+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(acc: Column, sentence: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(sentence) + 1 > MAX_CHUNK_CHARS) & (acc["cur"] != "")
        joined = strip(F.concat(acc["cur"], F.lit(" "), sentence))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, sentence).otherwise(joined).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"])

    return F.when(F.length(text) <= MAX_CHUNK_CHARS, F.array(text)).otherwise(
        F.aggregate(sentences, start, pack, finish)
    )


def _pieces(body: Column) -> Column:
    """Citable pieces of each block; tables are exempt from the minimum length."""
    def of_block(block: Column) -> Column:
        kept = F.filter(split_long(block["text"]), lambda p: block["is_table"] | (F.length(p) >= MIN_CHUNK_CHARS))
        return F.transform(kept, lambda p: F.struct(p.alias("text"), block["page"].alias("page"),
                                                     block["is_table"].alias("is_table")))

    return F.transform(body, of_block)


def dropped_pieces(documents: DataFrame, least: int = MIN_CHUNK_CHARS) -> DataFrame:
    """(project_id, doc_key, block_no, pos, text) of the pieces too short to be cited, which chunks leave
    out: with chunk_rows() and the headings, all of a document."""
    b = F.posexplode_outer(blocks(F.col("text"))).alias("i", "block")
    body = documents.select("project_id", "doc_key", b).filter("i IS NOT NULL").filter(~is_heading(F.col("block")))
    pieces = body.select("project_id", "doc_key", (F.col("i") + 1).alias("block_no"), F.posexplode(split_long(F.col("block"))).alias("p", "text"))
    return pieces.filter(F.length("text") < least).select("project_id", "doc_key", "block_no", (F.col("p") + 1).alias("pos"), "text")


def with_sections(df: DataFrame) -> DataFrame:
    """Column `parts` (text, page, is_table) folded into `sections` (index, title, pages, chunks).

    A section starts at each heading; what stands before the first is the preamble, number 0.
    Sections without chunks vanish and their number is used again. The steps are columns of
    their own, so that each is computed once per document and not once per section.
    """
    starts = F.filter(
        F.transform("parts", lambda b, i: F.when(~b["is_table"] & is_heading(b["text"]), i)), lambda i: i.isNotNull()
    )
    df = df.withColumn("_starts", starts).withColumn("_pieces", _pieces(F.col("parts")))
    df = df.withColumn("_borders", F.concat(F.col("_starts"), F.array(F.size("parts"))))

    def section(start: Column, j: Column) -> Column:
        head = F.get(F.col("parts"), start)
        body = F.slice("_pieces", start + 2, F.get(F.col("_borders"), j + 1) - start - 1)
        return F.struct(head["text"].alias("title"), head["page"].alias("page"), F.flatten(body).alias("chunks"))

    preamble = F.struct(
        F.lit(PREAMBLE).alias("title"), F.lit(None).cast("int").alias("page"),
        F.flatten(F.slice("_pieces", F.lit(1), F.get(F.col("_borders"), F.lit(0)))).alias("chunks"),
    )
    found = F.concat(F.array(preamble), F.transform("_starts", section))
    df = df.withColumn("_found", F.filter(found, lambda s: F.size(s["chunks"]) > 0))

    def number(s: Column, i: Column) -> Column:
        pages = F.filter(F.transform(s["chunks"], lambda c: c["page"]), lambda p: p.isNotNull())
        return F.struct(
            F.when(s["title"] == PREAMBLE, 0).otherwise(i + 1).alias("section_index"), s["title"].alias("title"),
            F.coalesce(s["page"], F.get(pages, F.lit(0))).alias("page_start"),
            F.get(pages, F.size(pages) - 1).alias("page_end"), s["chunks"].alias("chunks"),
        )

    return df.withColumn("sections", F.transform("_found", number)).drop(
        "parts", "_starts", "_pieces", "_borders", "_found"
    )


def plain_blocks(text: Column) -> Column:
    """Text blocks in the shape `with_sections` takes: no pages, no tables."""
    return F.transform(
        blocks(text),
        lambda b: F.struct(b.alias("text"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("is_table")),
    )


def segment(documents: DataFrame) -> DataFrame:
    """documents(..., text) -> the same rows with `sections` in place of the text."""
    return with_sections(documents.withColumn("parts", plain_blocks(F.col("text"))).drop("text"))


def _exploded(segmented: DataFrame) -> DataFrame:
    # A plain explode makes the optimizer test the array's size below the projection that
    # builds it, which computes the whole segmentation again. The outer form does not.
    return segmented.select("project_id", "doc_key", F.explode_outer("sections").alias("s")).filter(
        F.col("s").isNotNull()
    )


def section_rows(segmented: DataFrame) -> DataFrame:
    return _exploded(segmented).select(
        "project_id", "doc_key", F.col("s.section_index"), F.col("s.title").alias("section_title"),
        F.col("s.page_start"), F.col("s.page_end"), F.size("s.chunks").alias("chunk_count"),
    )


def chunk_rows(segmented: DataFrame) -> DataFrame:
    return _exploded(segmented).select(
        "project_id", "doc_key", F.col("s.section_index").alias("section_index"),
        F.col("s.title").alias("section_title"), F.posexplode("s.chunks").alias("i", "c"),
    ).select(
        "project_id", "doc_key", "section_index", "section_title", (F.col("i") + 1).alias("chunk_index"),
        chunk_key(F.col("doc_key"), F.col("section_index"), F.col("i") + 1).alias("chunk_key"),
        F.col("c.text").alias("text"), F.col("c.page").alias("page"), F.col("c.is_table").alias("is_table"),
    )


def all_chunks(sections_col: str = "sections") -> Column:
    return F.flatten(F.transform(sections_col, lambda s: s["chunks"]))


def full_text(sections_col: str = "sections") -> Column:
    return F.array_join(F.transform(all_chunks(sections_col), lambda c: c["text"]), "\n")


def rendered_with_keys(doc_key: Column, sections_col: str = "sections") -> Column:
    """Keyed chunks under their section headings, page numbers outside the brackets."""
    def of_section(s: Column) -> Column:
        def line(c: Column, i: Column) -> Column:
            page = F.when(F.coalesce(c["page"], F.lit(0)) != 0, F.concat(F.lit("(page "), c["page"].cast("string"), F.lit(") ")))
            return F.concat(F.lit("["), chunk_key(doc_key, s["section_index"], i + 1), F.lit("] "),
                            F.coalesce(page, F.lit("")), c["text"])

        return F.concat(F.array(F.concat(F.lit("\n## "), s["title"])), F.transform(s["chunks"], line))

    return F.array_join(F.flatten(F.transform(sections_col, of_section)), "\n")


# Layout input: lines and tables with their places on the page -----------------------------


def flatten_rows(rows: Column) -> Column:
    """Table rows as lines: cells on one line each, joined by bars; rows with no text dropped."""
    def one_row(cells: Column) -> Column:
        return F.array_join(F.transform(cells, lambda c: collapse_space(F.coalesce(c, F.lit("")))), " | ")

    filled = F.filter(rows, lambda cells: F.exists(cells, lambda c: F.coalesce(c, F.lit("")) != ""))
    return F.array_join(F.transform(filled, one_row), "\n")


def lines_outside_tables(lines: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines whose start does not fall into a table box of the same page."""
    box = tables.select("doc_key", "page", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"),
                        F.col("top").alias("btop"), F.col("bottom").alias("bbottom"))
    inside = (
        (lines["doc_key"] == box["doc_key"]) & (lines["page"] == box["page"])
        & lines["top"].between(F.col("btop") - tolerance, F.col("bbottom") + tolerance)
        & lines["x0"].between(F.col("bx0") - tolerance, F.col("bx1") + tolerance)
    )
    return lines.join(box, inside, "left_anti")


def _laid_out(lines: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines outside tables and the tables themselves, in one frame dealt out by document: everything
    after it works inside documents and pages, which are bounded, and moves no row again.

    (doc_key, page, top, layer, line_no, text, inked, gap): layer 0 are tables; gap is the distance to
    the line above on the page.
    """
    rows = lines.select("doc_key", "page", "top", F.lit(1).alias("layer"), "line_no", "x0", F.lit(None).cast("struct<x0:double,x1:double,top:double,bottom:double>").alias("box"), strip(F.col("text")).alias("text"))
    side = lambda c: F.col(c).cast("double").alias(c)
    boxed = tables.select(
        "doc_key", "page", "top", F.lit(0).alias("layer"), F.lit(0).alias("line_no"), "x0", F.struct(side("x0"), side("x1"), side("top"), side("bottom")).alias("box"),
        flatten_rows(F.col("rows")).alias("text"),
    )
    dealt = rows.unionByName(boxed).repartition("doc_key")
    boxes = F.collect_list("box").over(W.partitionBy("doc_key", "page"))
    inside = F.exists(
        boxes,
        lambda b: F.col("top").between(b["top"] - tolerance, b["bottom"] + tolerance) & F.col("x0").between(b["x0"] - tolerance, b["x1"] + tolerance),
    )
    above = F.lag("top").over(W.partitionBy("doc_key", "page", "layer").orderBy("line_no"))
    return (
        dealt.withColumn("inside", inside).filter((F.col("layer") == 0) | ~F.col("inside")).drop("inside", "box", "x0")
        .withColumn("gap", F.when(F.col("layer") == 1, F.col("top") - above))
        .withColumn("inked", F.col("text") != "")
    )


def _threshold(positive: Column) -> Column:
    return F.coalesce(positive * 1.25, F.lit(float("inf")))


def gap_thresholds(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Per document with a line, the smallest positive gap times 1.25; infinite when there is none."""
    return _laid_out(lines, tables).filter("layer = 1").groupBy("doc_key").agg(
        _threshold(F.min(F.when(F.col("gap") > 0, F.col("gap")))).alias("threshold")
    )


def layout_blocks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines and tables into ordered blocks (doc_key, page, block_no, text, is_table).

    A table goes before the first line that starts at or below its top; lines within a table's box go
    with it. A new block starts at headings, after headings and tables, and where the gap to the line
    above is wide. One exchange, by document.
    """
    laid = _laid_out(lines, tables)
    limit = _threshold(F.min(F.when(F.col("gap") > 0, F.col("gap"))).over(W.partitionBy("doc_key")))
    # The gap that parts blocks counts lines with ink only.
    above = F.lag("top").over(W.partitionBy("doc_key", "page", "layer").orderBy("line_no"))
    table = F.col("layer") == 0
    marked = (
        laid.withColumn("threshold", limit).filter("inked")
        .withColumn("gap", F.when(~table, F.col("top") - above))
        .withColumn("heading", table | is_heading(F.col("text")))
        .withColumn("wide", ~table & (F.coalesce("gap", F.lit(0.0)) > F.col("threshold")))
    )
    order = W.partitionBy("doc_key", "page").orderBy("top", "layer", "line_no")
    opens = F.col("heading") | F.col("wide") | F.coalesce("after_heading", F.lit(True))
    numbered = marked.withColumn("after_heading", F.lag("heading").over(order)).withColumn(
        "block_no", F.sum(opens.cast("int")).over(order).cast("int")
    )
    # One block is one paragraph: a few lines of a page.
    return numbered.groupBy("doc_key", "page", "block_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("top", "layer", "line_no", "text"))), lambda r: r["text"]), " "
        ).alias("text"),
        F.bool_or(table).alias("is_table"),
    )


def assign_keys(new: DataFrame, existing: DataFrame, prefix: str = "SOW-") -> DataFrame:
    """(doc_id, doc_key) for documents without a key: numbers go on from the highest one ever given."""
    given = F.regexp_extract("doc_key", r"([0-9]+)$", 1)
    highest = existing.agg(F.max(F.when(given != "", given).cast("bigint"))).first()[0] or 0
    numbered = windows.row_number(new.select("doc_id"), [], windows.by_width(F.col("doc_id"), 10_000), [F.col("doc_id")], "n")
    return numbered.select("doc_id", F.format_string(f"{prefix}%03d", F.col("n") + F.lit(highest)).alias("doc_key"))
