"""Segmentation and the corpus quality gate."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.operators import quality, segment
from planloom.plans.adapters import DUCK, SPARK_ONLY, _doc_key
from planloom.plans.registry import query

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def duck_heading(x: str) -> str:
    return (
        f"({x} <> '' AND length({x}) <= 120 AND CASE WHEN regexp_matches({x}, '^(?i:FWD|RE|FW)[{WS}]*:') THEN true "
        f"WHEN regexp_matches({x}, '^\\p{{Nd}}+(\\.\\p{{Nd}}+)*\\.?[{WS}]+[^{WS}]') THEN {x} NOT LIKE '%.' "
        f"ELSE regexp_matches({x}, '^[A-Z][A-Z{WS}&/,''-]{{3,}}$') END)"
    )


DUCK["v_blocks"] = f"""
SELECT project_id, doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY i) AS INT) AS block_no, text FROM (
  SELECT project_id, doc_key, i, {duck_strip("array_to_string(list_filter(string_split_regex(b, '[\\n\\r]'), lambda l: NOT regexp_matches(" + duck_strip('l') + ", '^[-=]*$')), chr(10))")} AS text
  FROM (SELECT project_id, doc_key, unnest(range(1, len(parts) + 1)) AS i, {duck_strip('unnest(parts)')} AS b
        FROM (SELECT project_id, doc_key, string_split_regex(text, '\\n[{WS}]*\\n') AS parts FROM v_docs))
  WHERE NOT regexp_matches(b, '^[-= ]*$')) WHERE text <> ''"""
DUCK["v_runs"] = f"""
SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY block_no) AS run
FROM (SELECT *, {duck_heading('text')} AS heading FROM v_blocks)"""
# Packing by a reduction over sentences; pieces are parted by a control character.
DUCK["v_pieces"] = f"""
SELECT project_id, doc_key, run, block_no, pos, {duck_strip('piece')} AS text FROM (
  SELECT project_id, doc_key, run, block_no, unnest(range(1, len(ps) + 1)) AS pos, unnest(ps) AS piece FROM (
    SELECT *, CASE WHEN length(text) <= 1200 THEN [text] ELSE string_split(list_reduce(
      string_split(regexp_replace(text, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)),
      lambda acc, s: CASE WHEN length(string_split(acc, chr(2))[-1]) + length(s) + 1 > 1200 THEN acc || chr(2) || s ELSE acc || ' ' || s END), chr(2)) END AS ps
    FROM v_runs WHERE NOT heading))"""
DUCK["v_doc_chunks"] = """
SELECT *, doc_key || printf('-S%02d-C%02d', section_index, chunk_index) AS chunk_key FROM (
  SELECT p.project_id, p.doc_key, CASE WHEN p.run = 0 THEN '(preamble)' ELSE h.text END AS section_title, p.text,
         CAST(CASE WHEN p.run = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY p.doc_key ORDER BY p.run) END AS INT) AS section_index,
         CAST(row_number() OVER (PARTITION BY p.doc_key, p.run ORDER BY p.block_no, p.pos) AS INT) AS chunk_index
  FROM v_pieces p LEFT JOIN v_runs h ON h.doc_key = p.doc_key AND h.run = p.run AND h.heading
  WHERE length(p.text) >= 40)"""
DUCK["v_measures"] = """
SELECT d.project_id, d.doc_key, coalesce(n, 0) AS chunk_count, coalesce(chars, 0) AS total_chars, coalesce(secs, 0) AS section_count,
       coalesce(dups, 0) AS duplicate_count, coalesce(titled, 0) AS titled_count, coalesce(all_titles, '') AS all_titles
FROM v_docs d
LEFT JOIN (SELECT doc_key, count(*) AS n, sum(length(text)) AS chars, count(DISTINCT section_index) AS secs,
                  count(DISTINCT section_index) FILTER (WHERE section_index > 0) AS titled FROM v_doc_chunks GROUP BY 1) c USING (doc_key)
LEFT JOIN (SELECT doc_key, count(*) AS dups FROM (SELECT doc_key, text FROM v_doc_chunks GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) x USING (doc_key)
LEFT JOIN (SELECT doc_key, string_agg(section_title, '; ' ORDER BY section_index) AS all_titles FROM (
  SELECT DISTINCT doc_key, section_index, section_title FROM v_doc_chunks WHERE section_index > 0) GROUP BY 1) t USING (doc_key)"""
DUCK["v_checks"] = """
SELECT project_id, doc_key, 'text_extracted' AS "check", chunk_count > 0 AS passed, true AS fatal, chunk_count || ' chunks, ' || total_chars || ' characters' AS detail FROM v_measures
UNION ALL SELECT project_id, doc_key, 'sufficient_text', total_chars >= 500, true, total_chars || ' characters (minimum 500)' FROM v_measures
UNION ALL SELECT project_id, doc_key, 'sections_detected', section_count >= 2, true, section_count || ' sections detected (minimum 2)' FROM v_measures
UNION ALL SELECT project_id, doc_key, 'tables_readable', true, false, '0 tables detected' FROM v_measures
UNION ALL SELECT project_id, doc_key, 'page_references', false, false, 'no page numbers available for this format' FROM v_measures
UNION ALL SELECT project_id, doc_key, 'no_duplicate_chunks', duplicate_count = 0, false, CASE WHEN duplicate_count > 0 THEN duplicate_count || ' duplicated chunk(s) found' ELSE 'no duplicates' END FROM v_measures
UNION ALL SELECT project_id, doc_key, 'headings_detected', titled_count > 0, false, titled_count || ' titled sections: ' || all_titles FROM v_measures"""
DUCK["v_status"] = """
SELECT project_id, doc_key, CASE WHEN bool_or(NOT passed AND fatal) THEN 'parsing_failed' WHEN bool_or(NOT passed) THEN 'warn' ELSE 'valid' END AS parsing_status,
       count(*) FILTER (WHERE NOT passed) AS failures FROM v_checks GROUP BY 1, 2"""


def segmented(c):
    return segment.segment(c.view("v_docs").select("project_id", "doc_key", "text"))


@query("doc_blocks", "SELECT doc_key, block_no, text FROM v_blocks")
def _(c):
    b = F.posexplode_outer(segment.blocks(F.col("text"))).alias("i", "text")
    return c.view("v_docs").select("doc_key", b).filter("i IS NOT NULL").select("doc_key", (F.col("i") + 1).alias("block_no"), "text")


@query("doc_sections", "SELECT doc_key, section_index, section_title, CAST(count(*) AS INT) AS chunk_count FROM v_doc_chunks GROUP BY ALL")
def _(c):
    return segment.section_rows(segmented(c)).select("doc_key", "section_index", "section_title", "chunk_count")


@query("doc_split_long", "SELECT doc_key, block_no, CAST(pos AS INT) AS pos, text FROM v_pieces")
def _(c):
    b = F.posexplode_outer(segment.blocks(F.col("text"))).alias("i", "block")
    body = c.view("v_docs").select("doc_key", b).filter("i IS NOT NULL").filter(~segment.is_heading(F.col("block")))
    return body.select("doc_key", (F.col("i") + 1).alias("block_no"), F.posexplode(segment.split_long(F.col("block"))).alias("p", "text")).select(
        "doc_key", "block_no", (F.col("p") + 1).alias("pos"), "text")


@query("doc_chunks", "SELECT doc_key, section_index, section_title, chunk_index, text FROM v_doc_chunks")
def _(c):
    return segment.chunk_rows(segmented(c)).select("doc_key", "section_index", "section_title", "chunk_index", "text")


@query("doc_dropped_pieces", "SELECT doc_key, block_no, CAST(pos AS INT) AS pos, text FROM v_pieces WHERE length(text) < 40")
def _(c):
    return segment.dropped_pieces(c.view("v_docs").select("project_id", "doc_key", "text")).select("doc_key", "block_no", "pos", "text")


@query("doc_chunk_key", "SELECT doc_key, section_index, chunk_index, chunk_key FROM v_doc_chunks")
def _(c):
    return segment.chunk_rows(segmented(c)).select("doc_key", "section_index", "chunk_index", "chunk_key")


@query("doc_full_text", """
SELECT doc_key, coalesce(string_agg(c.text, chr(10) ORDER BY section_index, chunk_index), '') AS full_text FROM v_docs d LEFT JOIN (SELECT doc_key, text, section_index, chunk_index FROM v_doc_chunks) c USING (doc_key) GROUP BY 1""")
def _(c):
    return segmented(c).select("doc_key", segment.full_text().alias("full_text"))


@query("doc_render_keyed", """
SELECT d.doc_key, coalesce(string_agg(CASE WHEN chunk_index = 1 THEN chr(10) || '## ' || section_title || chr(10) ELSE '' END || '[' || chunk_key || '] ' || c.text, chr(10)
       ORDER BY section_index, chunk_index), '') AS rendered FROM v_docs d LEFT JOIN v_doc_chunks c USING (doc_key) GROUP BY 1""")
def _(c):
    return segmented(c).select("doc_key", segment.rendered_with_keys(F.col("doc_key")).alias("rendered"))


# Layout ----------------------------------------------------------------------------------

DUCK["v_layout_tables"] = f"""
SELECT {_doc_key('doc_id')} AS doc_key, CAST(1 AS INT) AS page, CAST(40.0 AS DOUBLE) AS x0, CAST(50.0 AS DOUBLE) AS top, CAST(500.0 AS DOUBLE) AS x1,
       CAST(66.0 AS DOUBLE) AS bottom, [['Lang', lang, NULL], ['', NULL, ''], ['Source  of' || chr(10) || 'text', source, n_chars || '']] AS "rows" FROM documents"""


def _layout_tables(c):
    def texts(*cells):
        return F.array(*[x if not isinstance(x, str) else F.lit(x) for x in cells])

    none = F.lit(None).cast("string")
    rows = F.array(
        texts("Lang", F.col("lang"), none), texts("", none, ""),
        texts("Source  of\ntext", F.col("source"), F.col("n_chars").cast("string")),
    )
    return c.table("documents").select(
        F.expr(_doc_key("doc_id")).alias("doc_key"), F.lit(1).alias("page"), F.lit(40.0).alias("x0"),
        F.lit(50.0).alias("top"), F.lit(500.0).alias("x1"), F.lit(66.0).alias("bottom"), rows.alias("rows"))


SPARK_ONLY["v_layout_tables"] = _layout_tables


@query("doc_lines_in_tables", "SELECT doc_key, line_no, page FROM v_lines WHERE NOT (page = 1 AND top BETWEEN 48 AND 68)")
def _(c):
    return segment.lines_outside_tables(c.view("v_lines"), c.view("v_layout_tables")).select("doc_key", "line_no", "page")


DUCK["v_clear"] = "SELECT * FROM v_lines WHERE NOT (page = 1 AND top BETWEEN 48 AND 68)"
DUCK["v_gaps"] = "SELECT *, top - lag(top) OVER (PARTITION BY doc_key, page ORDER BY line_no) AS gap FROM v_clear"


@query("doc_gap_threshold", "SELECT doc_key, coalesce(min(gap) FILTER (WHERE gap > 0) * 1.25, CAST('inf' AS DOUBLE)) AS threshold FROM v_gaps GROUP BY 1")
def _(c):
    return segment.gap_thresholds(c.view("v_lines"), c.view("v_layout_tables"))


DUCK["v_layout"] = f"""
SELECT doc_key, page, CAST(block_no AS INT) AS block_no, string_agg(text, ' ' ORDER BY top, layer, line_no) AS text, bool_or(is_table) AS is_table FROM (
  SELECT *, sum(CASE WHEN heading OR wide OR coalesce(lh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key, page ORDER BY top, layer, line_no) AS block_no FROM (
    SELECT *, lag(heading) OVER (PARTITION BY doc_key, page ORDER BY top, layer, line_no) AS lh FROM (
      SELECT g.doc_key, page, top, 1 AS layer, line_no, t AS text, false AS is_table, {duck_heading('t')} AS heading, coalesce(gap, 0) > threshold AS wide
      FROM (SELECT *, top - lag(top) OVER (PARTITION BY doc_key, page ORDER BY line_no) AS gap FROM (SELECT * EXCLUDE (text), {duck_strip('text')} AS t FROM v_clear) WHERE t <> '') g
      JOIN (SELECT doc_key, coalesce(min(gap) FILTER (WHERE gap > 0) * 1.25, CAST('inf' AS DOUBLE)) AS threshold FROM v_gaps GROUP BY 1) h USING (doc_key)
      UNION ALL
      SELECT doc_key, page, top, 0, 0, 'Lang | ' || "rows"[1][2] || ' | ' || chr(10) || 'Source of text | ' || "rows"[3][2] || ' | ' || "rows"[3][3], true, true, false FROM v_layout_tables)))
GROUP BY 1, 2, 3"""


def layout(c):
    return segment.layout_blocks(c.view("v_lines"), c.view("v_layout_tables"))


@query("doc_line_paragraphs", "SELECT * FROM v_layout")
def _(c):
    return layout(c)


@query("src_layout_lines", "SELECT doc_key, page, count(*) AS blocks, count(*) FILTER (WHERE is_table) AS tables FROM v_layout GROUP BY 1, 2")
def _(c):
    return layout(c).groupBy("doc_key", "page").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("is_table").alias("tables"))


@query("doc_section_pages", f"""
SELECT doc_key, CAST(run AS INT) AS run, title, page_start, page_end FROM (
  SELECT doc_key, run, max(CASE WHEN heading THEN text END) AS title,
         coalesce(max(CASE WHEN heading THEN page END), min(CASE WHEN body THEN page END)) AS page_start, max(CASE WHEN body THEN page END) AS page_end, bool_or(body) AS kept
  FROM (SELECT *, NOT heading AND (is_table OR longest >= 40) AS body FROM (
    SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key ORDER BY page, block_no) AS run,
           CASE WHEN length(text) <= 1200 THEN length(text) ELSE 1200 END AS longest
    FROM (SELECT *, NOT is_table AND {duck_heading('text')} AS heading FROM v_layout)))
  GROUP BY 1, 2) WHERE kept AND run > 0""")
def _(c):
    marked = layout(c).withColumn("heading", ~F.col("is_table") & segment.is_heading(F.col("text")))
    in_order = W.partitionBy("doc_key").orderBy("page", "block_no")
    numbered = marked.withColumn("run", F.sum(F.col("heading").cast("int")).over(in_order).cast("int"))
    has_piece = F.exists(segment.split_long(F.col("text")), lambda p: F.length(p) >= segment.MIN_CHUNK_CHARS)
    body = ~F.col("heading") & (F.col("is_table") | has_piece)
    pages = numbered.withColumn("body", body).groupBy("doc_key", "run").agg(
        F.max(F.when(F.col("heading"), F.col("text"))).alias("title"),
        F.coalesce(F.max(F.when(F.col("heading"), F.col("page"))), F.min(F.when(F.col("body"), F.col("page")))).alias("page_start"),
        F.max(F.when(F.col("body"), F.col("page"))).alias("page_end"), F.bool_or("body").alias("kept"),
    )
    return pages.filter("kept AND run > 0").drop("kept")


# Quality ---------------------------------------------------------------------------------


def checked(c):
    return quality.checks(quality.measures(segmented(c)))


def _one_check(query_id: str, name: str) -> None:
    @query(query_id, f"""SELECT doc_key, passed, detail FROM v_checks WHERE "check" = '{name}'""")
    def _(c):
        return checked(c).filter(F.col("check") == name).select("doc_key", "passed", "detail")


for _id, _name in [
    ("pq_text_extracted", "text_extracted"), ("pq_sufficient_text", "sufficient_text"), ("pq_sections", "sections_detected"),
    ("pq_tables", "tables_readable"), ("pq_page_refs", "page_references"), ("pq_duplicates", "no_duplicate_chunks"),
    ("pq_headings", "headings_detected"),
]:
    _one_check(_id, _name)


@query("pq_empty_pages", f"""
SELECT doc_key, page_count, coalesce(missing, '') AS empty_pages FROM (SELECT doc_key, CAST(max(page) + doc_key_n % 3 AS INT) AS page_count FROM (
  SELECT *, CAST(substr(doc_key, 5) AS INT) AS doc_key_n FROM v_layout) GROUP BY doc_key, doc_key_n) p
LEFT JOIN (SELECT doc_key, string_agg(k, ', ' ORDER BY k) AS missing FROM (
  SELECT doc_key, unnest(range(1, max(page) + CAST(substr(doc_key, 5) AS INT) % 3 + 1)) AS k FROM v_layout GROUP BY doc_key)
  WHERE (doc_key, k) NOT IN (SELECT (doc_key, page) FROM v_layout WHERE is_table OR NOT {duck_heading('text')} AND length(text) >= 40) GROUP BY 1) m USING (doc_key)""")
def _(c):
    # Documents with pages; some claim more pages than carry a citable piece.
    part = F.struct("page", "block_no", "text", "is_table")
    extra = F.substring("doc_key", 5, 20).cast("int") % 3
    paged = layout(c).groupBy("doc_key").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("page").alias("last_page")).select(
        F.lit(0).alias("project_id"), "doc_key", (F.col("last_page") + extra).cast("int").alias("page_count"),
        F.transform("parts", lambda b: F.struct(b["text"].alias("text"), b["page"].alias("page"), b["is_table"].alias("is_table"))).alias("parts"))
    return quality.measures(segment.with_sections(paged)).select("doc_key", "page_count", F.coalesce("empty_pages", F.lit("")).alias("empty_pages"))


@query("pq_status", "SELECT doc_key, parsing_status, failures FROM v_status")
def _(c):
    return quality.parsing_status(checked(c)).select("doc_key", "parsing_status", "failures")


@query("pq_gate", """
SELECT doc_key, parsing_status, 'passed' AS route FROM v_status WHERE parsing_status <> 'parsing_failed'
UNION ALL SELECT doc_key, parsing_status, 'quarantine' FROM v_status WHERE parsing_status = 'parsing_failed'""")
def _(c):
    passed, waiting = quality.gate(quality.parsing_status(checked(c)).select("doc_key", "parsing_status"))
    return passed.withColumn("route", F.lit("passed")).unionByName(waiting.withColumn("route", F.lit("quarantine")))
