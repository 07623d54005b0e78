"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.common import importable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def query(build):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(importable(spark), folder)

    QUERIES[build.__name__] = run
    return build


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.token_counts import budgets

    return budgets(table(spark, folder, "documents"), budget=1024)


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.mixing import mix

    return mix(table(spark, folder, "documents"))


@query
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, folder, "documents"))


ORACLES["op4_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.decontaminate import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.warc import archive_history

    history = archive_history(table(spark, folder, "pages"))
    return history.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.language import identify

    return identify(table(spark, folder, "documents"))


@query
def op7_class_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.class_ngrams import score_corpus

    return score_corpus(table(spark, folder, "documents"))


@query
def op6_page_text(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.page_text import main_text

    return main_text(table(spark, folder, "pages"))


@query
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query
def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.repeats import repeated_spans

    return repeated_spans(table(spark, folder, "documents")).drop("spans")


@query
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, folder, "embeddings"))


@query
def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.vector_codes import vector_codes

    return vector_codes(table(spark, folder, "embeddings"))


@query
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from planloom.llm.line_dedup import common_lines

    return common_lines(table(spark, folder, "documents"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


ORACLES["op2_near_dedup"] = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM t
), n AS (
    SELECT t.doc_id, count(s.shingle) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT n.doc_id, n.n AS n_shingles, m.y AS component_id, n.doc_id = m.y AS kept FROM n JOIN (SELECT x, min(y) AS y FROM reach GROUP BY 1) m ON m.x = n.doc_id
"""

ORACLES["op5_warc"] = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages)
SELECT page_id, strlen(h) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(s, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id < max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM d WINDOW g AS (PARTITION BY h)
"""

ORACLES["op13_line_dedup"] = r"""
WITH d AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, i, lines[i] AS line,
        translate(trim(lines[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), f AS (
    SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
), m AS (
    SELECT l.*, coalesce(f.keeper <> l.doc_id, false) AS gone FROM l LEFT JOIN f ON f.k = l.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""


def _means_sql() -> str:
    """Integer k-means, every round spelled out; exact in doubles while sums stay below 2^53."""
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    ctes = ["""v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 40))"""]
    for k in range(6):
        ctes.append(f"""a{k} AS MATERIALIZED (
    SELECT vec_id, vq AS q, c, d FROM (
        SELECT vec_id, v.q AS vq, c, list_inner_product(v.q::DOUBLE[], v.q::DOUBLE[]) - 2 * list_inner_product(v.q::DOUBLE[], m.q::DOUBLE[])
            + list_inner_product(m.q::DOUBLE[], m.q::DOUBLE[]) AS d FROM v, c{k} m)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if k < 5:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT o.c, coalesce(m.q, o.q) AS q FROM c{k} o LEFT JOIN (
        SELECT c, list({floor_mean} ORDER BY i) AS q FROM (
            SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY 1, 2) GROUP BY 1) m USING (c))""")
    return "WITH " + ",\n".join(ctes) + """
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
    CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a5 a JOIN c5 m USING (c)
"""


ORACLES["op11_centroids"] = _means_sql()


def _codes_sql() -> str:
    """Product codes by plain integer k-means of every part; exact in doubles while sums stay below 2^53."""
    ctes = ["""v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """s AS MATERIALIZED (
    SELECT vec_id, label, p, q[p * (len(q) // 4) + 1:(p + 1) * (len(q) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS p))""",
            """c0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS m FROM s WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))"""]
    for k in range(5):
        ctes.append(f"""a{k} AS MATERIALIZED (
    SELECT vec_id, label, p, x, e, d FROM (
        SELECT vec_id, label, s.p, x, e, list_inner_product(x::DOUBLE[], x::DOUBLE[]) - 2 * list_inner_product(x::DOUBLE[], m::DOUBLE[])
            + list_inner_product(m::DOUBLE[], m::DOUBLE[]) AS d FROM s JOIN c{k} c ON s.p = c.p)
    QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if k < 4:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT o.p, o.e, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (
        SELECT p, e, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
            SELECT p, e, i, sum(y) AS t, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n
        ON n.p = o.p AND n.e = o.e)""")
    return "WITH " + ",\n".join(ctes) + """,
w AS (
    SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) FROM c4) AS codebooks_sha256 FROM w
"""


ORACLES["op12_codes"] = _codes_sql()
