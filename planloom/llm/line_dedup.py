"""Lines that many documents share, removed by built-in DataFrame functions only.

Lines are exploded, normalised and hashed; hashes are counted with map-side combine before anything
is shuffled, so a line that stands in every document costs one row per task. Only lines whose hash
occurs often enough go on: they meet their counts in a join of two written tables, which adaptive
execution splits where one line has many rows. What comes back to a document are the places of its
dropped lines, and the rest is put together in order of place.

Hashes have 128 bits (two of 64 with different seeds), so lines of any corpus are told apart in practice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import discard, lower_ascii, stored, text_of

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
ROW = ["id", "t"]


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def long_lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """(id, t, pos, h1, h2) of every line whose key is long enough; texts has id, t and text."""
    lines = texts.select(*ROW, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select(*ROW, "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    return keys.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def often(lines: DataFrame, least_documents: int) -> DataFrame:
    """The lines whose key occurs at least so many times. Its keys are written first, so that the join
    can split a key with many lines."""
    keys = stored(lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_documents).select(*KEY))
    return lines.join(keys, KEY, "left_semi")


def frequent_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """(h1, h2, keeper): keys found under at least so many ids, with the greatest of them. A null id
    counts as one more id, less than any other."""
    counted = lines.select(*KEY, "id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    return counted.filter(F.col("n") >= least_documents).select(*KEY, "keeper")


def cut_points(lines: Column, places: Column) -> Column:
    """Places to leave out (0-based, ascending), with one before the first and one after the last."""
    return F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))


def between(lines: Column, cuts: Column) -> Column:
    """The elements between the cut points, one stretch after the other: linear in the array's length
    where both arguments are columns of their own, which a lambda looks up and does not compute."""
    stretch = lambda k: F.slice(lines, F.get(cuts, k - 1) + 2, F.get(cuts, k) - F.get(cuts, k - 1) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), stretch))


def without_common_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document row: id, n_lines, n_dropped, kept_text.

    A text is split at every \\n; null and empty texts are one empty line. A line whose key (blanks at
    both ends stripped, A-Z lower-cased) has at least `least_chars` code points and is found in at least
    `least_documents` documents is dropped everywhere but in the document of the greatest id that holds
    it, where every one of its lines stays. Documents are told apart by id: rows that share an id count
    once, and all of them keep what the greatest id keeps; a null id counts as the least. Repeated rows
    stay repeated. A text that loses every line is empty. Tables without rows give no rows. Other
    columns are not read.
    """
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("t"), "text")
    lines = stored(long_lines(given, least_chars))
    again = stored(often(lines, least_documents))
    discard(lines)
    frequent = stored(frequent_keys(again, least_documents))
    # Both sides are written: a line with many rows is split over tasks.
    dropped = again.join(frequent, KEY).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    places = stored(dropped.groupBy(*ROW).agg(F.array_sort(F.collect_set("pos")).alias("places")))
    marks = places.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "places")
    met = given.join(marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    split = met.select("id", "text", F.split("text", "\n").alias("lines"), "places")
    split = split.select("*", cut_points(F.col("lines"), F.col("places")).alias("cuts"))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(between(F.col("lines"), F.col("cuts")), "\n"))
    return split.select(
        F.col("id").alias(id_col), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"),
    )


def common_lines(docs: DataFrame, **options) -> DataFrame:
    """without_common_lines() with kept_sha256, the SHA-256 of the text that is left, in place of it."""
    rows = without_common_lines(docs, **options)
    return rows.withColumn("kept_text", F.sha2(F.encode("kept_text", "UTF-8"), 256)).withColumnRenamed("kept_text", "kept_sha256")
