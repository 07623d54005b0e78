"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and numbered:
their names. Then adjacent names of a document are paired, the distinct pairs are sorted and
named in turn, and so on, until one name is left. Two documents with as many blocks have the same
last name exactly if their texts are equal: a name stands for one content, never for a hash of it.
Fingerprints only route rows: blocks that share one without being equal are named by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import lower_ascii, stored, text_of

BLOCK_BYTES = 4096


def hash_of(block: Column) -> Column:
    return F.xxhash64(block)


def blocks_of(text: Column, size: int) -> Column:
    raw = F.encode(text, "UTF-8")
    starts = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text), F.lit(size))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda at: F.substring(raw, at, F.lit(size)))


def _named(values: DataFrame, order: list[str]) -> DataFrame:
    """Number distinct rows: in order within each part, the part in the upper bits. Written, so
    that a name never changes once it has been given."""
    return stored(values.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()))


def block_names(docs: DataFrame, size: int, fingerprint) -> tuple[DataFrame, DataFrame | None]:
    """Names by fingerprint: (f, name). Where blocks share one, (f, block, name) beside it."""
    blocks = docs.select(F.explode(blocks_of(F.col("text"), size)).alias("block")).withColumn("f", fingerprint(F.col("block")))
    # The least and the greatest block of a fingerprint are the same one unless blocks share it.
    # Copies are merged before the shuffle.
    ends = blocks.groupBy("f").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    names = stored(
        ends.sortWithinPartitions("low").select("f", F.monotonically_increasing_id().alias("name"), (F.col("low") != F.col("high")).alias("shared"))
    )
    shared = names.filter("shared").select("f")
    if shared.isEmpty():
        return names.select("f", "name"), None
    by_content = _named(blocks.join(shared, "f", "left_semi").groupBy("f", "block").agg(F.count(F.lit(1)).alias("n")).drop("n"), ["f", "block"])
    # Names of the two tables must differ: odd here, even there.
    return (
        names.filter("NOT shared").select("f", (F.col("name") * 2).alias("name")),
        by_content.withColumn("name", F.col("name") * 2 + 1),
    )


def identities(docs: DataFrame, size: int = BLOCK_BYTES, fingerprint=hash_of) -> DataFrame:
    """(row, id, sha256, n_blocks, name) of (id, text) rows; text normalised and not null. Rows of
    equal texts, and only those, agree in (n_blocks, name)."""
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"),
        blocks_of(F.col("text"), size).alias("blocks"),
    ).select("row", "id", "sha256", F.size("blocks").alias("n_blocks"), F.transform("blocks", fingerprint).alias("f")))
    names, by_content = block_names(docs, size, fingerprint)
    parts = rows.select("row", "n_blocks", F.posexplode("f").alias("at", "f"))
    if by_content is None:
        level = parts.join(names, "f")
    else:
        # The rare path carries the contents again: names by (fingerprint, block).
        again = docs.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.posexplode(blocks_of(F.col("text"), size)).alias("at", "block"))
        again = again.withColumn("f", fingerprint(F.col("block"))).join(by_content, ["f", "block"])
        again = again.groupBy("sha256", "at").agg(F.min("name").alias("name"), F.max("name").alias("other"))
        again = again.withColumn("name", F.when(F.col("name") == F.col("other"), F.col("name")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")))).drop("other")
        sure = parts.join(names, "f").select("row", "n_blocks", "at", "name")
        rest = parts.join(names, "f", "left_anti").join(rows.select("row", "sha256"), "row").join(again, ["sha256", "at"])
        level = sure.unionByName(rest.select("row", "n_blocks", "at", "name"))
    level = stored(level.select("row", "n_blocks", "at", "name"))
    longest = level.agg(F.max("n_blocks")).first()[0] or 0
    done = [level.filter("n_blocks = 1").select("row", "name")]
    level, width = level.filter("n_blocks > 1"), 1
    while width < longest:
        # Pair neighbours. A last name without one is paired with -1, which names nothing.
        side = F.col("at") % 2
        pairs = stored(
            level.groupBy("row", "n_blocks", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
                F.max(F.when(side == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).cast("bigint").alias("b"),
            )
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        width *= 2
        named = stored(pairs.join(names, ["a", "b"]).select("row", "n_blocks", "at", "name"))
        done.append(named.filter(F.col("n_blocks") <= width).select("row", "name"))
        level = named.filter(F.col("n_blocks") > width)
    last = done[0]
    for more in done[1:]:
        last = last.unionAll(more)
    return (
        rows.drop("f").join(last, "row", "left")
        .withColumn("name", F.coalesce("name", F.lit(-1)))
    )


def exact_duplicates(
    docs: DataFrame, size: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", fingerprint=hash_of,
) -> DataFrame:
    """One row per document: id, keep_id (greatest id among equal texts), group_size, kept, and
    text_sha256 of the normalised text.

    Texts are equal when identical after lower-casing A-Z. A null text is empty, and empty texts
    are one group. A null id is the least. Rows repeated with the same id are copies like any
    other: one of them is kept. An empty table gives an empty result. Other columns are not read.
    """
    given = docs.select(F.col(id_col).alias("id"), lower_ascii(text_of(text_col)).alias("text"))
    rows = stored(identities(given, size, fingerprint))
    # Written, so that the join below may split the rows of a large group over tasks.
    groups = stored(rows.groupBy("n_blocks", "name").agg(
        F.max(F.struct("id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")
    ))
    return rows.join(groups, ["n_blocks", "name"]).select(
        F.col("id").alias(id_col), F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_duplicates() keeps, with all their columns. Of rows repeated with
    the same id and text one stays."""
    spare = "_text_sha256"
    while spare in docs.columns:
        spare += "_"
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col)
    keep = found.filter("kept").select(F.col(id_col).alias("_i"), F.col("text_sha256").alias("_s"))
    digest = F.sha2(F.encode(lower_ascii(text_of(text_col)), "UTF-8"), 256)
    marked = docs.withColumn(spare, digest)
    kept = marked.join(keep, marked[id_col].eqNullSafe(keep["_i"]) & (marked[spare] == keep["_s"]), "left_semi")
    repeats = found.groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates([id_col, spare])
    return kept.drop(spare)
