"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is sketched in registers: shingles are dealt into buckets by their
hash, and a bucket keeps its least value as the number of leading zeros and a few bits after the
first one. Buckets that stay empty take the register of a bucket that did not, in an order of their
own, so two sets agree in any register with a probability of their Jaccard similarity. Runs of
registers (bands) bring likely pairs together; the share of equal registers, corrected for chance
agreement, says which of them are worth checking; full shingle sets decide.

Nothing grows with the square of a group's size unless its texts really differ: documents of equal sets
are one class; in a band's bucket and in a family every class is compared with one pivot, and only
those that are apart from the pivot meet the rest, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.bytewords import mix, texts_in_chunks
from planloom.llm.common import map_batches, stored, text_of
from planloom.llm.components import components, near_labels

#: Bands of so many registers each. A pair at similarity 0.8 shares no band with probability
#: (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations of the estimate that a pair may lie below the threshold and still be checked.
SLACK = 4.0
#: Classes compared with each other in one task at a time.
BLOCK = 256

_FILL = np.random.default_rng(77).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1).astype(np.int32)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _place(k: int) -> np.uint64:
    """A number for the k-th word of a shingle."""
    return np.uint64(int(_ODD[k % 4]) * (k + 1) % 2**64)


def shingle_sets(texts: list[bytes], size: int):
    """The distinct shingle hashes of each text, sorted. Fewer words than a shingle has: all of them
    as one; none: empty."""
    for _, _, _, hashes, _, _, borders in texts_in_chunks(texts):
        n = len(hashes) - size + 1
        if n > 0:
            whole = np.zeros(n, np.uint64)
            for k in range(size):
                whole += mix(hashes[k:n + k] + _place(k)) * _ODD[(k + 1) % 4]
            whole = mix(whole)
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(whole[a:b - size + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    one = mix(one * _ODD[0] + h + np.uint64(b - a))
                yield one
            else:
                yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted, non-empty set: leading zeros of the bucket's least value
    above the bits that follow its first one."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    least = np.minimum.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), first)
    length = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(np.uint64(64) - np.minimum(length, np.uint64(64)), np.uint64(63))
    after = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out, full = np.zeros(REGISTERS, np.uint16), bucket[first]
    out[full] = (zeros << np.uint64(MANTISSA) | after).astype(np.uint16)
    if len(full) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[full[_FILL[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def zero_law(n: np.ndarray) -> np.ndarray:
    """(sizes, zeros): how likely a register of a set of each size has so many leading zeros."""
    at_least = 1 - (1 - 2.0 ** -np.arange(41.0)[None, :]) ** np.maximum(np.asarray(n, float)[:, None] / REGISTERS, 1)
    return at_least[:, :-1] - at_least[:, 1:]


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that registers of sets with these laws agree without a shingle in common: equal
    leading zeros, and equal bits after them."""
    return (a * b).sum(axis=1) * 2.0**-MANTISSA


def estimate(equal: np.ndarray, by_chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what agrees by chance."""
    return (equal - by_chance) / (1 - by_chance)


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - SLACK * (s * (1 - s) / REGISTERS) ** 0.5


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, t, n, s, regs) of (id, t, text): set size, 128-bit digest of the set, its registers."""
    kind = docs.schema["id"].dataType.simpleString()

    def build():
        def step(batch):
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = list(shingle_sets([t.as_py().encode() for t in part.column(2)], size))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], names=["id", "t", "n", "s", "regs"])

        return step

    return map_batches(docs.select("id", "t", "text"), build, f"id {kind}, t bigint, n bigint, s binary, regs binary")


def bands(classes: DataFrame) -> DataFrame:
    """(c, key): a row per band of every class."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("regs", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return classes.select("c", F.explode(keys).alias("key"))


def _similar(frame: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, ra, nb, rb), those whose estimate is high enough: (a, b)."""
    least = least_estimate(percent)

    def build():
        def step(batch):
            if len(batch):
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (3, 5))
                na, nb = (batch.column(k).to_numpy() for k in (2, 4))
                good = estimate((ra == rb).mean(axis=1), chance(zero_law(na), zero_law(nb))) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

        return step

    return map_batches(frame.select("a", "b", "na", "ra", "nb", "rb"), build, "a bigint, b bigint")


def _close(regs: np.ndarray, n: np.ndarray, least: float):
    """close(i): which sets the estimate lets be as similar to set i as wanted."""
    law = zero_law(n)
    return lambda i: estimate((regs == regs[i]).mean(axis=1), law @ law[i] * 2.0**-MANTISSA) >= least


def _forest(numbers: np.ndarray, group: np.ndarray, meets: np.ndarray, here: np.ndarray, close, same) -> list[tuple[int, int]]:
    """Links that join what is apart: every member that `meets` the block is compared with those that
    are at home in it and in other groups, if close(i) allows it, until same(i, j) has joined them."""
    out = []
    group = group.copy()
    for i in np.flatnonzero(meets).tolist():
        apart = here & (group != group[i])
        if not apart.any():
            continue
        for j in np.flatnonzero(apart & close(i)).tolist():
            if group[j] != group[i] and same(i, j):
                out.append((int(numbers[i]), int(numbers[j])))
                group[group == group[j]] = group[i]
    return out


def _links_batch(links: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Deal the members (group, c, size, out) of groups into blocks: adds `block`. A member that is
    out also visits every other block of its group. `home` says where it lives."""
    parts = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("home", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    blocks = F.when(F.col("out"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("number", F.explode(blocks)).withColumn("here", F.col("number") == F.col("home"))
    # One column, so that rows dealt out by group are dealt anew and a group's blocks part ways.
    return rows.withColumn("block", F.concat_ws(":", F.col(group).cast("string"), F.col("number").cast("string"))).drop("parts", "home", "number")


def families(classes: DataFrame, percent: int) -> DataFrame:
    """(c, family): classes joined by estimates high enough, found through shared bands. Any two
    classes of a shared band whose estimate is high enough are in one family."""
    banded = bands(classes)
    pivots = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("c").alias("h"), "c")).alias("p"), F.count(F.lit(1)).alias("size"))
    shared = stored(banded.join(pivots.filter("size > 1").select("key", F.col("p.c").alias("p"), "size"), "key"))
    pairs = shared.filter("c <> p").select(F.col("c").alias("a"), F.col("p").alias("b")).distinct()
    left = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    near = stored(_similar(pairs.join(left, "a").join(right, "b"), percent))
    # A class that is not known to hang together with its bucket's pivot meets the whole bucket.
    first = stored(near_labels(near))
    node = first.select(F.col("node").alias("c"), F.col("label").alias("g"))
    rows = (
        shared.join(node, "c", "left").withColumn("g", F.coalesce("g", "c"))
        .join(first.select(F.col("node").alias("p"), F.col("label").alias("pg")), "p", "left").withColumn("pg", F.coalesce("pg", "p"))
        .withColumn("out", F.col("g") != F.col("pg"))
    )
    # Buckets of the same members are one.
    buckets = rows.groupBy("key").agg(
        F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"), F.first("size").alias("size"), F.max("out").alias("any"),
    ).filter("any")
    buckets = buckets.groupBy("x", "y", "size").agg(F.min("key").alias("key")).select("key")
    rows = _in_blocks(stored(rows.join(buckets, "key", "left_semi").select("key", "c", "g", "out", "size")), "key", BLOCK)
    rows = rows.join(classes.select("c", "n", "regs"), "c").select("block", "c", "g", "out", "here", "n", "regs")
    least = least_estimate(percent)

    def compare(table: pa.Table) -> pa.Table:
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        out, here = (table[k].to_numpy(zero_copy_only=False) for k in ("out", "here"))
        close = _close(regs, table["n"].to_numpy(), least)
        return _links_batch(_forest(table["c"].to_numpy(), table["g"].to_numpy(), out, here, close, lambda i, j: True))

    more = rows.groupBy("block").applyInArrow(compare, "a bigint, b bigint")
    return components(near.unionAll(more)).select(F.col("node").alias("c"), F.col("label").alias("family"))


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) confirmed on full sets that connect all that is linked, of (c, family, set): every
    pair of a family is compared unless links found before connect it."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    placed = members.join(sizes, "family")
    least = least_estimate(percent)

    def compare(table: pa.Table) -> pa.Table:
        numbers, groups = table["c"].to_numpy(), table["g"].to_numpy()
        order = np.argsort(numbers, kind="stable")  # the pivot, the least of its family, comes first
        sets = [np.frombuffer(table["set"][k].as_py(), np.uint64) for k in order.tolist()]
        regs, n = np.stack([registers(s) for s in sets]), np.array([len(s) for s in sets])
        out, here = (table[k].to_numpy(zero_copy_only=False)[order] for k in ("out", "here"))
        same = lambda i, j: linked(sets[i], sets[j], percent)
        return _links_batch(_forest(numbers[order], groups[order], out, here, _close(regs, n, least), same))

    # First within blocks, the family's pivot in each of them.
    pivot = F.col("c") == F.col("family")
    rows = _in_blocks(placed.withColumn("out", pivot).withColumn("g", F.col("c")), "family", BLOCK)
    rows = rows.withColumn("out", F.lit(True)).withColumn("here", F.lit(True)).select("block", "c", "g", "out", "here", "set")
    within = stored(rows.groupBy("block").applyInArrow(compare, "a bigint, b bigint"))
    joined = stored(near_labels(within))
    # Then, in families of several blocks, those not known to hang together with the pivot meet all
    # blocks.
    large = placed.filter(F.col("size") > BLOCK)
    node = joined.select(F.col("node").alias("c"), F.col("label").alias("g"))
    at_pivot = joined.select(F.col("node").alias("family"), F.col("label").alias("pg"))
    rows = (
        large.join(node, "c", "left").withColumn("g", F.coalesce("g", "c"))
        .join(at_pivot, "family", "left").withColumn("pg", F.coalesce("pg", "family"))
        .withColumn("out", F.col("g") != F.col("pg"))
    )
    rows = _in_blocks(rows.select("family", "c", "g", "out", "size", "set"), "family", BLOCK)
    across = rows.select("block", "c", "g", "out", "here", "set").groupBy("block").applyInArrow(compare, "a bigint, b bigint")
    return within.unionAll(across)


def near_duplicates(
    docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the least id that links reach, itself
    included), kept (id = component_id).

    Words are lower-cased A-Z runs between blanks; a document's set holds its distinct shingles of
    `size` words. Two documents are linked if 100 * |A & B| >= percent * |A | B|. Null, empty and
    blank texts have no set and no link. Rows repeated are linked to each other, and share `kept`. A
    null id counts only where no other is in the component. An empty table gives an empty result.
    Other columns are not read. Shingles are told apart by 64-bit hashes, sets by 128-bit digests.
    """
    found = labelled(docs, size, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )


def labelled(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, component, label), one row per document row: the hash of its text, the size of its set, the
    least id of its component, and the component's number, null without a set."""
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    drawn = stored(sketches(given, size))
    # Documents of equal sets are one class, with the row that stands for it.
    classes = drawn.filter("n > 0").groupBy("s").agg(F.min(F.struct("id", "t")).alias("row"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "s", "row", "least", "n", "regs"))
    found = stored(families(classes, percent))
    wanted = classes.join(found, "c").select("c", "family", F.col("row.id").alias("id"), F.col("row.t").alias("t"))
    texts = given.join(wanted, given["id"].eqNullSafe(wanted["id"]) & (given["t"] == wanted["t"])).select("c", "family", "text")

    def build():
        def step(batch):
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = shingle_sets([t.as_py().encode() for t in part.column(2)], size)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "family", "set"])

        return step

    sets = map_batches(texts, build, "c bigint, family bigint, set binary")
    # Rows repeated with one id and text stand for the same class.
    members = stored(sets.groupBy("c").agg(F.first("family").alias("family"), F.first("set").alias("set")))
    label = components(verified_links(members, percent))
    named = classes.select("c", "s", "least").join(label.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    by_set = named.join(least, "label").select("s", "component", "label")
    return drawn.select("id", "t", "n", F.when(F.col("n") > 0, F.col("s")).alias("s")).join(by_set, "s", "left").select(
        "id", "t", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), "label",
    )


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near_duplicates() one document, with all its columns: one that has the least id. Texts
    without a set all stay; of rows repeated with the same id and text one stays."""
    spare = "_text_hash"
    while spare in docs.columns:
        spare += "_"
    found = stored(labelled(docs, size, percent, id_col, text_col))
    least = found.filter((F.col("n") > 0) & F.col("id").eqNullSafe(F.col("component"))).groupBy("label").agg(
        F.first("id").alias("_i"), F.min("t").alias("_t")
    )
    keep = least.select("_i", "_t").unionAll(found.filter("n = 0").select("id", "t"))
    marked = docs.withColumn(spare, F.xxhash64(text_of(text_col)))
    kept = marked.join(keep, marked[id_col].eqNullSafe(keep["_i"]) & (marked[spare] == keep["_t"]), "left_semi")
    if not found.groupBy("id", "t").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, spare])
    return kept.drop(spare)
