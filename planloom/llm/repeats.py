"""Removal of long byte strings that occur more than once, by depth-limited radix sort of suffixes.

All suffixes of all texts are sorted, but only through their first `length` bytes, and not position by
position: a pass groups suffixes by the next digits, most significant first, and only groups of two
and more go on. After the last pass the groups that are left are exactly the repeated windows.

Neighbouring suffixes share most of their bytes, so they travel together. In every window the k-gram
of least hash is its anchor: equal windows have it in the same place, and runs of neighbouring windows
share it. The passes are
  1. runs by anchor: the k-gram is the first digit;
  2. what is left, by cells of neighbouring offsets from the anchor: the bytes all windows of a cell
     share are the digit;
  3. what is left, window by window: all bytes.
In each pass a run or cell whose whole stretch occurs again is settled as repeated, one whose digit
does not is settled as unique. Where stretches differ but the digit is shared, all of them go on, and
one of each kind of settled ones to meet them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.bytewords import _VALUES, mix, powers
from planloom.llm.common import map_batches, stored, text_of

LENGTH = 400
#: Bytes of an anchor: two fifths of the window.
ANCHOR_PART = 0.4
#: Offsets in a cell.
CELL = 16

RUN = "struct<core:bigint,whole:bigint,a:int,lo:int,hi:int>"
_RUN = pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


class Prints:
    """Fingerprints of any stretch of one text."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(raw, np.uint8)] * up[:self.n], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours: suffix minimum of one block, prefix minimum of the next."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs_of(raw: bytes, length: int, k: int) -> list[np.ndarray]:
    """core, whole, anchor, first and last start of the runs of windows that share an anchor."""
    if len(raw) < length:
        return [np.zeros(0, np.int64)] * 5
    prints = Prints(raw)
    at = np.arange(len(raw) - k + 1)
    grams = prints(at, at + k)
    width = length - k + 1
    least = sliding_least(grams, width)
    # The anchor is the leftmost k-gram of least hash. It changes where the least value does, and
    # where a place of that value has just been left and another one holds it.
    places = np.flatnonzero(grams == _least_at(least, width))
    values, rank = np.unique(grams[places], return_inverse=True)
    order = np.argsort(rank, kind="stable")
    line = rank[order].astype(np.int64) << 40 | places[order]
    left = places[places + 1 < len(least)]
    left = left[least[left + 1] == grams[left]] + 1
    first = np.unique(np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, left)))
    a = places[order][np.searchsorted(line, np.searchsorted(values, least[first]).astype(np.int64) << 40 | first)]
    last = np.concatenate((first[1:] - 1, [len(least) - 1]))
    whole = mix(prints(first, last + length) + (a - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64))
    return [grams[a].view(np.int64), whole.view(np.int64), a, first, last]


def _least_at(least: np.ndarray, width: int) -> np.ndarray:
    """For every place the greatest of the least values of the windows that hold it: the only one its
    own value can be."""
    top = np.iinfo(least.dtype).max
    high = np.full(len(least) + 2 * (width - 1), top, least.dtype)
    high[width - 1:width - 1 + len(least)] = top - least
    return top - sliding_least(high, width)


def cells_of(prints: Prints, runs: list[dict], length: int) -> list[dict]:
    """The cells of the runs' offsets: core is what all windows of the full cell share."""
    out, cell = [], max(1, min(CELL, length // 2))
    for r in runs:
        a, lo, hi = r["a"], r["lo"], r["hi"]
        j = np.arange((a - hi) // cell, (a - lo) // cell + 1)
        low, high = a - cell * j - cell + 1, a - cell * j
        s1, s2 = np.maximum(low, lo), np.minimum(high, hi)
        core = mix(prints(high, low + length) + j.astype(np.uint64)).view(np.int64)
        whole = mix(prints(s1, s2 + length) + (a - s1).astype(np.uint64) * np.uint64(1 << 20) + (s2 - s1).astype(np.uint64)).view(np.int64)
        out += [
            {"core": c, "whole": w, "a": a, "lo": x, "hi": y}
            for c, w, x, y in zip(core.tolist(), whole.tolist(), s1.tolist(), s2.tolist(), strict=True)
        ]
    return out


def sorted_out(items: DataFrame) -> DataFrame:
    """One pass over (id, t, core, whole, a, lo, hi): those that are repeated or go on, with `dup` and
    `on`. Counts are summed before they are shuffled; hot digits are joined, never gathered."""
    again = stored(items.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("core"))
    some = stored(items.join(again, "core").withColumn("h", F.xxhash64("id", "t", "a", "lo")))
    # Both sides are written, so that the join may split a digit with many stretches over tasks.
    kinds = stored(some.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")))
    alone = stored(kinds.filter("n = 1").select("core").distinct().withColumn("meets", F.lit(True)))
    known = stored(kinds.join(alone, "core", "left").select("core", "whole", "n", "first", F.coalesce("meets", F.lit(False)).alias("meets")))
    return some.join(known, ["core", "whole"]).select(
        "id", "t", "a", "lo", "hi", (F.col("n") > 1).alias("dup"), (F.col("meets") & ((F.col("n") == 1) | (F.col("h") == F.col("first")))).alias("on"),
    ).filter("dup OR on")


def _by_text(rows: DataFrame) -> DataFrame:
    """A text's own results as lists; no more than its length holds."""
    item = F.struct("a", "lo", "hi")
    return rows.groupBy("id", "t").agg(
        F.collect_set(F.when(F.col("dup"), F.struct("lo", "hi"))).alias("dups"), F.collect_set(F.when(F.col("on"), item)).alias("on"),
    )


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"id": "_id", "t": "_t"})
    return left.join(right, left["id"].eqNullSafe(right["_id"]) & (left["t"] == right["_t"]), how).drop("_id", "_t")


def removed(raw: bytes, starts: list[tuple[int, int]], length: int) -> tuple[int, list[tuple[int, int]]]:
    """Bytes covered by windows that start in the given ranges, and the stretches they make."""
    spans: list[list[int]] = []
    for lo, hi in sorted(starts):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    return sum(b - a for a, b in spans), [(a, b) for a, b in spans]


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end
    of the removed stretches, in bytes).

    A byte is removed if some `length` bytes that cover it also start anywhere else, in the same text
    or another. Texts are their UTF-8 bytes, null as empty; texts shorter than that keep all. Rows
    repeated are each other's repeats. An empty table gives an empty result. Other columns are not
    read. Strings are compared by 64-bit fingerprints, together with their place about the anchor.
    """
    k = max(1, int(ANCHOR_PART * length))
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("t", F.xxhash64("text")).select("id", "t", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    keys = f"id {kind}, t bigint"

    def scan():
        def step(batch):
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                found = [runs_of(t.as_py().encode(), length, k) for t in part.column(2)]
                owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), *(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.int32()) for c in cols[2:])],
                    names=["id", "t", "core", "whole", "a", "lo", "hi"],
                )

        return step

    runs = stored(map_batches(given, scan, f"{keys}, core bigint, whole bigint, a int, lo int, hi int"))
    first = stored(_by_text(sorted_out(runs)))

    def settle():
        """Texts without a repeat are done; of the others text and cells are kept."""

        def step(batch):
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = []
                for text, dups, on in zip(*(part.column(c).to_pylist() for c in range(2, 5)), strict=True):
                    raw = text.encode()
                    sure = not dups and not on
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest() if sure else None, None if sure else raw, dups or [], cells_of(Prints(raw), on, length) if on else []))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.list_(_RUN)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, x) for c, x in zip(cols, kinds, strict=True))], names=["id", "t", "n_bytes", "sha", "raw", "dups", "cells"])

        return step

    span = "struct<lo:int,hi:int>"
    texts = stored(map_batches(_same(given, first, "left"), settle, f"{keys}, n_bytes bigint, sha string, raw binary, dups array<{span}>, cells array<{RUN}>"))
    cells = texts.select("id", "t", F.explode("cells").alias("x")).select("id", "t", "x.*")
    second = stored(_by_text(sorted_out(cells)))

    def windows():
        def step(batch):
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                keys_of, starts_of, owner = [], [], []
                for k, (raw, on) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    starts = np.unique(np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in on]))
                    keys_of.append(Prints(raw)(starts, starts + length).view(np.int64))
                    starts_of.append(starts)
                    owner += [k] * len(starts)
                owner = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(owner), part.column(1).take(owner), pa.array(np.concatenate(keys_of)), pa.array(np.concatenate(starts_of), pa.int32()),
                ], names=["id", "t", "key", "at"])

        return step

    last = _same(texts.select("id", "t", "raw"), second.filter(F.size("on") > 0).select("id", "t", "on"), "inner")
    each = stored(map_batches(last.select("id", "t", "raw", "on"), windows, f"{keys}, key bigint, at int"))
    twice = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"))
    third = each.join(twice, "key").groupBy("id", "t").agg(F.collect_set("at").alias("ats"))

    def finish():
        def step(batch):
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = []
                for n, sha, raw, dups, more, ats in zip(*(part.column(c).to_pylist() for c in range(1, 7)), strict=True):
                    if sha is not None:
                        rows.append((n, 0, 0, sha, []))
                        continue
                    ranges = [(x["lo"], x["hi"]) for x in [*dups, *(more or [])]] + [(x, x) for x in ats or []]
                    gone, spans = removed(raw, ranges, length)
                    kept, end = hashlib.sha256(), 0
                    for a, b in spans:
                        kept.update(raw[end:a])
                        end = b
                    kept.update(raw[end:])
                    rows.append((n, gone, len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, x) for c, x in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

        return step

    whole = texts.filter("sha IS NULL").select("id", "t", "n_bytes", "sha", "raw", "dups")
    joined = _same(_same(whole, second.select("id", "t", F.col("dups").alias("more")), "left"), third, "left")
    clean = texts.filter("sha IS NOT NULL").select(
        "id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
    )
    out = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    found = map_batches(joined.select("id", "n_bytes", "sha", "raw", "dups", "more", "ats"), finish, out)
    return found.unionAll(clean).withColumnRenamed("id", id_col)
