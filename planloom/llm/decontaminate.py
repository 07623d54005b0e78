"""Benchmark items that documents contain, with small edits.

Stretches of a document that share enough runs of words with an item are compared with it exactly:
bit-parallel edit distance (Myers) keeps a column of the table of edits in two integers of as many
bits as the item has words, so a word of the document costs a few operations at any item length.
No match within the limit is lost. CGK walks with sampled places, which could choose among the
stretches, cost more than that and lose matches of long items (see README); walks() is kept apart.

Which stretches are compared: an item has n - q + 1 runs of q words, and an edit breaks q of them at
most, so a stretch within d edits shares n - q + 1 - d * q runs or more, and their places in
document and item differ by amounts no more than d apart. Only where that many shared runs come
together can a match be; q is three, or less where short items need it. This loses nothing.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import map_batches, text_of

#: Edits allowed, as a part of the item's words: similarity 0.8 or more.
EDITS = 0.2
#: Items of fewer words are found only in documents that consist of the item.
LEAST_WORDS = 5
#: Items sent to the executors at a time; more items take more passes over the documents.
ITEMS_AT_A_TIME = 20_000

#: Runs that a part of a text may share with the items, over which the text is cut.
PAIRS = 1 << 20

WORDS = re.compile(r"[^\W_]+").findall


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walks(words: np.ndarray, seeds: np.ndarray, steps: int) -> np.ndarray:
    """The first steps of the CGK walks of rows of word numbers, each row under each seed: (rows, seeds,
    steps). Past the end a walk notes 0. A word lasts two steps on average."""
    rows, n = words.shape
    padded = np.concatenate([words, np.zeros((rows, 1), words.dtype)], axis=1)
    row = np.arange(rows)[:, None]
    at, out = np.zeros((rows, len(seeds)), np.int64), np.empty((rows, len(seeds), steps), words.dtype)
    salt = (seeds.astype(np.uint64) * np.uint64(1_000_003))[None, :]
    for j in range(steps):
        word = out[:, :, j] = padded[row, at]
        move = mixed(word.astype(np.uint64) + (salt + np.uint64(j + 1) << np.uint64(32))) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), n)
    return out


def places_of(item: list[int]) -> dict[int, int]:
    """Bit k of a word's number says that it is word k of the item."""
    out: dict[int, int] = {}
    for k, word in enumerate(item):
        out[word] = out.get(word, 0) | 1 << k
    return out


def distances(places: dict[int, int], n: int, text: list[int], anchored: bool):
    """After each word of the text, the least edits that make the item a stretch ending there; anchored:
    the stretch that is the whole text so far."""
    every, last, carry = (1 << n) - 1, 1 << (n - 1), int(anchored)
    up, down, edits = every, 0, n
    for word in text:
        same = places.get(word, 0)
        x = same | down
        y = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(y | up) & every, up & y
        if plus & last:
            edits += 1
        elif minus & last:
            edits -= 1
        plus, minus = plus << 1 | carry, minus << 1
        up, down = (minus | ~(x | plus)) & every, plus & x & every
        yield edits


def best_match(item: list[int], text: list[int], places: dict[int, int] | None = None) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the text: (distance, start, end). The stretch
    that ends first, and of those the longest."""
    n = len(item)
    best, end = n, 0
    for k, edits in enumerate(distances(places or places_of(item), n, text, False), 1):
        if edits < best:
            best, end = edits, k
            if not best:
                return 0, end - n, end
    back = text[max(0, end - n - best):end][::-1]
    longest = max((k for k, edits in enumerate(distances(places_of(item[::-1]), n, back, True), 1) if edits == best), default=0)
    return best, end - longest, end


class Finder:
    """A block of items, ready to be looked for in documents."""

    def __init__(self, items: list[tuple], edits: float = EDITS):
        self.numbers: dict[str, int] = {}
        self.ids, self.items, self.whole = [], [], {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORDS((text or "").lower())]
            if len(words) >= LEAST_WORDS:
                self.ids.append(item)
                self.items.append(np.array(words, np.int64))
            elif words:
                self.whole.setdefault(tuple(words), []).append(item)
        self.most = [int(edits * len(w)) for w in self.items]
        self.base = len(self.numbers) + 1
        runs: dict[int, list[tuple[int, int, int]]] = {1: [], 2: [], 3: []}
        self.least = np.ones(len(self.items), np.int64)
        for k, words in enumerate(self.items):
            n, d = len(words), self.most[k]
            # The longest run of at most three words of which more than none must be shared.
            size = next((q for q in (3, 2) if n - q + 1 - d * q > 0), 1)
            self.least[k] = max(1, n - size + 1 - d * size)
            for at in range(n - size + 1):
                runs[size].append((self.run_key(words[at:at + size]), k, at))
        # Sorted keys; the items and offsets of equal keys stand side by side.
        self.runs = {
            size: tuple(np.array(c, np.int64) for c in zip(*sorted(found), strict=True)) for size, found in runs.items() if found
        }
        self.edits = np.array(self.most, np.int64)
        self.lengths = np.array([len(w) for w in self.items], np.int64)
        # A match's runs lie no further apart than its item's words and the edits on both sides.
        self.reach = {size: int((self.lengths[c[1]] + 2 * self.edits[c[1]]).max()) + 1 for size, c in self.runs.items()}
        self.places: dict[int, dict[int, int]] = {}  # of the items compared so far

    def run_key(self, words) -> int:
        key = 0
        for w in words:
            key = (key * self.base + int(w)) % (1 << 61)
        return key

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, low, high): the stretches of the text where enough shared runs come together, those of
        an item in order and apart. The text is gone through in parts that overlap by more than the
        longest item can span, each of as many shared runs as PAIRS allows, so that memory follows the
        block of items and not the length of the text or how often it repeats itself."""
        found = []
        for size, (run_keys, items, offsets) in self.runs.items():
            n = len(words) - size + 1
            if n <= 0:
                continue
            known = words > 0
            at = known[:n]
            for j in range(1, size):
                at = at & known[j:n + j]
            at = np.flatnonzero(at)
            key = np.zeros(len(at), np.int64)
            for j in range(size):
                key = (key * self.base + words[at + j]) % (1 << 61)
            first = np.searchsorted(run_keys, key, "left")
            hit = run_keys[np.minimum(first, len(run_keys) - 1)] == key
            at, first, key = at[hit], first[hit], key[hit]
            if not len(at):
                continue
            many = np.searchsorted(run_keys, key, "right") - first
            upto = np.cumsum(many)
            reach = self.reach[size]
            a = 0
            while a < len(at):
                # The places of this part, and beyond them those that its last starts may need.
                b = max(int(np.searchsorted(upto, upto[a] - many[a] + PAIRS, "right")), int(np.searchsorted(at, at[a] + reach)))
                c = int(np.searchsorted(at, at[min(b, len(at)) - 1] + reach, "right"))
                part = slice(a, c)
                place = np.repeat(first[part] - (upto[part] - many[part] - (upto[a] - many[a])), many[part]) + np.arange(upto[c - 1] - upto[a] + many[a])
                item, start = items[place], np.repeat(at[part], many[part]) - offsets[place]
                found.append(self.stretches(item, start, len(words)))
                a = b
        if not found:
            return (np.zeros(0, np.int64),) * 3
        item, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        return merged(item, low, high)

    def stretches(self, item: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of diagonals (item, start) of shared runs, the stretches around those where enough of them lie
        within the item's edits."""
        code = np.sort(item * (length + (1 << 20)) + start + (1 << 19))
        item = code // (length + (1 << 20))
        start = code % (length + (1 << 20)) - (1 << 19)
        together = np.searchsorted(code, code + self.edits[item], "right") - np.arange(len(code))
        enough = together >= self.least[item]
        item, start = item[enough], start[enough]
        # The first diagonal of a match is at most its edits off its first word, the last as much beyond its last.
        d = self.edits[item]
        return merged(item, np.maximum(start - d, 0), np.minimum(start + self.lengths[item] + 2 * d, length))

    def __call__(self, text: str) -> list[tuple]:
        """(item id, edits, item words, start, end) of the best match of each item found; start and
        end count the document's words."""
        words = WORDS(text.lower())
        words = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        out = [(i, 0, len(words), 0, len(words)) for i in self.whole.get(tuple(words.tolist()), [])] if len(words) < LEAST_WORDS else []
        items, lows, highs = self.candidates(words)
        ends = np.flatnonzero(np.diff(items, append=-1)) + 1
        for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True) if len(items) else ():
            item = int(items[a])
            best = self.best(item, lows[a:b], highs[a:b], words)
            if best:
                out.append((self.ids[item], best[0], len(self.items[item]), best[1], best[2]))
        return out

    def best(self, item: int, lows: np.ndarray, highs: np.ndarray, words: np.ndarray) -> tuple[int, int, int] | None:
        """The closest stretch within the given ones, if it is close enough."""
        want, d = self.items[item].tolist(), self.most[item]
        if item not in self.places:
            self.places[item] = places_of(want)
        found = None
        for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
            edits, start, end = best_match(want, words[a:b].tolist(), self.places[item])
            if edits <= d and (found is None or edits < found[0]):
                found = (edits, a + start, a + end)
                if not edits:
                    break
        return found


def merged(item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches by item and place, those that touch made one."""
    order = np.lexsort((low, item))
    item, low, high = item[order], low[order], high[order]
    span = int(high.max(initial=0)) + 1
    reached = np.maximum.accumulate(item * span + high) - item * span
    first = np.ones(len(item), bool)
    first[1:] = (item[1:] != item[:-1]) | (low[1:] > reached[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(item))[:len(at)] - 1
    return item[at], low[at], reached[last]


def item_blocks(items: DataFrame, item_col: str, text_col: str, size: int):
    """The items in blocks of bounded number; one block is on the driver at a time."""
    block = []
    for row in items.select(F.col(item_col), text_of(text_col)).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contamination(
    docs: DataFrame, items: DataFrame, edits: float = EDITS, items_at_a_time: int = ITEMS_AT_A_TIME,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document row and item it contains: (doc_id, item_id, edits, item_words, start,
    end, similarity), the closest stretch of each.

    Words are runs of letters and digits, lower-cased; an item matches where some stretch of the
    document is within edits * words of it in word edit distance. Items under five words match only
    a document that is nothing else; items without words, null or empty texts match nothing. Rows
    repeated in either table repeat their results. Empty tables give an empty result. Other columns
    are not read. Documents are never shuffled; the items travel in blocks of a bounded number.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, edits bigint, item_words bigint, start bigint, end bigint"
    arrow_item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = None
    for block in item_blocks(items, item_col, item_text_col, items_at_a_time):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def build(sent=sent):
            find = Finder(sent.value, edits)

            def step(batch):
                at, rows = [], []
                for k, text in enumerate(batch.column(1)):
                    for row in find(text.as_py()):
                        at.append(k)
                        rows.append(row)
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0], arrow_item), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    names=["id", "item", "edits", "item_words", "start", "end"],
                )

            return step

        part = map_batches(given, build, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "item_words", "start", "end",
        (1 - F.col("edits") / F.col("item_words")).alias("similarity"),
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, edits: float = EDITS, items_at_a_time: int = ITEMS_AT_A_TIME,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents that contain no item, with all their columns; repeated rows stay repeated. Rows
    pass through one map for each block of items: no shuffle."""
    place = docs.columns.index(text_col)
    for block in item_blocks(items, item_col, item_text_col, items_at_a_time):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            find = Finder(sent.value, edits)
            for batch in batches:
                clean = [not find(t.as_py() or "") for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
