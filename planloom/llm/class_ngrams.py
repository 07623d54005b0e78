"""Brown class-based n-gram model of a corpus.

P(word | word before) = P(class of word | class before) * P(word | its class). Exchange clustering
finds the classes: each unit in turn moves to the class where the likelihood of the corpus's
bigrams is greatest. Units are the frequent words, each for itself, and the other words by their
ends; so every word, also one never seen, has a class that any task can tell without a lookup.

What is gathered: the count of every word of the corpus, and the counts of adjacent units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.bytewords import mix, texts_in_chunks
from planloom.llm.common import map_batches, stored, text_of

#: A word that makes up this part of all tokens is a unit of its own: there are 4096 at most.
UNIT_SHARE = 2.0**-12
#: Units of the other words, by their last three bytes.
ENDINGS = 256
CLASSES, SWEEPS = 48, 6
#: Words of at least this share have their counts sent to the tasks: a million of them at most.
#: Counts of rarer words are joined.
SENT_SHARE = 2.0**-20
#: Added to every count of class moves.
SMOOTH = 0.5
#: Words and pairs a task sums up before it hands them on.
GATHER = 4_000_000


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of each word's last three bytes, hashed."""
    key = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        there = ends - k >= starts
        key = key * np.uint64(257) + np.where(there, data[np.maximum(ends - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(key + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts).astype(np.int64)


class Gatherer:
    """Counts of 64-bit keys, handed on whenever many have come together."""

    def __init__(self):
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int64) if counts is None else counts)
        self.n += len(keys)

    def full(self) -> bool:
        return self.n >= GATHER

    def take(self):
        if not self.keys:
            return
        keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.n = [], [], 0
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at:at + 100_000].view(np.int64)), pa.array(counts[at:at + 100_000])], names=["key", "n"]
            )


def _gathered(docs: DataFrame, keys_of) -> DataFrame:
    """Sums over all texts of what keys_of(data, hashes, starts, ends, borders) yields."""

    def run(batches):
        found = Gatherer()
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(0)]
            for _, _, *chunk in texts_in_chunks(texts):
                found.add(keys_of(*chunk))
                if found.full():
                    yield from found.take()
        yield from found.take()

    rows = docs.select("text").mapInArrow(run, "key bigint, n bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): the count of every word."""
    return _gathered(docs, lambda data, hashes, starts, ends, borders: packed(hashes, endings(data, starts, ends)))


def packed(hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """One key of a word: 56 bits of its hash and its ending. The ending is a function of the word,
    so words of different endings differ for certain."""
    return hashes & ~np.uint64(ENDINGS - 1) | ending.astype(np.uint64)


@dataclass
class Model:
    words: np.ndarray  # sorted keys of the words that are units
    classes: np.ndarray  # class of each unit: those words, the endings, the text border
    moves: np.ndarray  # log10 P(class | class before)
    sent: np.ndarray  # sorted keys of the words whose counts are sent
    sent_counts: np.ndarray
    tokens: int  # training tokens, ends included
    distinct: int  # distinct training tokens, the end included
    end_count: int
    class_room: np.ndarray  # log10 of tokens + distinct words + 1 of each class

    def units(self, keys: np.ndarray) -> np.ndarray:
        return units(keys, self.words)


def units(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Unit of each word key: a word of its own, or its ending."""
    out = (keys & np.uint64(ENDINGS - 1)).astype(np.int64) + len(words)
    if len(words):
        at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
        own = words[at] == keys
        out[own] = at[own]
    return out


def exchange(pairs: np.ndarray, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit, from the counts of adjacent units. The most frequent units start in classes
    of their own; the rest follow in turn. Then units move while the likelihood grows:
    sum N log N of class pairs, less that of the classes on the left and on the right."""
    n = len(pairs)
    n_classes = min(n_classes, n)
    order = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1)), kind="stable")
    classes = np.empty(n, np.int64)
    classes[order] = np.arange(n) % n_classes

    def weight(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    to_class, from_class = np.zeros((n, n_classes)), np.zeros((n, n_classes))
    for c in range(n_classes):
        to_class[:, c] = pairs[:, classes == c].sum(axis=1)
        from_class[:, c] = pairs[classes == c].sum(axis=0)
    joint = np.zeros((n_classes, n_classes))
    np.add.at(joint, classes, to_class)
    every = np.arange(n_classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old, itself = classes[u], pairs[u, u]
            right, left = to_class[u].copy(), from_class[u].copy()
            right[old] -= itself
            left[old] -= itself
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= itself
            rows, cols = weight(joint), weight(joint.T)
            gain = (weight(joint + right) - rows).sum(axis=1) + (weight(joint.T + left) - cols).sum(axis=1)
            corner = joint[every, every]
            gain += weight(corner + right + left + itself) - weight(corner + right) - weight(corner + left) + weight(corner)
            out, into = joint.sum(axis=1), joint.sum(axis=0)
            gain -= weight(out + right.sum() + itself) - weight(out) + weight(into + left.sum() + itself) - weight(into)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += itself
            if new != old:
                moved += 1
                classes[u] = new
                to_class[:, old] -= pairs[:, u]
                to_class[:, new] += pairs[:, u]
                from_class[:, old] -= pairs[u]
                from_class[:, new] += pairs[u]
        if not moved:
            break
    return classes


def train(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of (text) rows, and the table of word counts (key, n)."""
    spark = training.sparkSession
    counts = stored(word_counts(training))
    ends = training.count()
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = (total or 0) + ends, distinct + (ends > 0)
    # By the meaning of a share, at most 1 / share words reach it.
    sent = counts.filter(F.col("n") >= max(1.0, tokens * SENT_SHARE)).toPandas().astype("int64")
    sent_keys = sent["key"].to_numpy().view(np.uint64)
    order = np.argsort(sent_keys)
    sent_keys, sent_counts = sent_keys[order], sent["n"].to_numpy()[order]
    words = sent_keys[sent_counts >= max(2.0, tokens * UNIT_SHARE)]
    n_units = len(words) + ENDINGS + 1
    border = n_units - 1
    shared = spark.sparkContext.broadcast(words)

    def pairs_of(data, hashes, starts, ends, borders):
        own = units(packed(hashes, endings(data, starts, ends)), shared.value)
        # A border stands before each text's first word and after its last.
        line = np.insert(own, borders, border)
        return (line[:-1] * n_units + line[1:]).astype(np.uint64)

    pairs = np.zeros((n_units, n_units))
    found = _gathered(training, pairs_of).toPandas().astype("int64")  # n_units squared rows at most
    pairs[found["key"] // n_units, found["key"] % n_units] = found["n"]
    classes = exchange(pairs)
    n_classes = int(classes.max()) + 1
    joint = np.zeros((n_classes, n_classes))
    np.add.at(joint, (classes[:, None].repeat(n_units, 1), classes[None, :].repeat(n_units, 0)), pairs)
    moves = np.log10((joint + SMOOTH) / (joint.sum(axis=1, keepdims=True) + SMOOTH * n_classes))
    # Tokens and distinct words of each class: units of one word, and of each ending.
    ending = F.col("key").bitwiseAND(F.lit(ENDINGS - 1))
    by_ending = counts.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).toPandas()
    unit_tokens, unit_words = np.zeros(n_units), np.zeros(n_units)
    unit_tokens[len(words) + by_ending["e"].to_numpy(np.int64)] = by_ending["n"]
    unit_words[len(words) + by_ending["e"].to_numpy(np.int64)] = by_ending["d"]
    own_counts = sent_counts[np.searchsorted(sent_keys, words)] if len(words) else np.zeros(0)
    own_ends = len(words) + (words & np.uint64(ENDINGS - 1)).astype(np.int64)
    unit_tokens[:len(words)], unit_words[:len(words)] = own_counts, 1
    np.subtract.at(unit_tokens, own_ends, own_counts)
    np.subtract.at(unit_words, own_ends, 1)
    unit_tokens[border], unit_words[border] = ends, min(ends, 1)
    room = np.log10(np.bincount(classes, unit_tokens, n_classes) + np.bincount(classes, unit_words, n_classes) + 1)
    model = Model(words, classes, moves, sent_keys, sent_counts, tokens, distinct, ends, room)
    return model, counts.filter(F.col("n") < max(1.0, tokens * SENT_SHARE))


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of (id, text) rows, one row each.

    base_score is the word's add-one unigram; score the class model: for each token, log10 of the
    class given the class before, and of (count + 1) / (tokens + distinct + 1 of its class), the one
    more being the class's unseen words. Both have sum log10(count + 1) in common; what a task
    cannot know of it, the counts of rare words, is joined.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["id"].dataType.simpleString()
    end_part = float(np.log10(model.end_count + 1))

    def build():
        m = sent.value
        border = len(m.classes) - 1

        def step(batch):
            texts = [t.as_py().encode() for t in batch.column(1)]
            for first, last, data, hashes, starts, ends, borders in texts_in_chunks(texts):
                keys = packed(hashes, endings(data, starts, ends))
                count = np.zeros(len(keys), np.int64)
                if len(m.sent):
                    at = np.minimum(np.searchsorted(m.sent, keys), len(m.sent) - 1)
                    there = m.sent[at] == keys
                    count[there] = m.sent_counts[at[there]]
                classes = m.classes[m.units(keys)]
                line = np.insert(classes, borders, m.classes[border])
                move = m.moves[line[:-1], line[1:]]
                # Text k's moves: from the border before it to the one after it.
                places = borders + np.arange(len(borders))
                run = np.concatenate(([0.0], np.cumsum(move)))
                moved = run[places[1:]] - run[places[:-1]]
                room = np.concatenate(([0.0], np.cumsum(m.class_room[classes])))
                rooms = room[borders[1:]] - room[borders[:-1]] + m.class_room[m.classes[border]]
                known = np.concatenate(([0], np.cumsum(count > 0)))
                logs = np.concatenate(([0.0], np.cumsum(np.log10(count + 1.0))))
                rest = [keys[a:b][count[a:b] == 0].view(np.int64) for a, b in zip(borders[:-1], borders[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last],
                    pa.array(borders[1:] - borders[:-1] + 1),
                    pa.array(known[borders[1:]] - known[borders[:-1]] + (m.end_count > 0)),
                    pa.array(logs[borders[1:]] - logs[borders[:-1]] + end_part),
                    pa.array(moved - rooms),
                    pa.array(rest, pa.list_(pa.int64())),
                ], names=["id", "n_tokens", "n_known", "logs", "classes", "rest"])

        return step

    local = stored(
        map_batches(docs.select("id", "text"), build, f"id {kind}, n_tokens bigint, n_known bigint, logs double, classes double, rest array<bigint>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    joined = (
        local.select("row", F.explode("rest").alias("key")).join(rare, "key")
        .groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    room = float(np.log10(max(1, model.tokens + model.distinct + 1)))
    return local.drop("rest").join(joined, "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (logs - F.col("n_tokens") * room).alias("base_score"), (logs + F.col("classes")).alias("score"),
    )


def held_out(id_col: str, fold: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == remainder, F.lit(False))


def score_corpus(docs: DataFrame, fold: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents that are not held out and score all: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity (of the class model, per token).

    A null or empty text is one token, the end. A null id is never held out. Repeated rows repeat and
    are learned from as often. With nothing to learn from, base scores take V = N = 0. An empty
    table gives an empty result. Other columns are not read. Words are told apart by 64-bit keys.
    """
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    model, rare = train(given.filter(~held_out("id", fold, remainder)))
    found = score(given, model, rare)
    return found.select(
        F.col("id").alias(id_col), held_out("id", fold, remainder).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
