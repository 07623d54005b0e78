"""Language of documents, word by word, with a linear-chain conditional random field.

Each word is labelled by its affixes, character n-grams and its place in a lexicon of known words;
learned transitions say how likely the language changes from one word to the next. The posterior of
every word comes from forward-backward over the whole text, and a document's language is the one
with the greatest mean posterior. Words of texts in two languages get labels of their own.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import map_batches, text_of

#: Bounds of the sample the model is fitted on: documents of each language, and words of each of them (a
#: stretch at a seeded place). Every language is a label. Predictions use whole texts.
SAMPLE_DOCS, SAMPLE_WORDS = 600, 120
#: Posteriors that fitting holds at a time: words of the sample times labels. Where there are many
#: languages, fewer documents of each are taken, LEAST_DOCS at least.
POSTERIORS, LEAST_DOCS = 1 << 26, 12
#: Feature weights: a table of fixed size, addressed by hash.
WEIGHTS = 1 << 17
LEXICON_COUNT = 3
STEPS, RATE, DECAY = 40, 0.5, 1e-4
#: Words whose scores a worker keeps, and words it labels in one go.
KEEP_WORDS, GO = 400_000, 1_000_000
UNKNOWN = "und"

letters = re.compile(r"[^\W\d_]+").findall


def features(word: str, lexicon: frozenset) -> list[int]:
    """Hashes of a word's features."""
    w = f"^{word}$"
    n = len(w)
    names = [f"p{w[:2]}", f"p{w[:3]}", f"p{w[:4]}", f"s{w[-2:]}", f"s{w[-3:]}", f"s{w[-4:]}", f"l{min(n, 12)}"]
    names += [w[k:k + 2] for k in range(n - 1)]
    names += [w[k:k + 3] for k in range(n - 2)]
    names.append(f"w{word}" if word in lexicon else "?")
    return [zlib.crc32(x.encode()) % WEIGHTS for x in names]


@dataclass
class Model:
    labels: list[str]
    lexicon: frozenset
    weights: np.ndarray  # (WEIGHTS, labels)
    start: np.ndarray
    moves: np.ndarray  # log potentials, (from, to)


def word_scores(found: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each word's features."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.concatenate([np.array(f, np.int64) for f in found])
    return np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Posteriors of sequences laid out by step: the words at step t of all sequences that have one,
    longest sequence first. Returns posteriors in that layout, expected moves, and the summed log
    of the normalisers."""
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
    ends = np.cumsum(active)
    begins = ends - active
    top = scores.max(axis=1, keepdims=True)
    emit, step = np.exp(scores - top), np.exp(moves)
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    now = np.exp(start)[None, :] * emit[:active[0]]
    for t in range(steps):
        if t:
            now = (now[:active[t]] @ step) * emit[begins[t]:ends[t]]
        total = now.sum(axis=1)
        now = now / total[:, None]
        alpha[begins[t]:ends[t]], scale[begins[t]:ends[t]] = now, total
    expected = np.zeros_like(step)
    post = alpha.copy()
    beta = np.ones((active[0], len(start)))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = emit[begins[t + 1]:ends[t + 1]] * beta[:n] / scale[begins[t + 1]:ends[t + 1], None]
        expected += alpha[begins[t]:begins[t] + n].T @ ahead
        beta[:n] = ahead @ step.T
        post[begins[t]:begins[t] + n] *= beta[:n]
    return post, expected * step, float(np.log(scale).sum() + top.sum())


def by_step(lengths: np.ndarray) -> np.ndarray:
    """For sequences laid end to end, longest first: the places of their words in step order."""
    starts = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    step = np.repeat(np.arange(len(active)), active)
    within = np.arange(int(active.sum())) - np.repeat(np.cumsum(active) - active, active)
    return starts[within] + step


def fit(samples: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Fit on (language, words) stretches. So that changes of language can be learned, stretches are
    cut and spliced with those of other documents before each is one sequence."""
    rnd = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in samples})
    pieces = []
    for lang, words in samples:
        at = 0
        while at < len(words):
            n = int(rnd.integers(8, 40))
            pieces.append((labels.index(lang), words[at:at + n]))
            at += n
    order = rnd.permutation(len(pieces))
    sequences, at = [], 0
    while at < len(order):
        n = int(rnd.integers(1, 5))
        sequences.append([pieces[k] for k in order[at:at + n]])
        at += n
    sequences.sort(key=lambda s: -sum(len(w) for _, w in s))
    counts: dict[str, int] = {}
    for _, words in samples:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_COUNT)
    types = {w: k for k, w in enumerate(counts)}
    found = [features(w, lexicon) for w in types]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat, owner = np.concatenate([np.array(f, np.int64) for f in found]), np.repeat(np.arange(len(found)), sizes)
    lengths = np.array([sum(len(w) for _, w in s) for s in sequences])
    place = by_step(lengths)
    words = np.array([types[w] for s in sequences for _, ws in s for w in ws])[place]
    gold = np.array([k for s in sequences for k, ws in s for _ in ws])
    moved = np.zeros((len(labels), len(labels)))
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lengths) - 1] = False
    before = np.flatnonzero(inner)
    np.add.at(moved, (gold[before], gold[before + 1]), 1)
    gold = gold[place]
    n = len(words)
    weights, start, moves = np.zeros((WEIGHTS, len(labels))), np.zeros(len(labels)), np.zeros_like(moved)
    seen = [np.full_like(x, 1e-8) for x in (weights, start, moves)]
    right = np.zeros((n, len(labels)))
    right[np.arange(n), gold] = 1
    first = len(lengths)
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
        post, expected, _ = forward_backward(scores[words], lengths, start, moves)
        wrong = right - post
        by_type = np.zeros((len(types), len(labels)))
        np.add.at(by_type, words, wrong)
        slopes = np.stack([np.bincount(flat, by_type[owner, k], WEIGHTS) for k in range(len(labels))], axis=1)
        for x, g, s in zip(
            (weights, start, moves), (slopes / n - DECAY * weights, wrong[:first].sum(axis=0) / first, (moved - expected) / n), seen, strict=True
        ):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Model(labels, lexicon, weights.astype(np.float32), start, moves)


class Labeller:
    """Predicts with a model; keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.numbers: dict[str, int] = {}
        self.scores = np.empty((0, len(model.labels)))

    def score(self, words: list[str]) -> np.ndarray:
        if len(self.numbers) > KEEP_WORDS:
            self.numbers, self.scores = {}, self.scores[:0]
        found = list(map(self.numbers.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None))
            self.numbers.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            for at in range(0, len(new), 50_000):
                part = [features(w, self.model.lexicon) for w in new[at:at + 50_000]]
                self.scores = np.concatenate([self.scores, word_scores(part, self.model.weights).astype(np.float64)])
            found = list(map(self.numbers.get, words))
        return self.scores[np.array(found, np.int64)]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Posterior of every word of every text (words each); texts without words get none."""
        out = [np.empty((0, len(self.model.labels)))] * len(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: -len(texts[k]))
        while order:
            total, n = 0, 0
            while n < len(order) and (not n or total + len(texts[order[n]]) <= GO):
                total += len(texts[order[n]])
                n += 1
            part, order = order[:n], order[n:]
            lengths = np.array([len(texts[k]) for k in part])
            place = by_step(lengths)
            scores = self.score([w for k in part for w in texts[k]])
            post, _, _ = forward_backward(scores[place], lengths, self.model.start, self.model.moves)
            laid = np.empty_like(post)
            laid[place] = post
            for k, p in zip(part, np.split(laid, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = p
        return out


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, words_each: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """At most docs_each documents of every language, in seeded order, and of each at most words_each words
    from a seeded place. Rows: (id, lang, text), language not null."""
    n = F.xxhash64(F.col("id").cast("string"), F.lit(31))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy("lang").collect()
    docs_each = min(docs_each, max(LEAST_DOCS, POSTERIORS // (words_each * max(1, len(sizes)) ** 2)))
    # A threshold on the hash leaves about twice as many documents of each language as are wanted, so
    # that no task orders a whole language; it is part of the scan's filter, so no text is shuffled.
    wanted = F.lit(False)
    for r in sizes:
        share = min(1.0, (2.0 * docs_each + 50) / r.docs)
        wanted = wanted | (F.col("lang") == r.lang) & (F.col("n") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
    few = docs.withColumn("n", n).filter(wanted)

    def stretches(batches):
        for batch in batches:
            rows = []
            for lang, number, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = letters(text.lower())
                at = number % (len(words) - words_each + 1) if len(words) > words_each else 0
                rows.append((lang, number, words[at:at + words_each]))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.string()))], names=["lang", "n", "words"])

    cut = few.select(F.col("lang").cast("string"), "n", "text").mapInArrow(stretches, "lang string, n bigint, words array<string>")
    rows = cut.filter(F.size("words") > 0).collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n, r.words)):
        if len(kept.setdefault(r.lang, [])) < docs_each:
            kept[r.lang].append(list(r.words))
    return [(lang, words) for lang, found in kept.items() for words in found]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, docs_each: int = SAMPLE_DOCS) -> Model | None:
    """Fit on documents with a language whose crc32(id as text) mod `fold` is not 0; None without any."""
    given = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    found = sample(given.filter(F.col("lang").isNotNull() & ~held_out("id", fold)), docs_each)
    return fit(found) if found else None


def held_out(id_col: str, fold: int):
    """crc32 of the id as text, mod fold, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == 0, F.lit(False))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, lang_pred, score (the mean posterior of lang_pred over the
    words), n_words, switches (places where the likeliest language changes).

    A null text, a text without a letter, and every text where nothing could be learned, are `und`
    with score 0. Only the text is read. Repeated rows repeat; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    schema = f"id {kind}, lang_pred string, score double, n_words bigint, switches bigint"

    def build():
        label = Labeller(sent.value) if sent.value else None

        def step(batch):
            for at in range(0, len(batch), 1000):
                texts = [letters(t.as_py().lower()) for t in batch.column(1)[at:at + 1000]]
                rows = []
                for post in label.posteriors(texts) if label else [()] * len(texts):
                    if not len(post):
                        rows.append((UNKNOWN, 0.0, 0, 0))
                        continue
                    mean, best = post.mean(axis=0), post.argmax(axis=1)
                    k = int(mean.argmax())
                    rows.append((label.model.labels[k], float(min(1.0, max(0.0, mean[k]))), len(post), int((best[1:] != best[:-1]).sum())))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[at:at + 1000], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                ], names=["id", "lang_pred", "score", "n_words", "switches"])

        return step

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_batches(given, build, schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, fold: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Train on one part of the documents and predict all: (id, held_out, lang_pred, score, n_words,
    switches)."""
    found = predict(docs, train(docs, id_col=id_col, fold=fold), id_col)
    return found.select(id_col, held_out(id_col, fold).alias("held_out"), "lang_pred", "score", "n_words", "switches")


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that predict() gives a language, with all their columns; `und` goes. Rows
    pass through one map: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col))
    place = docs.columns.index(text_col)

    def run(batches):
        label = Labeller(sent.value) if sent.value else None
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                texts = [letters((t.as_py() or "").lower()) for t in part.column(place)]
                found = label.posteriors(texts) if label else [()] * len(texts)
                yield part.filter(pa.array([len(p) > 0 for p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
