"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The encoding of a prefix under byte-pair merges is the encoding of a shorter prefix plus one
token: of all vocabulary entries that end the prefix, exactly one stays apart from the last token
of the rest when the two are merged together. So count[i] = count[i - len(token)] + 1, and one
walk over a piece yields its count at every prefix. Pieces (what the tokenizer's own pattern
cuts a text into) are independent, so a text's counts are those of its pieces plus a running sum.
With the counts kept, "how many tokens are the first n characters" and "where must I cut for a
budget of b tokens" are lookups; nothing is encoded again.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import map_batches, text_of

#: Counts of this many distinct pieces are kept by a worker, in two generations. Memory only:
#: a piece that is no longer kept is counted again.
KEEP_PIECES = 500_000
KEEP_PAIRS = 1_000_000
#: Pieces of more characters are counted anew each time instead of being kept. The counts of
#: shorter ones fit one byte each (a character has four bytes at most).
LONG_PIECE = 63
#: Stands for "no token" in front of a piece's first token.
NOTHING = 1 << 24


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter: printable Latin-1 bytes as
    themselves, the others as the letters from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return letters


class PrefixCounter:
    """Counts for one vocabulary file of the byte-level kind (merges applied in rank order)."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.blanks = regex.compile(r"\s{2,}(?=\S)").finditer
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges in rank order, leftmost first."""
        while len(ids) > 1:
            best = min(
                ((found[0], k) for k in range(len(ids) - 1) if (found := self.merges.get((ids[k], ids[k + 1])))),
                default=None,
            )
            if best is None:
                break
            k = best[1]
            ids[k:k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def apart(self, key: int) -> bool:
        """Do two tokens (left << 24 | right) stay as they are when their bytes are encoded
        together? With nothing on the left: is the token the encoding of its own bytes?"""
        if len(self.pairs) >= KEEP_PAIRS:
            self.pairs.clear()
        left, right = key >> 24, key & (1 << 24) - 1
        alone = left == NOTHING
        raw = self.tokens[right] if alone else self.tokens[left] + self.tokens[right]
        ids = self.merged([self.ids[raw[k:k + 1]] for k in range(len(raw))])
        found = self.pairs[key] = ids == ([right] if alone else [left, right])
        return found

    def piece(self, text: str) -> np.ndarray:
        """Token count at every character prefix of one piece."""
        raw = text.encode("utf-8", "surrogatepass")
        n, longest = len(raw), self.longest
        token_of, known, apart = self.ids.get, self.pairs.get, self.apart
        last, count = [NOTHING << 24] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(raw[start:end])
                if token is not None:
                    key = last[start] | token
                    found = known(key)
                    if found or found is None and apart(key):
                        last[end], count[end] = token << 24, count[start] + 1
                        break
        if n == len(text):
            counts = np.array(count[1:], "<u4")
        else:
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])
            counts = np.array(count, "<u4")[ends]
        if n > 1 and text[0] == "'" and text[1] in "stmdrvl" and text[1:].isalpha():
            # A contraction is one piece, but its prefix is an apostrophe and letters apart.
            for k in range(1, len(text)):
                counts[k - 1] = 1 + (self.piece(text[1:k])[-1] if k > 1 else 0)
        return counts

    def kept(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.piece(text).astype(np.uint8).tobytes()
        if len(self.young) >= KEEP_PIECES:
            self.old, self.young = self.young, {}
        self.young[text] = found
        return found

    def plain(self, text: str) -> np.ndarray:
        """Counts at every character prefix of a text without special strings."""
        pieces = self.pieces(text)
        if not pieces:
            return np.zeros(0, np.int64)
        found = list(map(self.young.get, pieces))
        large = False
        if None in found:
            large = max(map(len, pieces)) > LONG_PIECE
            for k, x in enumerate(found):
                if x is None:
                    found[k] = self.kept(pieces[k]) if len(pieces[k]) <= LONG_PIECE else self.piece(pieces[k])
        if large:
            inside = np.concatenate([np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in found]).astype(np.int64)
        else:
            inside = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        before = np.cumsum(inside[ends - 1])
        counts = inside + np.repeat(np.concatenate(([0], before[:-1])), lengths)
        # Of a run of blanks the last belongs to what follows; at the prefix that ends with it,
        # nothing follows and the run is one piece.
        for run in self.blanks(text):
            start, end = run.span()
            base = counts[start - 1] if start else 0
            counts[end - 1] = base + self.piece(run.group())[-1]
        return counts

    def __call__(self, text: str) -> np.ndarray:
        """counts[i] is the number of tokens of text[:i + 1]."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts, at, base = [], 0, 0
        for hit in self.special.finditer(text):
            ordinary = text[at:hit.start()]
            # While the special string is incomplete, its characters are ordinary text.
            counts = self.plain(ordinary + hit.group()[:-1])
            base_after = base + (self.plain(ordinary)[-1] if ordinary else 0) + 1
            parts += [counts + base, [base_after]]
            at, base = hit.end(), base_after
        parts.append(self.plain(text[at:]) + base)
        return np.concatenate(parts).astype(np.int64)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_at(counts: np.ndarray, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(counts[min(n_chars, len(counts)) - 1]) if n_chars > 0 and len(counts) else 0


def cut_for(counts: np.ndarray, budget: int) -> int:
    """The longest prefix, in characters, of at most so many tokens. Counts may fall when a
    character completes a merge, so the last fitting prefix is looked for, not the first misfit."""
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def prefix_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table: (id, n_bytes, n_tokens, counts), counts one little-endian 32-bit number per
    character prefix. Read it with read_counts(), count_at() and cut_for().

    Every row yields a row, repeated rows too; a null or empty text has no prefix and 0 tokens;
    other columns are not read. Whole texts are counted, however long. No shuffle.
    """
    path = vocabulary or default_vocabulary()

    def build():
        count = counter(path)

        def step(batch):
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                part = [t.as_py() for t in texts[at:at + 256]]
                tables = [count(t) for t in part]
                yield pa.RecordBatch.from_arrays([
                    ids[at:at + 256],
                    pa.array([len(t.encode()) for t in part], pa.int64()),
                    pa.array([int(c[-1]) if len(c) else 0 for c in tables], pa.int64()),
                    pa.array([c.astype("<u4").tobytes() for c in tables], pa.binary()),
                ], names=["id", "n_bytes", "n_tokens", "counts"])

        return step

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(given, build, f"id {kind}, n_bytes bigint, n_tokens bigint, counts binary").withColumnRenamed("id", id_col)


def read_counts(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u4").astype(np.int64)


def budgets(docs: DataFrame, budget: int, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_tokens, whether it exceeds the budget, and the longest prefix (in
    characters) that fits it. Answered from the prefix table inside the task that made it.

    Nulls, empty texts, repeated rows and extra columns: as prefix_counts().
    """
    path = vocabulary or default_vocabulary()

    def build():
        count = counter(path)

        def step(batch):
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                counts = count(text)
                rows.append((len(text.encode()), int(counts[-1]) if len(counts) else 0, cut_for(counts, budget)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["id", "n_bytes", "n_tokens", "fitting_chars"],
            )

        return step

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(given, build, f"id {kind}, n_bytes bigint, n_tokens bigint, fitting_chars bigint")
    return found.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fitting_chars"
    )
