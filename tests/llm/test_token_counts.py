import random

import pytest
from tokenizers import Tokenizer

from planloom.llm import token_counts as tc

PARTS = ["a", "the", "'", "s", "re", " ", "  ", "\n", "\t", "é", "日", "🙂", "23", "!", "<|endoftext|>", "<|", "T", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tc.default_vocabulary())


def test_every_prefix_equals_the_library(library):
    rnd = random.Random(5)
    texts = ["", "they're  here", "a<|endoftext|> b", "x\n\n y", "'ve'll 'd", "a" * 300 + " " * 40 + "b"]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 20))) for _ in range(300)]
    count = tc.counter(tc.default_vocabulary())
    for text in texts:
        want = [len(library.encode(text[:k + 1], add_special_tokens=False).ids) for k in range(len(text))]
        assert list(count(text)) == want, text


def test_budgets_and_edges(spark, library):
    long = "word and number 17, " * 3000
    rows = [(1, "hello world", 9), (1, "hello world", 9), (2, None, 9), (3, "", 9), (None, long, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = tc.budgets(docs, 50).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert (by[1].n_bytes, by[1].n_tokens, by[1].over_limit, by[1].fitting_chars) == (11, 2, False, 11)
    assert by[2].n_tokens == by[3].n_tokens == 0
    assert by[None].over_limit and by[None].n_tokens == len(library.encode(long).ids)
    cut = by[None].fitting_chars
    assert len(library.encode(long[:cut]).ids) <= 50
    assert tc.budgets(docs.limit(0), 50).count() == 0


def test_stored_table_answers_without_encoding(spark, library):
    docs = spark.createDataFrame([(1, "They're counting 1234 tokens, aren't they?")], "doc_id int, text string")
    row = tc.prefix_counts(docs).first()
    counts = tc.read_counts(row.counts)
    assert tc.count_at(counts, 7) == len(library.encode("They're").ids)
    assert tc.count_at(counts, 0) == 0 and tc.cut_for(counts, 10**6) == 42


def test_whole_table_equals_the_library(spark, small_folder, library):
    from planloom.llm.queries import QUERIES

    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, small_folder).collect()}
    texts = spark.read.parquet(f"{small_folder}/documents.parquet").collect()
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in texts}
