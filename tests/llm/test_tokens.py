import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundcover.llm import bpe, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "<|endoftext|>", "<|startoftext|>", "<|endo", "'re", " 've", "don't", "  ", "\n\n", " the", "ing", "Hello", "....", "é", "É",
    "Σς", "中文", "İ", "\t ", "1984", "\x1c", "\x85", "​", "👍", "á", "Ⅷ²",
]


def texts(n=300):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def test_words_match_the_library(word_library):
    codec = bpe._codec(open(WORDS, encoding="utf-8").read())
    for text in [*texts(), "ab" * 3000, "x" * 777, "-" * 500]:
        ids = word_library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == word_library.decode(ids, skip_special_tokens=False)


def test_heap_and_scan_merge_alike():
    codec = bpe._codec(open(WORDS, encoding="utf-8").read())
    for word in ("understanding" * 4, "aaaaaaaaaaaaaaaaaa", "ababababbaba" * 9):
        assert codec.merge_long(codec.parts(word)) == codec.merge(codec.parts(word))


def test_every_prefix_count_is_that_of_the_cut_text(byte_library):
    counter = token_counts._counter(open(BYTES, encoding="utf-8").read())

    def n(text):
        return len(byte_library.encode(text, add_special_tokens=False).ids)

    for text in texts(150):
        expected = [n(text[:i]) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == expected, text
        assert counter.count(text) == expected[-1]
        for budget in (0, 1, 2, 5):
            assert counter.fitting(text, budget) == max(i for i, c in enumerate(expected) if c <= budget), text
    for text in ("ab" * 4000, "x" * 999, " " * 5000, "ñe" * 700):
        assert counter.count(text) == n(text)


def test_documents_of_every_kind(spark, odd_docs, no_docs, word_library, byte_library):
    coded = bpe.encode_documents(odd_docs, WORDS).collect()
    counted = token_counts.count_tokens(odd_docs, BYTES).collect()
    given = [r["text"] or "" for r in odd_docs.collect()]
    assert [r["ids"] for r in coded] == [word_library.encode(t, add_special_tokens=False).ids for t in given]
    assert [r["n_tokens"] for r in counted] == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in given]
    assert [r["n_bytes"] for r in counted] == [len(t.encode()) for t in given]
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in counted)
    again = bpe.decode_documents(bpe.encode_documents(odd_docs, WORDS), WORDS).collect()
    assert [r["decoded"] for r in again] == [r["decoded"] for r in coded]
    none = spark.createDataFrame([(1, None), (2, [49999999, 0])], "doc_id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode_documents(none, WORDS).collect()] == ["", "!"]
    assert bpe.encode_documents(no_docs, WORDS).count() == token_counts.count_tokens(no_docs, BYTES).count() == 0
