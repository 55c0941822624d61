"""Byte pair encoding with a contiguous rank array per word, and decoding.

A word is held as a list of part boundaries (as token ids) and a list of the merge ranks of
neighbouring parts. The smallest rank is found by scanning, one boundary is deleted, and only
the two ranks beside it are refreshed: for words of a few parts this beats any priority
queue. Words above SHORT_WORD parts, where scanning would be quadratic, go through a heap
that makes the same merges in the same order.

Texts: NULL counts as empty; empty texts give no ids and an empty decoded text. Repeated rows
each give a row. Any further columns of the input are left alone.
"""

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.common import bounded_batches

SHORT_WORD = 200  # parts; above it merging uses a heap
CACHED_WORDS = 400_000  # about 100 MB in a worker while it has a partition
CACHED_LENGTH = 64
NO_RANK = 1 << 60


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(256 + len(symbols) - len(plain))
    return symbols


class WordCodec:
    """One tokenizer file (BPE on bytes, with or without an end-of-word suffix) as ranks and ids."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}  # by left id << 32 | right id
        self.merged: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.ids[left] << 32 | self.ids[right]
            self.ranks.setdefault(pair, rank)
            self.merged.setdefault(pair, self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.first = [self.ids.get(symbols[b]) for b in range(256)]
        self.last = [self.ids.get(symbols[b] + self.suffix) for b in range(256)]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def parts(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        found = [self.first[b] for b in data[:-1]]
        found.append(self.last[data[-1]])
        return [p for p in found if p is not None]

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > SHORT_WORD:
            return self.merge_long(parts)
        known, merged = self.ranks.get, self.merged
        ranks = [known(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)  # the leftmost of equal ranks
            part = parts[i] = merged[parts[i] << 32 | parts[i + 1]]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = known(part << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = known(parts[i - 1] << 32 | part, NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges through a heap of (rank, place)."""
        known, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [
            (rank, i, parts[i], parts[i + 1])
            for i in range(n - 1)
            if (rank := known(parts[i] << 32 | parts[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.merged[left << 32 | right], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := known(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            found = tuple(self.merge(self.parts(word)))
            if len(word) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text (id None) and special tokens with their id."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text, None
            return
        for piece in self.split_special.split(text):
            if piece:
                yield piece, self.special.get(piece)


# The word pattern of the end-of-word vocabulary.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")  # the same on ASCII


def normalize(text: str) -> str:
    """Composed form and lower case, character by character (no final sigma).

    White space only separates words here, so its runs need not be replaced.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class EndOfWordCodec(WordCodec):
    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cached = self.cache.get
        for piece, special in self.pieces(text):
            if special is not None:
                ids.append(special)
                continue
            words = ASCII_WORD if piece.isascii() else WORD
            for word in words.findall(normalize(piece)):
                ids.extend(cached(word) or self.word(word))
        return ids

    def decode(self, ids) -> str:
        """Token strings joined by a space: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=2)
def _codec(source: str) -> EndOfWordCodec:
    return EndOfWordCodec(source)


def codec_column(text: Column, spark, tokenizer_path: str) -> Column:
    """struct(ids array<int>, decoded string) of a text column.

    The tokenizer file is read by the driver (its size is that of a vocabulary, a few MB) and
    reaches the tasks as a broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @pandas_udf("ids array<int>, decoded string")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value)
        try:
            for texts in batches:
                ids = [codec.encode(t) for t in texts]
                yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids]})
        finally:
            codec.cache.clear()  # a worker lives on and may serve other stages

    return encoded(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row; `decoded` is what the ids decode to."""
    bounded_batches(docs.sparkSession)
    coded = codec_column(F.col("text"), docs.sparkSession, tokenizer_path)
    return docs.select("doc_id", coded.alias("_coded")).select("doc_id", "_coded.ids", "_coded.decoded")


def decode_documents(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids); NULL ids give an empty text, unknown ids are skipped."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = coded.sparkSession.sparkContext.broadcast(file.read())

    @pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for ids in batches:
            yield pd.Series([codec.decode(i) for i in ids])

    filled = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return coded.select("doc_id", decoded(filled).alias("decoded"))
