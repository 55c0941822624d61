"""Exact token counts at every prefix of a text, by dynamic programming.

The encoding of a word's prefix ends in the one token t for which the encoding of the rest ends in a
token that stays apart from t when both are encoded together. So one entry per prefix is enough: its last token
and its count, which is the count of the shorter prefix plus 1. Whole texts add up their words; a
budget question ("how much of the text fits in n tokens?") reads the same entries, nothing is encoded again.

Words that a shorter text would split differently (runs of white space, contractions, special tokens cut in the
middle) are followed exactly: a count is always that of the text cut at that place.

Defined cases: a NULL text counts as empty, an empty text has 0 tokens; repeated rows each give a row.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.bpe import CACHED_LENGTH, CACHED_WORDS, NO_RANK, WordCodec, byte_symbols
from groundcover.llm.common import bounded_batches

LIMIT = 512
CACHED_PAIRS = 1_000_000

# The word pattern of the byte-level vocabulary, and the same on ASCII.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x09-\x0D\x20A-Za-z0-9]+|"
    r"[\x09-\x0D\x20]+(?![^\x09-\x0D\x20])|[\x09-\x0D\x20]+"
)
BLANK = regex.compile(r"\s+")


def split_words(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


class PrefixCounter(WordCodec):
    """Counts of a byte-level tokenizer file (no end-of-word suffix)."""

    def __init__(self, source: str):
        super().__init__(source)
        byte_of = {s: b for b, s in byte_symbols().items()}
        self.by_bytes: dict[bytes, int] = {}
        for token, number in self.ids.items():
            self.by_bytes[bytes(byte_of[c] for c in token)] = number
        self.bytes_of = {number: data for data, number in self.by_bytes.items()}
        self.made = dict.fromkeys(self.bytes_of, (-1, -1, -1))  # rank and parts of the merge that makes a token
        for pair, rank in sorted(self.ranks.items(), key=lambda item: -item[1]):
            self.made[self.merged[pair]] = (rank, pair >> 32, pair & 0xFFFFFFFF)
        self.starts = {data[:n]: -1 for data in self.by_bytes for n in range(1, len(data))} | self.by_bytes
        self.apart: dict[int, bool] = {}
        self.counts: dict[str, int] = {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are left alone when their bytes are encoded together.

        Their last merges are undone from the latest to the earliest (of equal ranks the right one
        came later), and the parts that then touch must not have had an earlier merge of their own.
        """
        key = left << 32 | right
        found = self.apart.get(key)
        if found is None:
            found = self._undo(left, right)
            if len(self.apart) >= CACHED_PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found

    def _undo(self, left: int, right: int) -> bool:
        limit = NO_RANK
        while True:
            if self.ranks.get(left << 32 | right, NO_RANK) < limit:
                return False
            (made_left, _, left_end), (made_right, right_begin, _) = self.made[left], self.made[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, left_end
            else:
                limit, right = made_right + 1, right_begin

    def prefixes(self, data: bytes) -> list[int]:
        """Token count of each prefix of one word, by bytes; entry 0 is the empty prefix."""
        get, apart, n = self.starts.get, self.apart.get, len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            before, more = last[begin] << 32, count[begin] + 1
            for end in range(begin + 1, n + 1):
                token = get(data[begin:end])
                if token is None:
                    break  # no token starts like this
                if token < 0 or count[end]:
                    continue
                if begin:
                    fits = apart(before | token)
                    if fits is None:
                        fits = self.stays_apart(before >> 32, token)
                    if not fits:
                        continue
                last[end], count[end] = token, more
        return count

    def word_count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is None:
            found = self.prefixes(word.encode("utf-8", "surrogatepass"))[-1]
            if len(word) <= CACHED_LENGTH:
                if len(self.counts) >= CACHED_WORDS:
                    self.counts.clear()
                self.counts[word] = found
        return found

    def count(self, text: str) -> int:
        total, get, miss = 0, self.counts.get, self.word_count
        for piece, special in self.pieces(text):
            if special is not None:
                total += 1
                continue
            for word in split_words(piece):
                total += get(word) or miss(word)
        return total

    def _by_chars(self, word: str) -> list[int]:
        """Counts after each character of a word that is alone."""
        count, at, out = self.prefixes(word.encode("utf-8", "surrogatepass")), 0, []
        for char in word:
            at += len(char.encode("utf-8", "surrogatepass"))
            out.append(count[at])
        return out

    def _plain_prefixes(self, text: str) -> list[int]:
        """Counts of each prefix of a text without special tokens; entry 0 is the empty one."""
        out, base = [0], 0
        blanks, before = "", 0  # the white space just passed, and the count before it
        for word in split_words(text):
            space = BLANK.match(word)
            lead = space.group() if space else ""
            if lead:
                if not blanks:
                    before = base
                known = self._by_chars(blanks + lead)
                out.extend(before + n for n in known[len(blanks) :])
            if len(lead) < len(word):
                counts = self._by_chars(word)[len(lead) :]
                if len(word) == 3 and word in ("'re", "'ve", "'ll"):
                    counts[1] = self.word_count("'") + self.word_count(word[1])
                out.extend(base + n for n in counts)
                blanks = ""
            else:
                blanks += lead
            base += self.word_count(word)
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of text[:i] for each i from 0 to the length."""
        out, base = [0], 0
        pieces = [*self.pieces(text), ("", -1)]
        plain = ""
        for piece, special in pieces:
            if special is None:
                plain = piece
                continue
            cut = plain + piece[:-1]
            counts = self._plain_prefixes(cut)
            out.extend(base + n for n in counts[1:])
            if special >= 0:
                base += counts[len(plain)] + 1
                out.append(base)
            plain = ""
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Length of the longest prefix with at most `budget` tokens."""
        total, at, safe, safe_total = 0, 0, 0, 0
        for unit, tokens, solid in self._units(text):
            total += tokens
            at += len(unit)
            if not solid:
                continue
            if total > budget:
                break  # later prefixes only have more tokens
            safe, safe_total = at, total
        # The words from `safe` on are split as in the whole text.
        counts = self.prefix_counts(text[safe:at])
        return safe + max(i for i, n in enumerate(counts) if safe_total + n <= budget)

    def _units(self, text: str) -> Iterator[tuple[str, int, bool]]:
        """Stretches of a text, their tokens, and whether the text after them is counted on its own.

        White space is not cut from what follows, nor the word before a special token from that:
        with a part of either, it may be split differently.
        """
        held, tokens = "", 0
        for piece, special in self.pieces(text):
            if special is not None:
                yield held + piece, tokens + 1, True
                held, tokens = "", 0
                continue
            for word in split_words(piece):
                if held:
                    yield held, tokens, not held[-1].isspace()
                held, tokens = word, self.word_count(word)
        if held:
            yield held, tokens, True


@lru_cache(maxsize=2)
def _counter(source: str) -> PrefixCounter:
    return PrefixCounter(source)


def count_column(text: Column, spark, tokenizer_path: str, limit: int = LIMIT) -> Column:
    """struct(n_tokens, fitting_chars): all tokens, and the code points that `limit` tokens can hold."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())  # a vocabulary, a few MB

    @pandas_udf("n_tokens long, fitting_chars long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(shared.value)
        try:
            for texts in batches:
                counts = [counter.count(t) for t in texts]
                fitting = [len(t) if n <= limit else counter.fitting(t, limit) for t, n in zip(texts, counts)]
                yield pd.DataFrame({"n_tokens": counts, "fitting_chars": fitting})
        finally:
            counter.counts.clear()  # a worker lives on and may serve other stages

    return counted(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars) of every row."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        count_column(F.col("text"), docs.sparkSession, tokenizer_path, limit).alias("counted"),
    )
    return counted.select(
        "doc_id", "n_bytes", "counted.n_tokens", (F.col("counted.n_tokens") > limit).alias("over_limit"),
        "counted.fitting_chars",
    )
