"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

Words are maximal runs of ASCII letters, digits and any non-ASCII character, A-Z lower-cased.
A window is `width` consecutive words of an item; an item with fewer words, but not none, is
one window. Every text is scanned once, word by word; a word inside any occurrence of a
window is hit. Offsets are those of the original text, in code points.

The automaton works on word numbers, so its size is at most `width` states per window. Items
are taken in shards of at most `shard_words` words; a benchmark above that gives several automata,
and each text then passes through one after the other with the hits so far, without a shuffle.

Defined cases: a NULL or empty text has no words and no hits; items without words are never
found; items of equal text are all reported; rows of one item_id count as one item; a NULL
item_id is reported as `null`; repeated documents each give a row; an empty benchmark hits nothing.
"""

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.common import bounded_batches, free_name

WIDTH = 10
SHARD_WORDS = 2_000_000  # bounds what is broadcast and held by a worker: about 0.5 GB of states at worst
FOUND = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original, so with A-Z

# Byte by byte: A-Z become lower case, every ASCII character outside words becomes a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The automaton of (item id, text) pairs."""

    def __init__(self, items: tuple[tuple[str, str], ...], width: int):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            known = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(max(1, len(known) - width + 1) if known else 0):
                windows.setdefault(tuple(known[i : i + width]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in windows.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(owners))))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, (first, last) words of each occurrence, items found."""
        found = words(text)
        spans, items = [], set()
        if found and not self.empty:
            get = self.numbers.get
            for end, (length, owners) in self.automaton.iter(tuple([get(w, 0) for w in found])):
                spans.append((end - length + 1, end))
                items.update(owners)
        return len(found), spans, items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching word spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


@lru_cache(maxsize=4)
def _windows(items: tuple[tuple[str, str], ...], width: int) -> Windows:
    return Windows(items, width)


def _scanner(shared, width: int):
    @pandas_udf(FOUND)
    def scanned(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automaton = _windows(shared.value, width)
        for texts, before in batches:
            counts, spans, items = [], [], []
            for text, old_spans, old_items in zip(texts, before["spans"], before["items"]):
                n, new, owners = automaton.scan(text)
                old = [(s["first"], s["last"]) for s in old_spans]
                counts.append(n)
                spans.append([{"first": int(a), "last": int(b)} for a, b in joined(old + new)])
                items.append(sorted(owners.union(old_items)))
            yield pd.DataFrame({"n_words": counts, "spans": spans, "items": items})

    return scanned


def item_shards(benchmark: DataFrame, shard_words: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """(item id, text) pairs in runs of at most `shard_words` words each (or one longer item)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")
    shard, size = [], 0
    for item_id, text in rows.where("text IS NOT NULL").distinct().toLocalIterator():
        n = len(words(text))
        if shard and size + n > shard_words:
            yield tuple(sorted(shard))
            shard, size = [], 0
        shard.append((item_id, text))
        size += n
    yield tuple(sorted(shard))


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, into: str = "found") -> DataFrame:
    """`docs` with `into`: struct(n_words, disjoint hit spans as word numbers, item ids)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce("text", F.lit(""))
    none = F.from_json(F.lit('{"n_words":0,"spans":[],"items":[]}'), FOUND)
    out = docs.withColumn(into, none)
    for items in item_shards(benchmark, shard_words):
        out = out.withColumn(into, _scanner(spark.sparkContext.broadcast(items), width)(text, F.col(into)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated); `items` sorted as strings."""
    found = find_items(docs.select("doc_id", "text"), benchmark, width, shard_words)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "found.n_words",
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.array_sort("found.items").alias("items"),
        (hit > 0).alias("contaminated"),
    )


def hit_offsets(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start, end) of every disjoint hit stretch in the original text, end exclusive."""

    @pandas_udf("array<struct<start:int,end:int>>")
    def offsets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts, spans):
                places = [m.span() for m in WORD.finditer(text)] if len(found) else []
                out.append([{"start": places[s["first"]][0], "end": places[s["last"]][1]} for s in found])
            yield pd.Series(out)

    found = find_items(docs.select("doc_id", "text"), benchmark, width, shard_words)
    found = found.where(F.size("found.spans") > 0)
    places = found.select("doc_id", F.explode(offsets("text", "found.spans")).alias("place"))
    return places.select("doc_id", "place.start", "place.end")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of `docs` in which no window occurs, with the columns as they came."""
    into = free_name(docs, "found")
    found = find_items(docs, benchmark, width, shard_words, into)
    return found.where(F.size(F.col(f"`{into}`.spans")) == 0).select(*[f"`{c}`" for c in docs.columns])
