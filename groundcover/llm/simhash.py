"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints with at most 4 differing bits have a common point within 2 bits of both. Every
distinct fingerprint emits all points within 2 bits (1 + 64 + 2016 variants), variants are
shuffled, and fingerprints that meet in one are linked: two that share a point are within 4 bits
of each other, so a star from the smallest of them keeps all links of the point without
emitting its pairs. Components of these links give the groups.

2081 rows per fingerprint would be more than ten times the texts, so fingerprints travel and variants don't. A
point's bucket is its fold: `width` parities, the k-th of its bits k, k + width, k + 2 * width, ... Changing two bits changes
at most two parities, so a fingerprint has its variants in 1 + width + width * (width - 1) / 2 buckets (67 of 2048) and is sent to
those alone, 8 bytes each; a bucket makes the variants that fall into it. Copies with a few bits changed
differ in their parities, too: of 2048 buckets none gets more than 0.6 % of the variants of a large group of them, and one
point holds at most 2081 fingerprints, so no task holds a whole group of copies. Buckets hold about BUCKET_ENTRIES variants whatever
the input. Within one, points are compared by a hash that has at least 2^HASH_SLACK values per
variant; meetings by hash alone are verified, and a point where not all members are within 4 bits is resolved
by its true variants.

Texts: A-Z are lower-cased, words are runs without ASCII white space, shingles are `width`
consecutive words (repeats included) joined by a blank; fewer words give one shingle; no words
(NULL and empty texts) give fingerprint 0, linked like any other. Repeated rows and equal
texts share a fingerprint. A component is named by its smallest doc_id (of any type that has an order); NULL ids never name one.

4 of 64 bits is a similarity near 0.95; copies changed more than that are another operator's work.
"""

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.common import bounded_batches, free_name
from groundcover.llm.components import components
from groundcover.session import materialize

WIDTH = 4
SEED = 42
NEAR = 4  # bits
BLOCK = 16_384  # fingerprints dealt to buckets at a time
HASHED = 4096  # shingles at a time
HASH_SLACK = 10
BUCKET_ENTRIES = 4_000_000
TASK_BUCKETS = 4
POINTS = 1 << 18  # made at a time


def shingle_hashes(text: str, width: int, seed: int) -> tuple[int, Iterator[np.ndarray]]:
    """How many shingles a text has, and their hashes some thousand at a time (very long texts included)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, iter(())
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    size = min(width, len(words))
    starts = np.r_[0, blanks + 1][: len(words) - size + 1]
    ends = np.r_[blanks, len(joined)][size - 1 :]
    digest = xxhash.xxh64_intdigest

    def parts() -> Iterator[np.ndarray]:
        for i in range(0, len(starts), HASHED):
            places = zip(starts[i : i + HASHED].tolist(), ends[i : i + HASHED].tolist())
            yield np.array([digest(joined[s:e], seed) for s, e in places], np.uint64)

    return len(starts), parts()


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' hashes; 0 without words."""
    count, parts = shingle_hashes(text, width, seed)
    ones = np.zeros(64, np.int64)
    for part in parts:
        rows = part.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprint_column(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """The fingerprint as a signed long with the same 64 bits."""

    @pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.array([fingerprint(t, width, seed) for t in texts], np.uint64)
            yield pd.Series(prints.view(np.int64))

    return marked(F.coalesce(text, F.lit("")))


_ODD = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio in 64 bits


def _masks() -> np.ndarray:
    bits = [1 << i for i in range(64)]
    return np.array([0, *bits, *(a | b for a, b in combinations(bits, 2))], np.uint64)


MASKS = _masks()
VARIANTS = len(MASKS)


def _mixed(points: np.ndarray, hash_bits: int) -> np.ndarray:
    """The top `hash_bits` bits of a hash of 64-bit points."""
    with np.errstate(over="ignore"):
        mixed = points * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
    return mixed >> np.uint64(64 - hash_bits)


def _folds(points: np.ndarray, width: int) -> np.ndarray:
    """`width` parities of each point, the k-th that of its bits k, k + width, k + 2 * width, ..."""
    folds = np.zeros(points.shape, np.int64)
    for k in range(width):
        bits = np.uint64(sum(1 << i for i in range(k, 64, width)))
        folds |= (np.bitwise_count(points & bits) & 1).astype(np.int64) << k
    return folds


@cache
def _masks_by_fold(width: int) -> dict[int, np.ndarray]:
    """The masks that change a point's fold in the same way."""
    folds = _folds(MASKS, width)
    return {int(f): MASKS[folds == f] for f in np.unique(folds)}


DEALT = "bucket int, rest int, prints binary"


def _dealt(prints: np.ndarray, hash_bits: int, buckets: int) -> Iterator[pd.DataFrame]:
    """The fingerprints of one block that have variants in each bucket, some buckets at a time.

    There are as many buckets as folds, at least `buckets`; a fold is the first bits of a point's hash, `rest` the number of the others.
    """
    width = (buckets - 1).bit_length()
    steps = np.array(list(_masks_by_fold(width)))
    into = (_folds(prints, width) ^ steps[:, None]).ravel()
    order = np.argsort(into)
    into, sent = into[order], prints[order % len(prints)]
    cuts = [0, *(np.flatnonzero(np.diff(into)) + 1).tolist(), len(into)]
    for i in range(0, len(cuts) - 1, 1024):
        rows = [
            (int(into[start]), hash_bits - width, sent[start:stop].tobytes())
            for start, stop in zip(cuts[i : i + 1024], cuts[i + 1 : i + 1025])
        ]
        yield pd.DataFrame(rows, columns=["bucket", "rest", "prints"])


def _packer(hash_bits: int, buckets: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            size += len(batch)
            while size >= 2 * BLOCK:
                prints = np.concatenate(held)
                held, size = [prints[BLOCK:]], size - BLOCK
                yield from _dealt(prints[:BLOCK], hash_bits, buckets)
        if size:
            yield from _dealt(np.concatenate(held), hash_bits, buckets)

    return pack


def _meetings(prints: np.ndarray, bucket: int, width: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several variants in the bucket have, with the fingerprint of each such variant."""
    steps = _folds(prints, width) ^ bucket
    order = np.argsort(steps)
    prints = prints[order]
    steps, begins, counts = np.unique(steps[order], return_index=True, return_counts=True)
    masks = [_masks_by_fold(width)[s] for s in steps.tolist()]
    firsts = np.r_[0, np.cumsum([len(m) * n for m, n in zip(masks, counts.tolist())])]
    hashes = np.empty(firsts[-1], np.uint32 if rest <= 32 else np.uint64)
    for first, begin, count, some in zip(firsts.tolist(), begins.tolist(), counts.tolist(), masks):
        lines = max(1, POINTS // count)
        for i in range(0, len(some), lines):
            made = _mixed(some[i : i + lines, None] ^ prints[begin : begin + count], rest).ravel()
            hashes[first + i * count :][: len(made)] = made
    ordered = np.sort(hashes)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return met, np.empty(0, np.uint64)
    high = max(0, rest - 20)
    seen = np.zeros(1 << (rest - high), bool)  # few hashes begin like one that meets: only those are looked up
    seen[met >> high] = True
    places = np.flatnonzero(seen[hashes >> high])
    found = hashes[places]
    meets = met[np.minimum(np.searchsorted(met, found), len(met) - 1)] == found
    places, found = places[meets], found[meets]
    part = np.searchsorted(firsts, places, "right") - 1
    return found, prints[begins[part] + (places - firsts[part]) % counts[part]]


def _bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _stars(hashes: np.ndarray, prints: np.ndarray, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (centre, other) of fingerprints that meet in one hash."""
    ordered = np.lexsort((prints, hashes))
    hashes, prints = hashes[ordered], prints[ordered]
    begins = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    sizes = np.diff(np.r_[begins, len(hashes)])
    centres = np.repeat(prints[begins], sizes)
    near = _bits_between(centres, prints) <= NEAR
    whole = np.repeat(np.minimum.reduceat(near, begins) if len(begins) else near, sizes)
    keep = whole & (centres != prints)
    left, right = [centres[keep]], [prints[keep]]
    # Different points under one hash: two fingerprints are just no link, of more the true points are found again.
    mixed = ~whole & (np.repeat(sizes, sizes) > 2)
    for start in range(0, int(mixed.sum()), 1024):
        some, values = prints[mixed][start : start + 1024], hashes[mixed][start : start + 1024]
        row, mask = np.nonzero(_mixed(some[:, None] ^ MASKS[None, :], hash_bits) == values[:, None])
        points = some[row] ^ MASKS[mask]
        left.append(points)  # a point is a node of its own: it is within 2 bits of the fingerprint
        right.append(some[row])
    return np.concatenate(left), np.concatenate(right)


def _linker(hash_bits: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        bucket, rest = int(group["bucket"].iloc[0]), int(group["rest"].iloc[0])
        prints = np.concatenate([np.frombuffer(p, np.uint64) for p in group["prints"]])
        hashes, prints = _meetings(prints, bucket, hash_bits - rest, rest)
        if not len(hashes):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        left, right = _stars(hashes, prints, rest)
        return pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)}).drop_duplicates()

    return link


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column `fp`) within NEAR bits.

    Each fingerprint within NEAR bits of another is connected to it, directly or through
    others that are truly linked.
    """
    n = prints.count()
    hash_bits = max(16, (n * VARIANTS).bit_length() + HASH_SLACK)
    buckets = max(1, math.ceil(n * VARIANTS / BUCKET_ENTRIES))
    blocks = prints.select("fp").repartition(max(1, math.ceil(n / BLOCK)), "fp")
    dealt = blocks.mapInPandas(_packer(hash_bits, buckets), DEALT)
    # A bucket is small and makes thousands of times its size: its tasks are not left to Spark's choice by size.
    dealt = dealt.repartition(math.ceil(buckets / TASK_BUCKETS), "bucket")
    return dealt.groupBy("bucket").applyInPandas(_linker(hash_bits), "a long, b long")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _labels(docs: DataFrame, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and one row per distinct fingerprint: fp, root, component_id,
    `chosen` (true for one fingerprint of each group that holds the component_id) and `text_hash`
    of one of its texts with the smallest id."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", _text_hash().alias("text_hash"), fingerprint_column(F.col("text"), width, seed).alias("fp"))
    marked = materialize(rows, "prints")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    prints = materialize(marked.groupBy("fp").agg(F.min(order).alias("first")), "distinct-prints")
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    member = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = materialize(member, "members")
    named = member.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("least"), F.count(F.lit(1)).alias("n"))
    several = named.where("n > 1").select("root", "least")
    labels = member.join(several, "root", "left").select(
        "fp",
        "root",
        F.coalesce("least.first", "first")["doc_id"].alias("component_id"),
        (F.coalesce("least.fp", "fp") == F.col("fp")).alias("chosen"),
        F.col("first.text_hash").alias("text_hash"),
    )
    return marked, labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; `root` names the group where ids are all NULL."""
    marked, labels = _labels(docs, width, seed)
    return marked.select("doc_id", "fp").join(labels, "fp").select("doc_id", "fp", "root", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row of each group of near duplicates, with the columns as they came.

    The row with the group's smallest doc_id stays. If several texts of the group have that id, one of them
    stays (that of the smallest hash); of equal rows, any one. Rows meet the choice by id and text hash together, so
    a group's size makes no key hot and no text is marked twice.
    """
    _, labels = _labels(docs, width, seed)
    key, missing, hashed = (free_name(docs, n) for n in ("key", "missing", "text_hash"))
    choice = labels.where("chosen").select(
        F.coalesce(F.col("component_id").cast("string"), F.lit("")).alias(key),
        F.col("component_id").isNull().alias(missing),
        F.col("text_hash").alias(hashed),
    )
    keyed = docs.withColumns({
        key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        missing: F.col("doc_id").isNull(),
        hashed: _text_hash(),
    })
    kept = keyed.join(choice, [key, missing, hashed], "left_semi")
    return kept.dropDuplicates([key, missing, hashed]).select(*[f"`{c}`" for c in docs.columns])
