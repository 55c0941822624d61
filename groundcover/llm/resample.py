"""Importance resampling of documents towards a target text collection, and exact global ranks by regular sampling.

Features are runs of words, hashed to a fixed number of buckets. Two counts per bucket, over all documents and all target texts,
give every bucket a gain (a log ratio, floored to a whole number); the gains are one array of `BUCKETS` numbers that the tasks index
by bucket. A document's weight is the sum of its features' gains, its score adds Gumbel noise derived from its id, and the highest
scores are drawn: sampling without replacement in proportion to exp(weight / 1000).

The draw is a parallel sort by regular sampling: each task sorts its rows (a run) and gives every so-manieth of them as a sample, the
sorted samples give splitters, rows go to the segment between two splitters where the pieces of all runs are merged, and counts of the
segments before give every row its exact rank. The full order ends with the run and the place in it, so that equal rows, even a
third of all, spread over segments; only the samples and the segment counts (a few per segment) reach the driver.

Defined cases: NULL and empty texts have no features and weight 0; a NULL id is hashed as the text `null` and is smaller than any other in
ties; repeated rows each count, score and can each be drawn; an empty table gives no rows; without target texts the gains are those of counts of 0.
"""

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.common import bounded_batches, free_name
from groundcover.session import materialize

BUCKETS = 10_000
MAX_RUN = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
# How the order is cut for sorting; no rank depends on it.
SEGMENT_ROWS = 20_000
MOST_SEGMENTS = 10_000  # beyond SEGMENT_ROWS times this, segments grow with the table
SAMPLES_PER_SEGMENT = 64

LONG_BYTES, LONG_WORDS = 1 << 20, 100_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(data: bytes) -> Iterator[list[bytes]]:
    """All words, of a very long text in lists of LONG_WORDS."""
    if len(data) < LONG_BYTES:
        yield WORD.findall(data)
        return
    found = (m.group() for m in WORD.finditer(data))
    while line := list(islice(found, LONG_WORDS)):
        yield line


def word_buckets(text: str | None, max_run: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, bucket of every feature) of a text, list by list; runs go on from one list into the next."""
    # On UTF-8 bytes the pattern finds the same words: all bytes of other scripts belong to one.
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    carried: list[bytes] = []
    for words in _words(data):
        found = [zlib.crc32(w) for w in words]
        line = carried + words
        for n in range(2, max_run + 1):
            first = max(0, len(carried) - n + 1)
            found += [zlib.crc32(b" ".join(line[i : i + n])) for i in range(first, len(line) - n + 1)]
        carried = line[1 - max_run :] if max_run > 1 else []
        yield len(words), np.array(found, np.int64) % buckets


def bucket_counts(df: DataFrame, text: str, max_run: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: one array per task, added up by bucket."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for value in frame.iloc[:, 0]:
                for _, found in word_buckets(value, max_run, buckets):
                    total += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": filled, "n": total[filled]})

    bounded_batches(df.sparkSession)
    parts = df.select(text).mapInPandas(partial, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_source + size) / ((s + 1) * (all_target + size))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise from a hash of seed and key, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def score(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: str = SEED,
) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score."""
    array = gains(bucket_counts(docs, text, max_run, buckets), bucket_counts(target, target_text, max_run, buckets))

    @pandas_udf("struct<n_words: long, n_features: long, weight: long>")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            words = features = weight = 0
            for n, found in word_buckets(value, max_run, buckets):
                words, features, weight = words + n, features + len(found), weight + int(array[found].sum())
            rows.append((words, features, weight))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    weighed = docs.select(F.col(id_col), weigh(F.col(text)).alias("_w"))
    return weighed.select(
        id_col, "_w.n_words", "_w.n_features", "_w.weight", (F.col("_w.weight") + noise(F.col(id_col), seed)).alias("score")
    )


def sorted_runs(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows sorted within each task by falling key and rising id, with `run` and `place`, written to the shared folder."""
    runs = df.sortWithinPartitions(F.desc(key), F.asc_nulls_first(id_col))
    at = F.monotonically_increasing_id()  # the task's number, and from bit 33 down the row's place in it
    return materialize(runs.withColumn("run", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)), "runs")


def _sort_key(key: int, row_id: int | None, run: int, place: int) -> tuple:
    return -key, row_id is not None, row_id, run, place


def splitters(runs: DataFrame, key: str, id_col: str, rows: int, segment_rows: int) -> list[tuple]:
    """Keys that cut the full order into segments of about `segment_rows`, from regular samples of the sorted runs."""
    segment_rows = max(segment_rows, rows // MOST_SEGMENTS)
    if rows <= segment_rows:
        return []
    every = max(1, segment_rows // SAMPLES_PER_SEGMENT)
    picked = runs.where(F.col("place") % every == every // 2).select(key, id_col, "run", "place")
    samples = sorted(_sort_key(*r) for r in picked.collect())
    return samples[SAMPLES_PER_SEGMENT - 1 :: SAMPLES_PER_SEGMENT]


def in_segments(runs: DataFrame, key: str, id_col: str, cuts: list[tuple], into: str) -> DataFrame:
    """Adds the number of each row's segment: how many splitters are not after it."""
    if not cuts:
        return runs.withColumn(into, F.lit(0))
    keys = np.array([c[0] for c in cuts], np.int64)

    @pandas_udf("int")
    def segment(scores: pd.Series, known: pd.Series, ids: pd.Series, run: pd.Series, place: pd.Series) -> pd.Series:
        fallen = -scores.to_numpy()
        found = np.searchsorted(keys, fallen, "left")
        for i in np.flatnonzero(found != np.searchsorted(keys, fallen, "right")):  # rows with a splitter's score
            row_id = ids.iat[i] if known.iat[i] else None
            found[i] = bisect_right(cuts, _sort_key(-fallen[i], row_id, run.iat[i], place.iat[i]))
        return pd.Series(found)

    # Whole numbers with NULLs would reach pandas rounded, so NULL goes apart.
    filled = F.coalesce(id_col, F.lit("0").cast(runs.schema[id_col].dataType))
    return runs.withColumn(into, segment(key, F.col(id_col).isNotNull(), filled, "run", "place"))


def draw(scored: DataFrame, number: int, rows: int, key: str = "score", id_col: str = "doc_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`scored` with `rank`: 1, 2, 3 ... for the `number` highest keys of its `rows` rows (ties to the smaller id), NULL for the others."""
    columns = scored.columns
    if number <= 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    runs = sorted_runs(scored, key, id_col)
    into = free_name(runs, "segment")
    cuts = splitters(runs, key, id_col, rows, segment_rows)
    placed = materialize(in_segments(runs, key, id_col, cuts, into), "segments") if cuts else in_segments(runs, key, id_col, cuts, into)
    counts = {r[into]: r["count"] for r in placed.groupBy(into).count().collect()}
    before, offsets = 0, []
    for n in range(len(cuts) + 1):
        offsets.append(before)
        before += counts.get(n, 0)
    # Segments that begin after the last drawn row need no order.
    drawn = [(n, offset) for n, offset in enumerate(offsets) if offset < number]
    starts = F.broadcast(scored.sparkSession.createDataFrame(drawn, f"`{into}` int, `rank` long"))  # at most MOST_SEGMENTS + 1 rows
    inside = Window.partitionBy(into).orderBy(F.desc(key), F.asc_nulls_first(id_col), "run", "place")
    merged = placed.where(F.col(into) < len(drawn)).withColumn("place", F.row_number().over(inside)).join(starts, into)
    rank = F.col("rank") + F.col("place")
    ranked = merged.withColumn("rank", F.when(rank <= number, rank))
    rest = placed.where(F.col(into) >= len(drawn)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id",
    segment_rows: int = SEGMENT_ROWS, **options,
) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score, rank; `percent` of the rows with `least_words` are drawn."""
    scored = materialize(score(docs, target, id_col, **options), "scores")
    long_enough = F.col("n_words") >= least_words
    rows = scored.where(long_enough).count()
    drawn = draw(scored.where(long_enough), percent * rows // 100, rows, "score", id_col, segment_rows)
    return drawn.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
