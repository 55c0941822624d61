"""Evidence spans from list fields and free text, and their embeddings."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import md5
from queue import Empty, SimpleQueue
from threading import Thread

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from groundcover import config

LIST_FIELDS = ("capability", "procedure", "equipment")
SPAN_COLUMNS = ["span_id", "unique_id", "field_source", "text_span"]

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def truncate_span(text: Column, max_chars: int | None = None) -> Column:
    """The first `max_chars` characters (not bytes); None keeps the whole text."""
    return text if max_chars is None else F.substring(text, 1, max_chars)


def _chunks(items: Column, chunk: int | None) -> Column:
    """Array of (index, text): one entry for the whole list or one per `chunk` items."""
    if chunk is None:
        whole = F.struct(F.lit(None).cast("int").alias("part"), F.array_join(items, ". ").alias("text"))
        return F.array(whole)
    last = (F.ceil(F.size(items) / F.lit(chunk)) - 1).cast("int")
    return F.when(
        F.size(items) > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("part"),
                F.array_join(F.slice(items, i * chunk + 1, F.lit(chunk)), ". ").alias("text"),
            ),
        ),
    )


def build_spans(
    df: DataFrame,
    key: str = "unique_id",
    list_fields: Sequence[str] = LIST_FIELDS,
    text_field: str | None = "description",
    chunk: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """(span_id, unique_id, field_source, text_span) from one scan of the facts.

    `chunk=None` gives one span per record and field, else one per `chunk` list items,
    numbered from 0. NULL items take a place in a chunk but no text; blank spans are
    dropped. Spans are whole unless `max_chars` cuts them. All fields are laid out side by side and exploded together, so the table is
    not read once per field.
    """
    kind = T.ArrayType(
        T.StructType(
            [
                T.StructField("field", T.StringType()),
                T.StructField("part", T.IntegerType()),
                T.StructField("text", T.StringType()),
            ]
        )
    )

    def from_list(field: str) -> Column:
        items = F.coalesce(F.col(field), F.array().cast("array<string>"))
        parts = _chunks(items, chunk)
        return F.transform(parts, lambda c: F.struct(F.lit(field).alias("field"), c["part"], c["text"]))

    per_field = [from_list(field).cast(kind) for field in list_fields]
    if text_field:
        per_field.append(
            F.array(
                F.struct(
                    F.lit(text_field).alias("field"),
                    F.lit(None).cast("int").alias("part"),
                    F.col(text_field).alias("text"),
                )
            ).cast(kind)
        )
    laid_out = [F.coalesce(p, F.array().cast(kind)) for p in per_field]
    spans = df.select(F.col(key).alias("unique_id"), F.inline(F.concat(*laid_out)))
    return spans.where(F.length(F.trim("text")) > 0).select(
        F.concat_ws("_", "unique_id", "field", F.col("part").cast("string")).alias("span_id"),
        "unique_id",
        F.col("field").alias("field_source"),
        truncate_span(F.col("text"), max_chars).alias("text_span"),
    )


def spans_simple(df: DataFrame, **options) -> DataFrame:
    return build_spans(df, chunk=None, **options)


def spans_chunked(df: DataFrame, chunk: int = config.CHUNK_ITEMS, **options) -> DataFrame:
    return build_spans(df, chunk=chunk, **options)


GRANULARITIES = {"simple": spans_simple, "chunked": spans_chunked}


def spans_by(df: DataFrame, granularity: str, **options) -> DataFrame:
    """Spans of the named granularity: `simple` or `chunked`."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    return GRANULARITIES[granularity](df, **options)


@lru_cache(maxsize=500_000)
def _place(word: str, dim: int) -> int:
    return int.from_bytes(md5(word.encode()).digest()[:4], "big") % dim


def hashed_words(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Deterministic stand-in for a model: unit-length hashed word counts.

    Words are split at blanks, tabs and line ends; the place of a word follows from its md5.
    """
    words = [[w for w in _BLANKS.split(text.lower()) if w] for text in texts]
    places = np.fromiter((_place(w, dim) for line in words for w in line), np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(line) for line in words])
    out = np.bincount(rows * dim + places, minlength=len(texts) * dim).reshape(len(texts), dim).astype("float64")
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out / np.where(length == 0, 1.0, length)).tolist()


_BLANKS = re.compile(r"[ \t\r\n]+")


def _attempt(embedder: Embedder, chunks: list[list[str]], workers: int, limit: float) -> list[list | None]:
    """The vectors of each chunk, None for one that failed, gave another number of vectors or took longer than `limit` seconds.

    Up to `workers` calls run at a time. A call that hangs can't be stopped, but it is left behind on its own thread (which
    doesn't keep the process alive) and its place goes to the next chunk.
    """
    done: SimpleQueue = SimpleQueue()
    results: list[list | None] = [None] * len(chunks)
    waiting, running = deque(range(len(chunks))), {}

    def call(i: int) -> None:
        try:
            vectors = list(embedder(chunks[i]))
            done.put((i, vectors if len(vectors) == len(chunks[i]) else None))
        except Exception:  # noqa: BLE001 - any failure of the callable is tried again
            done.put((i, None))

    while waiting or running:
        while waiting and len(running) < workers:
            i = waiting.popleft()
            running[i] = time.monotonic() + limit
            Thread(target=call, args=(i,), daemon=True).start()
        try:
            i, vectors = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
        except Empty:
            now = time.monotonic()
            running = {i: end for i, end in running.items() if end > now}
            continue
        if running.pop(i, None) is not None:  # else its time was over
            results[i] = vectors
    return results


def embed_texts(
    texts: list[str],
    embedder: Embedder,
    batch: int = config.EMBED_BATCH,
    workers: int = config.EMBED_WORKERS,
    limit: float = config.EMBED_SECONDS,
    patience: float = config.EMBED_RETRY_SECONDS,
    retry_wait: float = 0.0,
) -> list:
    """One vector per text, None where the embedder gives none.

    Small batches side by side first, each within `limit` seconds; those that failed once more, one after another after
    `retry_wait` and within `patience` seconds; then text by text, so that a text the embedder fails or hangs on costs only itself.
    """
    chunks = [texts[i : i + batch] for i in range(0, len(texts), batch)]
    found = _attempt(embedder, chunks, workers, limit)
    if retry_wait and None in found:
        time.sleep(retry_wait)
    for i, chunk in enumerate(chunks):
        if found[i] is None:
            found[i] = _attempt(embedder, [chunk], 1, patience)[0]
        if found[i] is None:
            alone = _attempt(embedder, [[one] for one in chunk], 1, limit)
            found[i] = [vectors[0] if vectors else None for vectors in alone]
    return [vector for vectors in found for vector in vectors]


def embed_spans(spans: DataFrame, embedder: Embedder = hashed_words, text: str = "text_span", **calls) -> DataFrame:
    """Adds `embedding` and `embedding_failed`; `calls` are the options of `embed_texts`.

    Only the text goes to Python. A text that fails all attempts keeps a NULL vector and the flag, so it can never be searched by
    accident; a NULL text isn't sent and counts as failed.
    """

    @pandas_udf("struct<embedding: array<float>, embedding_failed: boolean>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            vectors = np.full(len(series), None, object)
            sent = np.flatnonzero(series.notna())
            for i, vector in zip(sent, embed_texts(series.iloc[sent].tolist(), embedder, **calls)):
                vectors[i] = vector
            yield pd.DataFrame({"embedding": vectors, "embedding_failed": [v is None for v in vectors]})

    # Not deterministic: neither repeated by the optimizer, as for a filter on the flag, nor moved.
    found = spans.withColumn("_embedded", embed.asNondeterministic()(text))
    return found.select(*spans.columns, "_embedded.embedding", "_embedded.embedding_failed")


__all__ = [
    "GRANULARITIES", "SPAN_COLUMNS", "build_spans", "embed_spans", "embed_texts", "hashed_words",
    "spans_by", "spans_chunked", "spans_simple", "truncate_span",
]
