"""Exact vector top-k for a small set of queries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundcover.plans.topk import top_k

METRICS = ("dot", "cosine", "l2_sim")


def vector_topk(
    spans: DataFrame,
    queries: Mapping[str, Sequence[float]],
    k: int | None,
    metric: str = "cosine",
    key: str = "span_id",
    vector: str = "embedding",
    query: str = "capability",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The `k` best spans per query: (query, key, the `carry` columns, score, rank); equal scores by key.

    Each task multiplies Arrow batches with the few query vectors, decides equal scores by
    key like the final ranking, and passes on its own best `k` per query once, at its end. Only
    keys, scores and `carry` are shuffled. `k=None` scores every span and ranks none (no `rank` column).
    NULL vectors are not searched.
    Metrics: dot, cosine, l2_sim = 1 / (1 + squared distance).
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    names = list(queries)
    if not names:
        raise ValueError("vector_topk needs at least one query vector")
    wanted = np.asarray([queries[n] for n in names], dtype="float64")
    kept = [key, *carry]
    schema = T.StructType(
        [
            T.StructField(query, T.StringType()),
            *[T.StructField(c, spans.schema[c].dataType) for c in kept],
            T.StructField("score", T.DoubleType()),
        ]
    )

    def values_of(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        # One row at a time in a fixed order: a vector scores the same in any batch.
        if metric == "l2_sim":
            return 1.0 / (1.0 + ((rows - target) ** 2).sum(axis=1))
        values = (rows * target).sum(axis=1)
        if metric == "cosine":
            norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((target * target).sum())
            values = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)
        return values

    def table(i: int, rows: pa.Table, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        named = pa.array([names[i]] * len(values), pa.string())
        yield from pa.table([named, *rows.columns, pa.array(values)], [query, *kept, "score"]).to_batches()

    def best_of(rows: pa.Table, values: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        order = pc.sort_indices(
            pa.table({"key": rows[key], "score": values}), sort_keys=[("score", "descending"), ("key", "ascending")]
        )[:k]
        return rows.take(order), values[order.to_numpy()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[pa.Table, np.ndarray] | None] = [None] * len(names)
        for batch in batches:
            vectors = batch.column(0)
            if len(vectors) == 0:
                continue
            numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
            numbers = numbers.reshape(len(vectors), wanted.shape[1])
            whole = pa.table(batch.columns[1:], kept)
            for i, target in enumerate(wanted):
                rows, values = whole, values_of(numbers, target)
                if k is None:
                    yield from table(i, rows, values)
                    continue
                if best[i] is not None:
                    if len(best[i][1]) == k:
                        # Rows under the last one kept can't enter; equal ones are settled by key.
                        near = values >= best[i][1][-1]
                        rows, values = rows.filter(pa.array(near)), values[near]
                    rows = pa.concat_tables([best[i][0], rows])
                    values = np.concatenate([best[i][1], values])
                best[i] = best_of(rows, values)
        for i, found in enumerate(best):
            if found is not None and len(found[1]):
                yield from table(i, *found)

    searched = spans.where(F.col(vector).isNotNull()).select(vector, *kept)
    scored = searched.mapInArrow(score, schema)
    if k is None:
        return scored
    return top_k(scored, [query], [F.col("score").desc(), F.col(key).asc()], k, rank="rank")


def attach_spans(matches: DataFrame, spans: DataFrame, key: str = "span_id") -> DataFrame:
    """Span columns for the retrieved rows; `spans` is a written table, unique on the key.

    Columns of the searched rows themselves come along with `carry` of `vector_topk`, without any join; this is for others. The matched keys go to the spans first: a semi-join that Spark broadcasts while they are few,
    so texts that nobody asked for are not shuffled.
    """
    wanted = spans.join(matches.select(key).distinct(), key, "left_semi")
    return matches.join(wanted, key, "inner")
