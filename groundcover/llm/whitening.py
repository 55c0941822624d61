"""Whitening of embeddings: exact integer moments, and principal components by contour integration.

Every entry c becomes the whole number x = floor(1024 c) + 100000. Three passes over the vectors, each with one small partial
result per task that Spark adds up: sums (exact, as high and low halves), the covariance of x - mean, and the covariance of
the whitened vectors, whose distance from the identity is reported. The components come from the covariance alone, a matrix
with as many rows as a vector has entries (`feast.largest_pairs`); it and the sums are all that reaches the driver.

Defined cases: vectors that are NULL, empty or hold NULL or non-finite entries take no part, and neither do vectors of another length
than the most frequent one (of equally frequent ones the longest). Repeated rows all count, and rows with a NULL id too. Entries beyond
2**62 / 1024 count as that. A component without variance (as with fewer vectors than components) has `explained` 0 or
rounding noise and NULL for `whitened`, and `identity_error` is that of the others. A table without vectors gives no rows.
"""

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundcover.llm import feast
from groundcover.llm.common import free_name

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**62
COMPONENTS = 8
FLAT = 1e-13  # a component's variance is none below this share of the largest
LOW_BITS = 31
ADDED_AT_ONCE = 64  # partial results that one task adds up


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """x of every entry, one row per vector."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(entries * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def complete(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return df.where(F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(F.col(vector).cast("array<double>"), finite))


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Complete rows of the most frequent vector length, and that length (0 without rows)."""
    full = complete(df, vector)
    sizes = full.groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("dim")).first()
    dim = first["dim"] if first else 0
    return full.where(F.size(vector) == dim), dim


def exact_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of x in each dimension; `vectors` has one column."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), dim)
            rows += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if rows:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dim), "rows": np.full(dim, rows), "high": high, "low": low})

    parts = vectors.mapInArrow(partial, "d long, rows long, high long, low long")
    sums = parts.groupBy("d").agg(F.sum("rows").alias("rows"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = sorted(sums.collect())
    return found[0]["rows"], [(r["high"] << LOW_BITS) + r["low"] for r in found]


def covariance(vectors: DataFrame, dim: int, rows: int, prepare: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Covariance (divisor `rows`) of the rows that `prepare` makes of each batch of x, `size` numbers each.

    `prepare` centres them; what rounding leaves of their mean is taken off at the end. Each task gives one matrix, added up row by
    row in two steps, so that no task reads the partial results of all tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            y = prepare(whole_numbers(batch.column(0), dim))
            seen += len(y)
            total += y.sum(axis=0)
            products += y.T @ y
        if seen:
            yield pa.RecordBatch.from_pydict({"d": np.arange(size + 1), "numbers": [*products.tolist(), total.tolist()]}, _PART)

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        numbers = np.array(parts["numbers"].to_pylist()).sum(axis=0)
        return pa.Table.from_pydict({"d": [key[0].as_py()], "numbers": [numbers.tolist()]}, _PART)

    schema = "d long, numbers array<double>"
    parts = vectors.mapInArrow(partial, schema)
    some = parts.groupBy("d", F.floor(F.spark_partition_id() / ADDED_AT_ONCE).alias("some")).applyInArrow(add, schema)
    found = sorted(some.groupBy("d").applyInArrow(add, schema).collect())
    mean = np.array(found[size]["numbers"]) / rows
    matrix = np.array([r["numbers"] for r in found[:size]]) / rows - np.outer(mean, mean)
    return (matrix + matrix.T) / 2


_PART = pa.schema([("d", pa.int64()), ("numbers", pa.list_(pa.float64()))])


def deviations(x: np.ndarray, rows: int, sums: list[int]) -> pa.Array:
    """Exact sum over the dimensions of (rows * x - sum)**2, NULL from 10**38 on."""
    kind = pa.decimal128(38, 0)
    if not len(x):
        return pa.array([], kind)
    largest = max(int(x.max()), -int(x.min()))
    if rows * largest + max(abs(s) for s in sums) < 2**63:
        apart = rows * x - np.array(sums, np.int64)
        reach = max(int(apart.max()), -int(apart.min()))
        if x.shape[1] * reach**2 < 2**63:
            return pa.array(np.einsum("ij,ij->i", apart, apart)).cast(kind)
        if reach < 2**50 and x.shape[1] <= 2**10:  # halves of 26 bits: three sums that fit, put together row by row
            high, low = apart >> 26, apart & ((1 << 26) - 1)
            squares = [np.einsum("ij,ij->i", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
            total = squares[0] * 2**52 + squares[1] * 2**27 + squares[2]
            return pa.array([Decimal(v) if v < 10**38 else None for v in total.tolist()], kind)
    apart = x.astype(object) * rows - np.array(sums, object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (apart * apart).sum(axis=1).tolist()], kind)


class Whitener:
    """Mean, components (columns) and variances, fitted on all complete vectors."""

    def __init__(self, df: DataFrame, vector: str, components: int):
        rows, self.dim = usable(df, vector)
        self.n, self.identity_error = 0, 0.0
        if not self.dim:
            return
        vectors = rows.select(vector)
        self.n, self.sums = exact_sums(vectors, self.dim)
        mean = self.mean = np.array([s / self.n for s in self.sums])  # true division of whole numbers: correctly rounded
        matrix = covariance(vectors, self.dim, self.n, lambda x: x - mean, self.dim)
        self.variances, self.axes = feast.largest_pairs(matrix, components)
        trace = float(np.trace(matrix))
        self.explained = (self.variances / trace if trace > 0 else np.zeros(len(self.variances))).tolist()
        self.varied = self.variances > FLAT * max(self.variances[0], trace * np.finfo(float).eps)
        if self.varied.any():
            project = self.project
            white = covariance(vectors, self.dim, self.n, lambda x: project(x)[:, self.varied], int(self.varied.sum()))
            self.identity_error = float(np.abs(white - np.eye(len(white))).max())

    def project(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.varied, self.variances, 1.0))
        return (x - self.mean) @ self.axes / scale


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per complete vector and component: id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is decimal(38,0): squares of n times a distance outgrow 64 bits on large tables.
    """
    fitted = Whitener(df.select(vector), vector, components)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, deviation decimal(38,0), numbers array<double>"
    empty = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not fitted.n:
        return df.sparkSession.createDataFrame([], empty)
    dim, n, sums, varied = fitted.dim, fitted.n, fitted.sums, fitted.varied
    project = fitted.project

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1), dim)
            numbers = np.where(varied, project(x), np.nan)
            flat = pa.array(numbers.ravel(), from_pandas=True)  # NaN becomes NULL
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(varied)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), deviations(x, n, sums), pa.ListArray.from_arrays(pa.array(ends), flat)],
                [id_col, "deviation", "numbers"],
            )

    picked = df.select(F.col(id_col), F.col(vector))
    rows = complete(picked, vector).where(F.size(vector) == dim).mapInArrow(apply, schema)
    at = free_name(rows, "at")
    placed = rows.select(id_col, "deviation", F.posexplode("numbers").alias(at, "whitened"))
    explained = F.array(*[F.lit(e) for e in fitted.explained])
    return placed.select(
        id_col, (F.col(at) + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col(at)].alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )
