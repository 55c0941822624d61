"""Helpers shared by the operators of this subpackage."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundcover.sources.tables import load_table

BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of every document; other columns are never read."""
    return load_table(spark, folder, "documents").select("doc_id", "text")


def bounded_batches(spark: SparkSession) -> None:
    """Limits what one Arrow batch holds, so that very long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo `folds`; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % folds


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(text: str, size: int = 500_000) -> Iterator[str]:
    """A text in pieces of about `size` characters, cut before a blank or line end where there is one nearby."""
    start = 0
    while len(text) - start > size:
        found = [p for mark in (" ", "\n") if (p := text.find(mark, start + size, start + 2 * size)) >= 0]
        stop = min(found, default=start + size)
        yield text[start:stop]
        start = stop
    yield text[start:]
