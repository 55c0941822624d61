"""Numbered pointer files that say which folders make up a table.

Data is written to folders of its own, and a small numbered file then names them. Readers take the highest number, so
they always find a whole table: the one before or the one after a change, never none and never a part.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from groundcover.session import remove

KEPT = 2  # the current version and the one that readers may still be reading


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    place, files = _files(spark, f"{root}/_pointers")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def read_pointer(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The highest number and what it says; (-1, {}) for a new table."""
    numbers = _numbers(spark, root)
    if not numbers:
        return -1, {}
    text = spark.read.text(f"{root}/_pointers/{numbers[-1]:012d}.json", wholetext=True).first()[0]
    return numbers[-1], json.loads(text)


def write_pointer(spark: SparkSession, root: str, number: int, value: dict) -> None:
    """Makes `value` the current one. Fails if another writer took the number, so that no change is lost."""
    draft, files = _files(spark, f"{root}/_pointers/.{uuid.uuid4().hex}")
    target, _ = _files(spark, f"{root}/_pointers/{number:012d}.json")
    out = files.create(draft)
    out.write(json.dumps(value).encode())
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"{root} was changed by another writer")


def publish_version(df: DataFrame, root: str, kept: int = KEPT) -> DataFrame:
    """Writes the rows as the next version of the table at `root` and returns it; columns may change, and rows may come from `root`.

    The last `kept` versions stay, for readers that have begun.
    """
    spark = df.sparkSession
    number, _ = read_pointer(spark, root)
    folder = f"v{number + 1}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{root}/{folder}")
        write_pointer(spark, root, number + 1, {"folder": folder, "schema": df.schema.json()})
    except Exception:
        remove(spark, f"{root}/{folder}")
        raise
    for old in _numbers(spark, root)[:-kept]:
        named = json.loads(spark.read.text(f"{root}/_pointers/{old:012d}.json", wholetext=True).first()[0])
        remove(spark, f"{root}/{named['folder']}")
        remove(spark, f"{root}/_pointers/{old:012d}.json")
    return read_version(spark, root)


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The current version."""
    number, value = read_pointer(spark, root)
    if number < 0:
        raise FileNotFoundError(f"nothing was published at {root}")
    return spark.read.parquet(f"{root}/{value['folder']}")
