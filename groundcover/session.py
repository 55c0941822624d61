"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def get_session(app_name: str = "groundcover", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Only a local session may go without the setting; it then gets one temporary
    folder per application. On a cluster a machine-local folder would not be
    visible to the other executors, so a missing setting is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="groundcover-")
    return _local_roots[context.applicationId]


_homes: dict[tuple[str, str], str] = {}
_written: dict[str, list[str]] = {}
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def _home(spark: SparkSession) -> str:
    """This application's folder in the shared one, deleted by Hadoop when the driver ends, after a failure too."""
    root, application = scratch_root(spark), spark.sparkContext.applicationId
    if (root, application) not in _homes:
        path = f"{root}/groundcover-{application}-{uuid.uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.mkdirs(place):
            raise OSError(f"cannot make {path}")
        files.deleteOnExit(place)
        _homes[root, application] = path
    return _homes[root, application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. `staging` removes it if it is asked for within one, else `cleanup`,
    at the latest the end of the application."""
    path = f"{_home(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    staged = _staged.get()
    if staged is not None:
        staged.append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written within are removed at the end, also after an error.

    Publish or collect what is to stay before the end: DataFrames that read the removed tables can't run any more.
    Within an inner `staging` the inner one owns the tables; other threads' tables are left to `cleanup`.
    """
    mine: list[str] = []
    token = _staged.set(mine)
    try:
        yield
    finally:
        _staged.reset(token)
        written = _written.get(spark.sparkContext.applicationId, [])
        for path in mine:
            remove(spark, path)
            if path in written:
                written.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cleanup(spark: SparkSession) -> int:
    """Deletes all scratch tables of this application; returns their number.

    Results built on them can't be read afterwards, so write or collect those first.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage and survives lost executors; later reads see the same rows
    and only the columns they ask for.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
