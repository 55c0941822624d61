"""The planner fold kept up to date by a stream.

Scenarios are dealt to a fixed number of buckets. A micro-batch reads the stored events of the buckets it
touches, adds its own, folds the scenarios it changes and writes these buckets anew; a numbered pointer then names, for every bucket,
the folder that holds it. Reading takes no de-duplication and no folding, and reading one scenario opens one bucket.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundcover.operators.planner import rejected_events, scenario_items, scenario_list, valid_events
from groundcover.plans.topk import top_k
from groundcover.sources.versions import read_pointer, write_pointer

BUCKETS = 16  # more for many scenarios: a batch rewrites the buckets it touches


def append_events(stream: DataFrame, log_path: str, checkpoint: str, buckets: int = BUCKETS):
    """Streams planner events into the table at `log_path`; returns the finished query.

    Events may come late, in any order and more than once: the table is always what folding all of them at once gives. The pointer
    remembers the last batch of each checkpoint, so a batch that is replayed after a failure changes nothing if it got through, and is
    applied whole if it didn't. Events that can't be applied go to `rejected`. `buckets` counts for a new table.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        apply_events(batch, batch_id, log_path, checkpoint, buckets)

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def apply_events(batch: DataFrame, batch_id: int, log_path: str, source: str, buckets: int = BUCKETS) -> bool:
    """Applies one batch of a source; False if that batch was applied before."""
    spark = batch.sparkSession
    number, table = read_pointer(spark, log_path)
    table = table or {"buckets": buckets, "folders": {}, "applied": {}, "schemas": {}}
    if table["applied"].get(source, -1) >= batch_id:
        return False
    name = f"{md5(source.encode()).hexdigest()[:8]}-{batch_id}"
    rejected_events(batch).write.mode("overwrite").parquet(f"{log_path}/rejected/batch={name}")
    folder = f"{name}-{uuid.uuid4().hex}"
    path = f"{log_path}/{folder}"
    fresh = valid_events(batch).withColumn("bucket", _bucket(F.col("scenario_id"), table["buckets"]))
    fresh.write.parquet(f"{path}/fresh")
    fresh = spark.read.schema(fresh.schema).parquet(f"{path}/fresh")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]

    # Deliveries of one event that differ: the first in the order of all columns stays.
    stored = _stored(spark, log_path, table, "events", touched, fresh.schema)
    order = [F.col(c).asc_nulls_last() for c in batch.columns]
    known = fresh if stored is None else stored.unionByName(fresh)
    _write(top_k(known, ["scenario_id", "event_id"], order), f"{path}/events")
    events = spark.read.schema(fresh.schema).parquet(f"{path}/events")

    changed = fresh.select("scenario_id").distinct()
    mine = events.drop("bucket")
    if stored is not None:
        mine = mine.join(changed, "scenario_id", "left_semi")
    for what, fold in (("items", scenario_items), ("scenarios", scenario_list)):
        folded = fold(mine).withColumn("bucket", _bucket(F.col("scenario_id"), table["buckets"]))
        before = _stored(spark, log_path, table, what, touched, folded.schema)
        same = None if before is None else before.join(changed, "scenario_id", "left_anti")
        _write(folded if same is None else folded.unionByName(same), f"{path}/{what}")
        table["schemas"][what] = json.loads(folded.schema.json())
    table["schemas"]["events"] = json.loads(fresh.schema.json())
    table["folders"] |= {str(b): folder for b in touched}
    table["applied"][source] = batch_id
    write_pointer(spark, log_path, number + 1, table)
    return True


def read_events(spark: SparkSession, log_path: str, scenario_id: str | None = None) -> DataFrame:
    """Stored events, each once even if the source delivered it twice."""
    return _read(spark, log_path, "events", scenario_id)


def read_items(spark: SparkSession, log_path: str, scenario_id: str | None = None) -> DataFrame:
    """`scenario_items` of all events so far, or of one scenario."""
    return _read(spark, log_path, "items", scenario_id)


def read_scenarios(spark: SparkSession, log_path: str, scenario_id: str | None = None) -> DataFrame:
    """`scenario_list` of all events so far, or of one scenario."""
    return _read(spark, log_path, "scenarios", scenario_id)


def _bucket(scenario: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(scenario), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str) -> None:
    # Few files per bucket, and a large bucket is still split over tasks.
    df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def _stored(spark: SparkSession, log_path: str, table: dict, what: str, buckets: list[int], schema: T.StructType) -> DataFrame | None:
    """The current rows of some buckets, None if there are none; each of the folders that hold them is read once."""
    of_folder: dict[str, list[int]] = {}
    for bucket in buckets:
        if folder := table["folders"].get(str(bucket)):
            of_folder.setdefault(folder, []).append(bucket)
    parts = [
        spark.read.schema(schema).parquet(f"{log_path}/{folder}/{what}").where(F.col("bucket").isin(held))
        for folder, held in of_folder.items()
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _read(spark: SparkSession, log_path: str, what: str, scenario_id: str | None) -> DataFrame:
    _, table = read_pointer(spark, log_path)
    if not table:
        raise FileNotFoundError(f"no events were stored at {log_path}")
    wanted = [int(b) for b in table["folders"]]
    if scenario_id is not None:
        wanted = [spark.range(1).select(_bucket(F.lit(scenario_id), table["buckets"])).first()[0]]
    schema = T.StructType.fromJson(table["schemas"][what])
    stored = _stored(spark, log_path, table, what, wanted, schema)
    rows = (spark.createDataFrame([], schema) if stored is None else stored).drop("bucket")
    return rows if scenario_id is None else rows.where(F.col("scenario_id") == scenario_id)


__all__ = ["append_events", "apply_events", "read_events", "read_items", "read_scenarios"]
