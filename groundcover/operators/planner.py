"""Planner scenarios folded from append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover.plans.prefix import prefix_sums
from groundcover.plans.skew import skew_safe_join
from groundcover.plans.topk import top_k

# Input: scenario_id, event_id, ts, kind ('create', 'note', 'shortlist'), name,
# facility_id, note. (ts, event_id) orders the events.


def _problem() -> Column:
    """Why an event can't be applied; NULL if it can."""
    def within(name: str, most: int) -> Column:
        return F.coalesce(F.length(name).between(1, most), F.lit(False))

    facility = F.coalesce(F.length("facility_id") >= 1, F.lit(False))
    kind = F.col("kind")
    return (
        F.when(~F.coalesce(kind.isin("create", "note", "shortlist"), F.lit(False)), "unknown kind")
        .when((kind == "create") & ~within("name", 120), "name length")
        .when((kind == "note") & ~within("note", 4000), "note length")
        .when((kind != "create") & ~facility, "no facility")
    )


def valid_events(events: DataFrame) -> DataFrame:
    """Events with a name of 1..120 or a note of 1..4000 characters and a facility.

    All others are in `rejected_events`.
    """
    return events.where(_problem().isNull())


def rejected_events(events: DataFrame) -> DataFrame:
    """Events that are not applied, with `problem`: unknown kind, name length, note length or no facility."""
    return events.withColumn("problem", _problem()).where(F.col("problem").isNotNull())


def _applied(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenarios, and the note and shortlist events that came after their creation."""
    valid = valid_events(events)
    created = top_k(
        valid.where(F.col("kind") == "create"), ["scenario_id"], [F.col("ts"), F.col("event_id")]
    ).select(
        "scenario_id",
        "name",
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("created_by"),
    )
    later = skew_safe_join(
        valid.where(F.col("kind") != "create").drop("name"), created, ["scenario_id"], "inner"
    )
    after = (F.col("ts") > F.col("created_at")) | (
        (F.col("ts") == F.col("created_at")) & (F.col("event_id") > F.col("created_by"))
    )
    return created, later.where(after)


def scenario_list(events: DataFrame) -> DataFrame:
    """One row per scenario, last touched first. Repeats also count as a touch."""
    created, applied = _applied(events)
    touched = applied.groupBy("scenario_id").agg(
        F.max("ts").alias("touched_at"),
        F.count_if(F.col("kind") == "note").alias("notes"),
        F.countDistinct(F.when(F.col("kind") == "shortlist", F.col("facility_id"))).alias("shortlisted"),
    )
    return (
        created.join(touched, "scenario_id", "left")
        .select(
            "scenario_id",
            "name",
            "created_at",
            F.greatest("created_at", "touched_at").alias("updated_at"),
            F.coalesce("notes", F.lit(0)).alias("notes"),
            F.coalesce("shortlisted", F.lit(0)).alias("shortlisted"),
        )
        .orderBy(F.desc("updated_at"), F.asc("scenario_id"))
    )


def scenario_items(events: DataFrame) -> DataFrame:
    """Shortlist and note rows in order: (scenario_id, section, pos, facility_id, note, ts).

    The first insert of a facility decides its place. Positions come from running
    counts over slices of the event order, so a scenario of any size is spread out;
    its items stay rows instead of one growing array.
    """
    _, applied = _applied(events)
    shortlist = (
        applied.where(F.col("kind") == "shortlist")
        .groupBy("scenario_id", "facility_id")
        .agg(F.min(F.struct("ts", "event_id")).alias("_first"))
        .select(
            "scenario_id",
            F.lit("shortlist").alias("section"),
            "facility_id",
            F.lit(None).cast("string").alias("note"),
            F.col("_first.ts").alias("ts"),
            F.col("_first.event_id").alias("event_id"),
        )
    )
    notes = applied.where(F.col("kind") == "note").select(
        "scenario_id", F.lit("note").alias("section"), "facility_id", "note", "ts", "event_id"
    )
    items = shortlist.unionByName(notes).withColumn("_one", F.lit(1))
    placed = prefix_sums(items, ["ts", "event_id"], "_one", ["scenario_id", "section"], out="pos")
    return placed.select("scenario_id", "section", "pos", "facility_id", "note", "ts")


def scenario_record(events: DataFrame, scenario_id: str) -> DataFrame:
    """One scenario as the planner opens it: its header on each of its ordered items.

    An empty scenario is one row without an item.
    """
    mine = events.where(F.col("scenario_id") == scenario_id)
    header = scenario_list(mine).select("scenario_id", "name", "created_at", "updated_at")
    return header.join(scenario_items(mine), "scenario_id", "left").orderBy("section", "pos")
