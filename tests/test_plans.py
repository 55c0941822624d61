"""Plan shapes against brute force, with hot keys."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundcover.plans.prefix import exact_quantiles, ordered_counts, prefix_sums
from groundcover.plans.skew import bucket_counts, hot_keys, skew_safe_join
from groundcover.plans.topk import top_k


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows on one key, a third without key, many exact copies."""
    random.seed(3)
    data = [("hot", i % 5) for i in range(1000)] + [(None, i % 5) for i in range(1000)]
    data += [(f"k{random.randrange(200)}", i % 5) for i in range(1000)]
    return spark.createDataFrame(data, "k string, v int").repartition(6)


KINDS = ["left", "inner", "left_semi", "left_anti"]


@pytest.mark.parametrize("how", KINDS)
@pytest.mark.parametrize("hot", [None, {("hot",): 4, (None,): 3}])
def test_skew_safe_join_equals_plain_join(spark, facts, rows, how, hot):
    dim = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"d{i}") for i in range(150)], "k string, d string")
    assert rows(skew_safe_join(facts, dim, ["k"], how, hot)) == rows(facts.join(dim, "k", how))


@pytest.mark.parametrize("how", KINDS)
@pytest.mark.parametrize(
    "left, right", [("bigint", "int"), ("decimal(10,2)", "decimal(12,4)"), ("date", "timestamp"), ("string collate utf8_lcase", "string collate utf8_lcase"), ("int", "string")]
)
def test_hot_keys_of_other_types_lose_nothing(spark, rows, how, left, right):
    value = "date_add(DATE'2024-01-01', CAST(id % 7 AS INT))" if left == "date" else "id % 7"
    key = f"CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN {value.replace('id % 7', '5')} ELSE {value} END"
    fact = spark.range(3000).selectExpr(f"CAST({key} AS {left}) AS k", "id AS v")
    dim = spark.range(6).selectExpr(f"CAST({value} AS {right}) AS k", "id AS d")
    found = bucket_counts(hot_keys(fact, ["k"], hot_rows=100), ["k"], 300)
    assert len(found) >= 2 and (None,) in found
    assert rows(skew_safe_join(fact, dim, ["k"], how, found), "v") == rows(fact.join(dim, "k", how), "v")


def test_building_a_join_starts_no_job(spark, facts):
    dim = spark.createDataFrame([("hot", "H")], "k string, d string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    skew_safe_join(facts, dim, ["k"])
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = skew_safe_join(facts, dim, ["k"], hot={("hot",): 4})._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_top_k_with_and_without_slices(facts, rows):
    order = [F.col("v").desc(), F.col("n")]
    df = facts.groupBy("k", "v").agg(F.count("*").alias("n"))
    small = rows(top_k(df, ["k"], order, 2))
    assert len([r for r in small if r[0] == "hot"]) == 2
    wide = top_k(facts, ["k"], [F.col("v").desc()], 1500)
    assert wide.count() == 3000  # no key has more rows than k


def test_prefix_sums_match_pandas(spark):
    random.seed(5)
    data = [("a" if i % 3 else None, i, random.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o int, w int")
    got = prefix_sums(df, ["o"], "w", ["g"]).toPandas().sort_values("o")
    pdf = pd.DataFrame(data, columns=["g", "o", "w"]).fillna("~").sort_values("o")
    expected = pdf.groupby("g")["w"].cumsum() - pdf["w"]
    assert got["before"].tolist() == expected.tolist()
    assert got["total"].tolist() == pdf.groupby("g")["w"].transform("sum").tolist()


def test_ordered_counts_give_average_ranks(spark):
    random.seed(7)
    values = [random.choice([0.1, 0.2, 0.5, random.random()]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = ordered_counts(df, "v").toPandas().set_index("v")
    ranks = pd.Series(values).rank(pct=True)
    for value, rank in zip(values, ranks, strict=True):
        row = counts.loc[value]
        assert abs((row["before"] + (row["ties"] + 1) / 2) / row["total"] - rank) < 1e-12


@pytest.mark.parametrize("size", [1, 2, 3, 10, 101])
def test_exact_quantiles_match_pandas(spark, size):
    random.seed(size)
    data = [(g, random.choice([1.0, 2.0, random.random() * 9])) for g in ("x", "y") for _ in range(size)]
    df = spark.createDataFrame(data, "g string, v double")
    pdf = pd.DataFrame(data, columns=["g", "v"])
    for q, value in exact_quantiles(df, "v", (0.4, 0.7, 0.9)).collect():
        assert abs(value - pdf["v"].quantile(q)) < 1e-9
    for g, q, value in exact_quantiles(df, "v", (0.0, 0.5, 1.0), ["g"]).collect():
        assert abs(value - pdf[pdf.g == g]["v"].quantile(q)) < 1e-9
