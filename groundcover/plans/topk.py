"""Top-k per key with pruning before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundcover.plans.skew import row_spread

# Spark drops losing rows in the map tasks, so the last task sees about k rows per map
# task. Above this k that is cut down in parts first.
ONE_STEP_K = 100


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int = 1,
    rank: str | None = None,
    slices: int = 64,
) -> DataFrame:
    """The first `k` rows of every key; `order` must be a total order.

    For a larger k the rows of a key are first cut into `slices` parts that each
    keep their own k, so a hot key never reaches a single task whole.
    """
    # Sorting compares the first eight bytes before anything else: a hash of the key there
    # decides nearly every comparison, which text keys with a common start do not.
    df = df.withColumn("_key", F.xxhash64(*keys))
    if k > ONE_STEP_K:
        parts = df.withColumn("_part", row_spread(df, F.lit(slices)))
        by_part = Window.partitionBy("_key", *keys, "_part").orderBy(*order)
        df = (
            parts.withColumn("_rank", F.row_number().over(by_part))
            .where(F.col("_rank") <= k)
            .drop("_part", "_rank")
        )
    name = rank or "_rank"
    by_key = Window.partitionBy("_key", *keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(by_key)).where(F.col(name) <= k).drop("_key")
    return ranked if rank else ranked.drop(name)
