"""From matches to banded, guarded and capped trust scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config
from groundcover.plans.prefix import exact_quantiles, ordered_counts
from groundcover.plans.skew import skew_safe_join
from groundcover.plans.topk import top_k
from groundcover.session import materialize


def weighted_score(
    df: DataFrame,
    weights: Mapping[str, float] = config.FIELD_WEIGHTS,
    field: str = "field_source",
    score: str = "score",
) -> DataFrame:
    """Adds `weighted_score`. A field without a weight stops the job and is named."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = F.try_element_at(table, F.coalesce(F.col(field), F.lit("")))
    problem = F.concat(F.lit("no weight for field_source: "), F.coalesce(F.col(field), F.lit("NULL")))
    known = F.when(weight.isNull(), F.raise_error(problem).cast("double")).otherwise(weight)
    return df.withColumn("weighted_score", F.col(score) * known)


def best_match(
    df: DataFrame,
    keys: Sequence[str] = ("unique_id", "capability"),
    tie_break: Sequence[str] = ("span_id",),
) -> DataFrame:
    """Best evidence row per (facility, capability), whole row kept."""
    order = [F.col("weighted_score").desc(), F.col("score").desc(), *[F.col(c) for c in tie_break]]
    return top_k(df, keys, order)


def thresholds(
    df: DataFrame,
    col: str = "weighted_score",
    quantiles: Sequence[float] = config.STATUS_QUANTILES,
    exact: bool = True,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(q, quantile): exact with linear interpolation, or a sketch with `exact=False`."""
    if exact:
        return exact_quantiles(df, col, quantiles, counts=counts)
    sketch = df.agg(F.percentile_approx(col, [float(q) for q in quantiles], 100_000).alias("_v"))
    return sketch.select(F.posexplode("_v").alias("_i", "quantile")).select(
        F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("_i") + 1).alias("q"),
        F.col("quantile").cast("double").alias("quantile"),
    )


def band(score: Column, low: Column, medium: Column, high: Column) -> Column:
    return (
        F.when(score >= high, "verified")
        .when(score >= medium, "likely")
        .when(score >= low, "weak_signal")
        .otherwise("no_signal")
    )


def classify(df: DataFrame, cuts: DataFrame, col: str = "weighted_score") -> DataFrame:
    """Adds `evidence_status` from three cuts (q, quantile), each inclusive."""
    row = cuts.agg(F.array_sort(F.collect_list("quantile")).alias("cuts"))  # three numbers
    cut = row.scalar()
    return df.withColumn("evidence_status", band(F.col(col), cut[0], cut[1], cut[2]))


def keyword_confirmed(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]] = config.CAPABILITY_KEYWORDS,
    capability: str = "capability",
    text: str = "text_span",
) -> DataFrame:
    """Adds `keyword_confirmed`: the text contains a keyword of its capability.

    Keywords match inside words. A capability without keywords stops the job.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    verdict = F.raise_error(
        F.concat(F.lit("no keywords for capability: "), F.coalesce(F.col(capability), F.lit("NULL")))
    ).cast("boolean")
    for name, words in keywords.items():
        found = F.lit(False)
        for word in words:
            found = found | lowered.contains(word.lower())
        verdict = F.when(F.col(capability) == name, found).otherwise(verdict)
    return df.withColumn("keyword_confirmed", verdict)


def apply_keyword_guard(df: DataFrame, status: str = "evidence_status") -> DataFrame:
    """Unconfirmed likely and weak rows go down one step; the others stay."""
    unconfirmed = ~F.col("keyword_confirmed")
    return df.withColumn(
        status,
        F.when((F.col(status) == "likely") & unconfirmed, "weak_signal")
        .when((F.col(status) == "weak_signal") & unconfirmed, "no_signal")
        .otherwise(F.col(status)),
    )


def pct_rank_avg(
    df: DataFrame,
    col: str = "weighted_score",
    out: str = "percentile_rank",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Percentile rank 0..100 over all rows; equal values share their average rank.

    Ranks are worked out once per distinct value from range-partitioned running counts
    and joined back, so no task ever sees all rows. NULL values get no rank.
    """
    counts = ordered_counts(df, col) if counts is None else counts
    ranks = counts.select(
        col,
        ((F.col("before") + (F.col("ties") + 1) / 2) / F.col("total") * 100).alias(out),
    )
    return skew_safe_join(df, ranks, [col])


def trust_score(
    df: DataFrame, priors: DataFrame, caps: Mapping[str, int] = config.STATUS_CAPS
) -> DataFrame:
    """Adds richness_prior, trust_score_pct, trust_score and the disclaimer.

    Three quarters percentile rank, one quarter prior (unknown prior counts 0), rounded
    half to even, held to 0..100 and then to the cap of the status after the guard.
    `df` has one row per facility and capability, so the join key is never hot.
    """
    joined = df.join(priors.select("unique_id", "richness_prior"), "unique_id", "left")
    raw = F.col("percentile_rank") * 0.75 + F.coalesce(F.col("richness_prior"), F.lit(0.0)) * 25
    pct = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(raw).cast("int")))
    cap = F.lit(100)
    for status, limit in caps.items():
        cap = F.when(F.col("evidence_status") == status, limit).otherwise(cap)
    return joined.withColumn("trust_score_pct", F.least(pct, cap)).withColumns(
        {
            "trust_score": F.col("trust_score_pct").cast("double") / F.lit(100.0),
            "confirm_message": F.lit(config.CONFIRM_MESSAGE),
        }
    )


EVIDENCE_COLUMNS = [
    "unique_id", "capability", "evidence_status", "keyword_confirmed", "trust_score",
    "trust_score_pct", "field_source", "text_span", "score", "richness_prior", "confirm_message",
]


def capability_evidence(matches: DataFrame, facilities: DataFrame, exact: bool = True) -> DataFrame:
    """Matches to the evidence table: weight, best row, bands, guard, rank, score.

    The cuts and the ranks come from one ordering of the scores.
    """
    best = materialize(best_match(weighted_score(matches)), "best")  # read more than once below
    counts = ordered_counts(best, "weighted_score")
    banded = classify(best, thresholds(best, exact=exact, counts=counts))
    guarded = apply_keyword_guard(keyword_confirmed(banded))
    return trust_score(pct_rank_avg(guarded, counts=counts), facilities).select(*EVIDENCE_COLUMNS)
