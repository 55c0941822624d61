"""Row-level quality rules and the summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config

RULE_NAMES = list(config.RULES)
RULE_INPUTS = [
    "doctors_reported", "capacity_reported", "source_type_count", "affiliated_staff_presence",
    "custom_logo_presence", "number_of_facts_about_the_organization", "coordinates_valid",
    "district_resolved",
]


def rule_conditions(nulls: str = "strict") -> dict[str, Column]:
    """One condition per rule, in reporting order.

    `strict`: unknown values never trigger a rule. `as_false`: unknown flags count as
    no and unknown counts as 0, as on the detail page.
    """
    if nulls not in ("strict", "as_false"):
        raise ValueError(f"nulls must be 'strict' or 'as_false', not {nulls!r}")
    strict = nulls == "strict"

    def no(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(strict))

    def below(name: str, limit: int) -> Column:
        value = F.col(name) if strict else F.coalesce(F.col(name).try_cast("int"), F.lit(0))
        return F.coalesce(value < limit, F.lit(False))

    supported = F.col("evidence_status").isin(*config.SUPPORTED_STATUSES)
    verified = F.col("evidence_status") == "verified"
    conditions = [
        supported & no("doctors_reported") & no("capacity_reported"),
        F.col("capability").isin(*config.HIGH_ACUITY) & supported & below("source_type_count", 2),
        verified
        & no("affiliated_staff_presence")
        & no("custom_logo_presence")
        & below("number_of_facts_about_the_organization", 3),
        no("coordinates_valid"),
        no("district_resolved"),
    ]
    return {
        name: F.coalesce(condition, F.lit(False))
        for name, condition in zip(RULE_NAMES, conditions, strict=True)
    }


def run_rules(df: DataFrame, nulls: str = "strict") -> DataFrame:
    """Adds `validator_flags`: {rule, reason} of every triggered rule, in order."""
    flags = [
        F.when(condition, F.struct(F.lit(name).alias("rule"), F.lit(config.RULES[name]).alias("reason")))
        for name, condition in rule_conditions(nulls).items()
    ]
    return df.withColumn("validator_flags", F.filter(F.array(*flags), lambda f: f.isNotNull()))


def _audited(evidence: DataFrame, facilities: DataFrame) -> DataFrame:
    """Distinct rule inputs with their number of evidence rows (`n`), facility attached.

    Evidence is counted per facility and status first: a facility with very many
    evidence rows shrinks to a few rows before the join.
    """
    keys = ["unique_id", "capability", "evidence_status", "keyword_confirmed"]
    counted = evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(facilities.select("unique_id", *RULE_INPUTS), "unique_id", "left")


def rule_rates(evidence: DataFrame, facilities: DataFrame, nulls: str = "strict") -> DataFrame:
    """(rule, flagged_rows, total_rows, rate_pct), rules without hits included."""
    conditions = rule_conditions(nulls)
    sums = _audited(evidence, facilities).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        *[
            F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
            for name, c in conditions.items()
        ],
    )
    listed = sums.select(
        "total_rows",
        F.posexplode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("flagged_rows")) for n in conditions])
        ).alias("rule_order", "_r"),
    )
    return listed.select(
        "rule_order",
        "_r.rule",
        "_r.flagged_rows",
        "total_rows",
        F.coalesce(F.round(F.try_divide(F.col("_r.flagged_rows") * 100.0, "total_rows"), 2), F.lit(0.0)).alias(
            "rate_pct"
        ),
    )


def validation_summary(evidence: DataFrame, facilities: DataFrame, nulls: str = "strict") -> DataFrame:
    """One row: totals, keyword-confirmation rate and flag rates (one decimal, half even).

    Evidence without a facility stays in the denominators.
    """
    conditions = rule_conditions(nulls)
    moderate = F.lower("evidence_status").isin("likely", "weak_signal")
    any_rule = F.lit(False)
    for condition in conditions.values():
        any_rule = any_rule | condition

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))

    def rate(part: str, whole: str) -> Column:
        share = F.try_divide(F.col(part), F.col(whole)) * 100
        return F.coalesce(F.bround(share, 1), F.lit(0.0))

    sums = _audited(evidence, facilities).agg(
        total(F.lit(True)).alias("total_rows"),
        total(moderate).alias("eligible"),
        total(moderate & F.coalesce(F.col("keyword_confirmed"), F.lit(False))).alias("confirmed"),
        total(any_rule).alias("validator_flagged_rows"),
        *[total(c).alias(name) for name, c in conditions.items()],
    )
    return sums.select(
        "total_rows",
        F.struct(
            F.col("eligible").alias("eligible_rows"),
            F.col("confirmed").alias("confirmed_rows"),
            rate("confirmed", "eligible").alias("rate_pct"),
        ).alias("keyword_confirmation"),
        "validator_flagged_rows",
        rate("validator_flagged_rows", "total_rows").alias("validator_flag_rate_pct"),
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.col(name).alias("flagged_rows"),
                    rate(name, "total_rows").alias("rate_pct"),
                )
                for name in conditions
            ]
        ).alias("validator_rules"),
    )
