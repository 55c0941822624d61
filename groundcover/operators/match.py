"""Name reconciliation inside a block: alias, exact, then best similar name."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config
from groundcover.plans.topk import top_k
from groundcover.session import materialize

# Rare letters first: two similar names are looked up through their rarest letters.
LETTERS_BY_RARITY = "qxjzwfvkpycbmdguhtslrnoiea "
PAIR_COLUMNS = ["block", "name", "candidate", "bound"]


def best_by_ratio(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Best candidate per (block, name) by difflib similarity, the candidate first.

    The pairs of a name arrive together, most promising first by `bound`, the highest
    similarity their letters allow. Candidates that can no longer win are skipped, so only
    a few per name are compared in full. Nothing is held but the best pair so far.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = difflib.SequenceMatcher()
        current, best = None, None
        for frame in batches:
            done = []
            for block, name, candidate, bound in zip(*(frame[c] for c in PAIR_COLUMNS), strict=True):
                if (block, name) != current:
                    if best is not None:
                        done.append((*current, best[1]))
                    current, best = (block, name), None
                    matcher.set_seq2(name)
                if bound < (cutoff if best is None else best[0]):
                    continue
                matcher.set_seq1(candidate)
                score = (matcher.ratio(), candidate)
                if score[0] >= cutoff and (best is None or score > best):
                    best = score
            yield pd.DataFrame(done, columns=["block", "name", "candidate"])
        if best is not None:
            yield pd.DataFrame([(*current, best[1])], columns=["block", "name", "candidate"])

    ordered = pairs.sortWithinPartitions("block", "name", F.desc("bound"), F.desc("candidate"))
    return ordered.select(*PAIR_COLUMNS).mapInPandas(run, "block string, name string, candidate string")


def edit_ratio(candidate: Column, name: Column) -> Column:
    longest = F.greatest(F.length(candidate), F.length(name))
    return F.lit(1.0) - F.levenshtein(candidate, name) / longest


def _letters(name: Column) -> Column:
    """The letters of a name as sorted numbers, rarest first.

    A number holds rarity, code point and occurrence ('a' twice gives two numbers), so
    equal letters of two names are equal numbers.
    """
    chars = F.filter(F.split(name, ""), lambda c: c != "")

    def number(c: Column, i: Column) -> Column:
        rarity = F.call_function("instr", F.lit(LETTERS_BY_RARITY), c).cast("long")
        nth = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c))
        return rarity * F.lit(1 << 40) + F.ascii(c) * F.lit(1 << 16) + nth

    return F.sort_array(F.transform(chars, number))


def similar_pairs(
    left: DataFrame, right: DataFrame, cutoff: float, method: str
) -> DataFrame:
    """(block, name, candidate, bound) pairs that can reach `cutoff`, and few others.

    Both similarities need a minimum number of shared letters. If two names share
    at least `t` of their `n` letters they also share one of the first `n - t + 1`
    letters of each in any common order, so only those letters are join keys. The join itself
    lets a pair pass once, at the first letter that both have: there, only the letters after it can
    still be shared, which with the lengths rules out most pairs before letters are counted. No true
    match is lost. All pairs of a name end in one partition; `bound` is their highest possible ratio.
    """
    if method == "ratio":
        shortest = cutoff / (2 - cutoff)  # of the longer length
        shared = lambda a, b: F.ceil(F.lit(cutoff) * (a + b) / 2 - 1e-9)
    else:
        shortest = cutoff
        shared = lambda a, b: F.ceil(F.lit(cutoff) * F.greatest(a, b) - 1e-9)

    def keyed(df: DataFrame, name: str, prefix: str) -> DataFrame:
        size, letters = F.col(f"{prefix}_size"), F.col(f"{prefix}_letters")
        at_least = shared(size, F.ceil(size * F.lit(shortest) - 1e-9))
        keys = F.greatest(size - at_least + 1, F.lit(0)).cast("int")
        return (
            df.select(F.col("block").alias(f"{prefix}_block"), name, F.length(name).alias(f"{prefix}_size"))
            .withColumn(f"{prefix}_letters", _letters(F.col(name)))
            .select("*", F.posexplode(F.slice(letters, F.lit(1), keys)).alias(f"{prefix}_at", f"{prefix}_key"))
        )

    a = keyed(left, "name", "a")
    b = keyed(right, "candidate", "b")
    a_size, b_size = F.col("a_size"), F.col("b_size")
    wanted = shared(a_size, b_size)
    after = F.least(a_size - F.col("a_at"), b_size - F.col("b_at"))  # with the letter itself
    common = F.array_intersect("a_letters", "b_letters")
    pairs = a.join(
        b,
        (F.col("a_block") == F.col("b_block"))
        & (F.col("a_key") == F.col("b_key"))
        & (F.least(a_size, b_size) >= F.lit(shortest) * F.greatest(a_size, b_size) - 1e-9)
        & (after >= wanted)
        & (F.size(common) >= wanted)
        & (F.get(common, F.lit(0)) == F.col("a_key")),
    )
    return (
        pairs.withColumn("bound", F.lit(2.0) * F.size(common) / (a_size + b_size))
        .select(F.col("a_block").alias("block"), "name", "candidate", "bound")
        .repartition("block", "name")  # Spark chooses the number from what it has
    )


def fuzzy_resolve(
    left: DataFrame,
    right: DataFrame,
    alias: Mapping[tuple[str, str], str] | DataFrame | None = None,
    blocklist: Sequence[tuple[str, str, str]] | DataFrame = (),
    cutoff: float = config.FUZZY_CUTOFF,
    method: str = "ratio",
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Matches `left(block, name)` to `right(block, candidate)` within a block.

    Order: a listed alias whose target exists, the same name, else the best similar
    name at or above `cutoff` (equal scores: the greatest name). A blocklisted winner
    is not replaced by the runner-up. Blocks without candidates give no rows.
    Output (block, name, matched, match_type); labels: alias, exact, fuzzy, unmatched.
    """
    spark = left.sparkSession
    label = {"alias": "known_alias", "exact": "exact", "fuzzy": "fuzzy", "unmatched": "unmatched"}
    label.update(labels or {})
    alias = _as_table(
        spark,
        [(b, n, t) for (b, n), t in (alias or {}).items()] if not isinstance(alias, DataFrame) else alias,
        "block string, name string, target string",
    )
    blocked = _as_table(spark, blocklist, "block string, name string, candidate string")
    names = left.select("block", "name").distinct()
    options = right.select("block", "candidate").distinct()
    names = names.join(options.select("block").distinct(), "block", "left_semi")

    aliased = alias.join(
        options.withColumnRenamed("candidate", "target"), ["block", "target"], "left_semi"
    ).select("block", "name", F.col("target").alias("_alias"))
    same = options.select("block", F.col("candidate").alias("name"), F.lit(True).alias("_same"))
    first = names.join(aliased, ["block", "name"], "left").join(same, ["block", "name"], "left")
    first = materialize(first, "names")
    settled = first.where(F.col("_alias").isNotNull() | F.col("_same")).select(
        "block",
        "name",
        F.coalesce("_alias", "name").alias("matched"),
        F.when(F.col("_alias").isNotNull(), label["alias"]).otherwise(label["exact"]).alias("match_type"),
    )
    pending = first.where(F.col("_alias").isNull() & F.col("_same").isNull()).select("block", "name")

    pairs = similar_pairs(pending, options, cutoff, method)
    if method == "ratio":
        best = best_by_ratio(pairs, cutoff)
    elif method == "levenshtein":
        scored = pairs.withColumn("_score", edit_ratio(F.col("candidate"), F.col("name")))
        best = top_k(
            scored.where(F.col("_score") >= cutoff),
            ["block", "name"],
            [F.col("_score").desc(), F.col("candidate").desc()],
        )
    else:
        raise ValueError(f"unknown similarity {method!r}")
    allowed = best.join(blocked, ["block", "name", "candidate"], "left_anti")
    fuzzy = pending.join(allowed, ["block", "name"], "left").select(
        "block",
        "name",
        F.col("candidate").alias("matched"),
        F.when(F.col("candidate").isNotNull(), label["fuzzy"])
        .otherwise(label["unmatched"])
        .alias("match_type"),
    )
    return settled.unionByName(fuzzy)


def _as_table(spark, rows, schema: str) -> DataFrame:
    return rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), schema)


def polygon_names(
    polygons: DataFrame,
    reference: DataFrame,
    blocklist: Sequence[tuple[str, str, str]] | DataFrame = config.POLYGON_BLOCKLIST,
    cutoff: float = config.FUZZY_CUTOFF,
    method: str = "ratio",
) -> DataFrame:
    """Boundary names to reference names: no aliases, own blocklist, only matches kept."""
    found = fuzzy_resolve(
        polygons,
        reference,
        None,
        blocklist,
        cutoff,
        method,
        {"exact": "poly_exact", "fuzzy": "poly_fuzzy"},
    )
    return found.where(F.col("matched").isNotNull())
