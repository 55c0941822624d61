"""Quality rules: word counts and repetitions, then perplexity bands per language.

The base rules look at one text: too few words, or too many words inside repeated runs of words. What they keep is judged
by the perplexity of its characters under modified Kneser-Ney n-gram models (`ngram_model`), which are counted over all texts. Each
language has two models, from the two halves of its texts (by a hash of the text, so that copies are in one half), and a text is
scored by the model of the half that it isn't in: no text vouches for itself. Log perplexities of the texts that pass the base rules give each
language its band, the median plus and minus BAND robust deviations, or LEAST_REACH if that is more: texts under it (endless
repetition) or over it (noise, another language or script throughout) are rejected, a quotation in another language isn't enough.

Medians and deviations come from counts of log perplexities in steps of 1 / STEPS, over all texts.

Defined cases: NULL and empty texts have no words and fail the base rules; texts without a language form a language of their own; a text whose
language has no other half has no perplexity (NULL) and only the base rules decide; repeated rows each give a row and count in the
bands; an empty table gives no rows.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundcover.llm import ngram_model
from groundcover.llm.ngram_model import WORD, words_of
from groundcover.session import materialize

LEAST_WORDS = 20
REPEAT_PERCENT = 30
RUN = 8
SYMBOLS = "#*$%&|<>"
BAND = 6.0
LEAST_REACH = 1.0  # of log perplexity, a factor of e per character: uniform languages have narrow deviations
STEPS = 100
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
MEASURES = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long>"


def repeated_words(words: Sequence[str], run: int = RUN) -> int:
    """Words inside runs of `run` (a power of two) words that the text holds twice or more."""
    if len(words) <= run:
        return 0
    # Equal runs have equal hashes: mostly no two are equal, and that is all there is to know.
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(len(words) - run + 1, np.uint64)
    for i in range(run):
        sums = sums * _FACTOR + hashes[i : len(words) - run + 1 + i]
    sums.sort()
    if (sums[1:] != sums[:-1]).all():
        return 0
    number = pd.factorize(np.array(words, object))[0].astype(np.int64)
    width = 1
    while width < run:
        pairs = number[: len(number) - width] * (int(number.max()) + 1) + number[width:]
        _, number, times = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
    twice = np.flatnonzero(times[number] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[twice] += 1
    edges[twice + run] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = words_of(text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), copies, repeated_words(words)


def failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def halves(df: DataFrame, lang: str, text: str) -> DataFrame:
    """Adds `own` and `other`: names of the models of a text's own half of its language and of the other half."""
    half = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(1)

    def name(which: Column) -> Column:
        return F.concat(F.coalesce(F.col(lang).cast("string"), F.lit("")), F.lit("\t"), which.cast("string"))

    return df.withColumn("own", name(half)).withColumn("other", name(1 - half))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high): bounds of log perplexity, from the counts of its steps in each language."""
    steps = scored.where("NOT base_failed AND log_perplexity IS NOT NULL").select("lang", F.round(F.col("log_perplexity") * STEPS).cast("int").alias("step"))
    counts = steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    middle = _median(counts, "step").withColumnRenamed("median", "middle")
    apart = counts.join(middle, F.col("lang").eqNullSafe(F.col("m_lang"))).withColumn("apart", F.abs(F.col("step") - F.col("middle")))
    spread = _median(apart.groupBy("lang", "middle", "apart").agg(F.sum("n").alias("n")), "apart", "middle")
    reach = F.greatest(BAND * 1.4826 * F.col("median") / STEPS, F.lit(LEAST_REACH))
    return spread.select("m_lang", (F.col("middle") / STEPS - reach).alias("low"), (F.col("middle") / STEPS + reach).alias("high"))


def _median(counts: DataFrame, value: str, *keep: str) -> DataFrame:
    """(m_lang, keep, median) of counted values; a language has a few thousand different ones at most."""
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy(value))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return (
        counts.withColumn("up_to", up_to).withColumn("total", total).where(2 * F.col("up_to") >= F.col("total"))
        .groupBy(F.col("lang").alias("m_lang"), *keep).agg(F.min(value).alias("median"))
    )


def check(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: id, lang, the five measures, base_failed, log_perplexity (per character), low, high, kept."""
    named = halves(docs.select(F.col(id_col), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), "lang", "text")
    models = ngram_model.train(named, "text", "own")
    found = ngram_model.score(named, models, id_col, "text", "other", measures, MEASURES)
    lang_of = F.expr("substring(model, 1, length(model) - 2)")
    scored = materialize(
        found.select(
            id_col, F.when(lang_of != "", lang_of).alias("lang"), "measured.*", failed(F.col("measured")).alias("base_failed"),
            F.when(F.col("chars") > 0, -F.col("log_probability") / F.col("chars")).alias("log_perplexity"),
        ),
        "perplexities",
    )
    judged = scored.join(bands(scored), F.col("lang").eqNullSafe(F.col("m_lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(*scored.columns, "low", "high", (~F.col("base_failed") & inside).alias("kept"))
