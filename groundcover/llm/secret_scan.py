"""Secrets: fixed patterns, and random-looking strings found by two character Markov models.

Only DataFrame functions run on the executors. One first-order model is fitted to random
strings, one to ordinary identifiers; a run of token characters is a secret if the log-likelihood
ratio of the two reaches `threshold`, and RATE per character. The labelled samples come from a bounded share of the
documents: pattern matches and digests of the keys are random strings; the other words, alone and
joined as identifiers, lines of one character, alphabets, dates and numbers are ordinary. Only pair counts (at most 2 x 68 x 68 numbers) leave the cluster.

Spans are code points of the original text, end exclusive. Pattern spans are kept as they are; a
`markov` span is added only where it touches no pattern span.

Defined cases: a NULL text is empty; empty texts have no spans; repeated rows each give a row; NULL
keys stay NULL; with no documents the models are uniform and add nothing.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover.llm.common import free_name

# Kinds in their order, patterns, and the least length of the part that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]

ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"  # ^ starts a run
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9_-]{4,}"
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 64  # of one sample string
SMOOTHING = 0.5
THRESHOLD = 12.0  # nats in favour of a random string, and per character:
RATE = 0.8
MARK = "[SECRET]"

_SPAN = "array<struct<start:int,kind_rank:int,kind:string,end:int,value:string>>"


def _bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _least(pattern: str, group: int, least: int) -> str:
    """For a plain run, the length goes into the pattern: shorter runs could never be kept."""
    return pattern if group else pattern[:-1] + "{%d,}" % (least - len(pattern.split("[")[0]))


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost matches whose `group` has at least `least` characters.

    Offsets are running sums of the lengths of the matches and of the stretches between them.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(seen, m):
        begin = seen["at"] + F.length(m["gap"])
        end = begin + F.coalesce(F.length(m["all"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"),
            end.alias("end"), m["part"].alias("value"),
        )
        kept = F.when(F.length(m["part"]) >= least, F.array(span)).otherwise(F.array().cast(_SPAN))
        return F.struct(end.alias("at"), F.concat(seen["spans"], kept).alias("spans"))

    spans = F.aggregate(found, start, step, lambda seen: seen["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def pattern_spans(text: Column) -> Column:
    parts = [
        _matches(text, rank, kind, _least(pattern, group, least), group, least)
        for rank, (kind, pattern, group, least) in enumerate(PATTERNS)
    ]
    return F.array_sort(F.concat(*parts))


def sample(docs: DataFrame, n: int) -> DataFrame:
    """About `n` documents chosen by a hash of the key."""
    share = min(1.0, n / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))


def labelled_strings(docs: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """(random boolean, string) of the sampled documents."""
    digest = F.unhex(F.sha2(F.concat_ws(" ", F.lit("sample"), "doc_id"), 256))
    base64 = F.regexp_replace(F.base64(digest), "=+$", "")
    texts = sample(docs, n).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("spans", pattern_spans(F.col("text")))
    plain = F.col("text")
    for _, pattern, group, least in PATTERNS:
        plain = F.regexp_replace(plain, _least(pattern, group, least), " ")
    words = F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))
    neighbours = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, 1 << 30).alias("b"))
    joined = F.transform(
        F.filter(neighbours, lambda p: p["b"].isNotNull() & F.col("joins")),
        lambda p: F.array(
            F.concat_ws("_", p["a"], p["b"]), F.concat_ws("-", p["a"], p["b"]), F.concat(p["a"], F.initcap(p["b"])),
            F.concat_ws("/", p["a"], p["b"]), F.upper(F.concat_ws("_", p["a"], p["b"])),
        ),
    )
    some = F.pmod(F.xxhash64("doc_id", F.lit("line")), F.lit(len(ALPHABET) - 1)).cast("int") + 2
    lines = F.array(
        F.repeat(F.substr(F.lit(ALPHABET), some, F.lit(1)), F.lit(24)),
        F.repeat(F.substr(F.lit("-=_/+"), some % 5 + 1, F.lit(1)), F.lit(24)),
        F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("01234567890123456789"),
        F.regexp_replace(F.xxhash64("doc_id", F.lit("number")).cast("string"), "-", ""),
        F.date_format(F.timestamp_seconds(F.xxhash64("doc_id") % 2_000_000_000), "yyyy-MM-dd-HH-mm-ss"),
    )
    strings = texts.select(
        F.concat(
            F.transform("spans", lambda s: s["value"]),
            F.array(base64, F.lower(F.hex(digest)), F.upper(F.regexp_replace(base64, "[+/]", "7"))),
        ).alias("random"),
        words.alias("words"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("joins"),  # joined forms from a quarter
        lines.alias("lines"),
    ).select("random", F.concat("words", F.flatten(joined), "lines").alias("ordinary"))
    random = strings.select(F.lit(True).alias("random"), F.explode("random").alias("string"))
    return random.unionByName(strings.select(F.lit(False).alias("random"), F.explode("ordinary").alias("string")))


def train(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[float]:
    """log P(next | previous, random) - log P(next | previous, ordinary) for each pair of characters."""
    text = F.concat(F.lit("^"), F.substring("string", 1, SAMPLE_CHARS))
    pairs = F.transform(F.sequence(F.lit(1), F.length("string_") - 1), lambda i: F.substring("string_", i, 2))
    counted = (
        labelled_strings(docs, n).where("length(string) > 0").select("random", text.alias("string_"))
        .select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    )
    size = len(ALPHABET)
    counts = {label: [[SMOOTHING] * size for _ in range(size)] for label in (True, False)}
    for row in counted:
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b > 0:
            counts[row["random"]][a][b] += row["count"]
    sums = {label: [sum(line) for line in table] for label, table in counts.items()}
    return [
        math.log(counts[True][a][b] / sums[True][a]) - math.log(counts[False][a][b] / sums[False][a])
        for a in range(size) for b in range(size)
    ]


def log_ratio(string: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of ALPHABET's characters, in one pass over them."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("ratio"))

    def step(seen, char):
        code = F.instr(F.lit(ALPHABET), char) - 1
        return F.struct(
            code.alias("before"),
            (seen["ratio"] + F.get(table, seen["before"] * len(ALPHABET) + code)).alias("ratio"),
        )

    return F.aggregate(F.filter(F.split(string, ""), lambda c: c != ""), start, step, lambda seen: seen["ratio"])


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, into: str = "spans") -> DataFrame:
    """`docs` with `into`: all spans (start, kind_rank, kind, end, value), by start, then kind."""
    base, runs = free_name(docs, "base"), free_name(docs, "runs")
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumns({
        base: pattern_spans(text),
        runs: _matches(text, len(PATTERNS), "markov", CANDIDATE, 0, 16),
    })
    added = F.filter(
        runs,
        lambda r: ~F.exists(base, lambda s: (s["start"] < r["end"]) & (s["end"] > r["start"]))
        & (log_ratio(r["value"], model) >= F.greatest(F.lit(threshold), F.length(r["value"]) * RATE)),
    )
    return found.withColumn(into, F.array_sort(F.concat(F.col(base), added))).drop(base, runs)


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """`docs` with every span of the text replaced by `mark` (overlapping spans by one mark).

    `n_chars`, where there is such a column, follows the text.
    """
    into = free_name(docs, "spans")

    def step(seen, s):
        gap = F.substr("text", seen["at"] + 1, s["start"] - seen["at"])
        more = F.when(s["start"] >= seen["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(seen["at"], s["end"]).alias("at"), F.concat(seen["out"], more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(into, start, step, lambda seen: F.concat(seen["out"], F.substr("text", seen["at"] + 1)))
    text = F.when(F.size(into) > 0, rest).otherwise(F.col("text"))
    out = scan(docs, model, threshold, into).withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out
