"""The registered query of each operator, over its whole table with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundcover.llm import ann, bpe, chat, decontaminate, language_id, licenses, quality, quality_rules, resample, secret_scan, simhash, token_counts, whitening
from groundcover.llm.common import documents, fold
from groundcover.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = load_table(spark, folder, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = secret_scan.scan(docs, secret_scan.train(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.digest_text(base), 256).alias("base_sha256"),
        secret_scan.digest_text(F.col("spans")).alias("spans"),
    )


@query
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Raw transcripts of all conversations, parsed again and rendered."""
    blocks = chat.transcripts(load_table(spark, folder, "conversations"))
    parsed = chat.format_chats(blocks, chat.train(blocks))
    return parsed.select(
        "conv_id", "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
        F.length("rendered").cast("long").alias("n_chars"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_documents(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    docs = load_table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language_id.learn_and_identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = load_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0)


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(documents(spark, folder))
    return found.select(
        "doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"), "unknown",
        F.sha2("sequence", 256).alias("sequence_sha256"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_oracle() -> str:
    known = licenses.known_sentences()
    pairs = ", ".join(f"({_sql_text(s)}, {_sql_text(i)})" for s, i in known.items())
    runs: dict[str, str] = {}
    for licence, ids in licenses.RULES:
        runs.setdefault(" " + "  ".join(ids) + " ", licence)
    rules = ", ".join(f"({_sql_text(r)}, {_sql_text(name)})" for r, name in runs.items())
    joined = "coalesce(text, '')"
    for pattern in licenses.WRAPPED:
        joined = f"regexp_replace({joined}, {_sql_text(pattern)}, '\\1 \\2', 'g')"
    return f"""
WITH known(sentence, id) AS (VALUES {pairs}), rules(run, licence) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {joined} AS text FROM documents),
cut AS (SELECT r, doc_id, list_filter(list_transform(string_split_regex(text, {_sql_text(licenses.BREAK)}),
    lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    {_sql_text(licenses.NOT_WORD)}, ' ', 'g'))), lambda s: s <> '') AS found FROM docs),
placed AS (SELECT r, i, found[i] AS sentence FROM cut, unnest(generate_series(1, len(found))) AS u(i)),
named AS (
  SELECT r, string_agg(' ' || coalesce(id, '-') || ' ', '' ORDER BY i) AS sequence,
    bool_or(id IS NULL AND regexp_matches(sentence, {_sql_text(licenses.MENTION)})) AS unknown
  FROM placed LEFT JOIN known USING (sentence) GROUP BY r),
matched AS (SELECT r, run, j FROM named, unnest(regexp_extract_all(sequence, {_sql_text(licenses.rule_pattern())})) WITH ORDINALITY AS m(run, j)),
listed AS (SELECT r, string_agg(licence, ',' ORDER BY j) AS licenses FROM matched JOIN rules USING (run) GROUP BY r)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences, coalesce(licenses, '') AS licenses,
  coalesce(unknown, FALSE) AS unknown, sha256(coalesce(sequence, '')) AS sequence_sha256
FROM cut LEFT JOIN named USING (r) LEFT JOIN listed USING (r)
"""


ORACLES["op7_license_scan"] = _license_oracle()


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, folder), load_table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLES["op10_decontaminate"] = r"""
WITH doc_words AS (
  SELECT rowid_ AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS t
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT r, i, s.n, item_id FROM (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
    FROM doc_words, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i)) s
  JOIN windows USING (t)
), hits AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM found) f,
    unnest(generate_series(0, n - 1)) AS v(k) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(load_table(spark, folder, "embeddings"))
    return white.select(
        "vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


@query
def op12_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    found = resample.resample(documents(spark, folder), load_table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_importance_resample"] = r"""
WITH steps AS (SELECT generate_series AS i, generate_series AS c, 0 AS step FROM generate_series(0, 255)),
table_ AS (
  WITH RECURSIVE r AS (
    SELECT i, CAST(c AS BIGINT) AS c, step FROM steps
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM r WHERE step < 8)
  SELECT list(c ORDER BY i) AS t FROM r WHERE step = 8),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_words AS (SELECT r, unnest(w) AS word FROM docs),
item_words AS (SELECT unnest(w) AS word FROM items),
words AS (SELECT word FROM doc_words UNION SELECT word FROM item_words),
bytes AS (
  SELECT word, list_transform(generate_series(0, octet_length(encode(word)) - 1),
    lambda k: CAST('0x' || substr(hex(encode(word)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM words),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda crc, x: xor(crc >> 8, t[(xor(crc, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, table_),
doc_buckets AS (SELECT r, bucket FROM doc_words JOIN buckets USING (word)),
item_buckets AS (SELECT bucket FROM item_words JOIN buckets USING (word)),
s AS (SELECT bucket, count(*) AS s FROM doc_buckets GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM item_buckets GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM doc_buckets) AS all_s, (SELECT count(*) FROM item_buckets) AS all_t),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE)
    / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM doc_buckets JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' ||
      coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


@query
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.check(load_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.exp("log_perplexity").alias("perplexity"),
    )
