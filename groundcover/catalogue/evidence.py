"""Spans, retrieval, scoring and the summaries of scored evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundcover import config
from groundcover.catalogue import inputs
from groundcover.catalogue.registry import ORACLES, derive, query, with_inputs
from groundcover.functions.text import highlight_span
from groundcover.operators import coverage, gates, retrieve, score, serve, spans
from groundcover.plans.prefix import exact_quantiles
from groundcover.session import scratch_path, staging
from groundcover.sources.publish import publish
from groundcover.sources.tables import load_table


def _documents(spark, folder):
    """Documents as records: lines are the list field, the source is the free text."""
    return load_table(spark, folder, "documents").select(
        F.col("doc_id").alias("unique_id"),
        F.split("text", "\n").alias("capability"),
        F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("source")).alias("description"),
    )


def _span_row(df):
    return df.select("span_id", "unique_id", "field_source", F.length("text_span").alias("chars"),
                     F.md5("text_span").alias("text_md5"))


SPAN_DESCRIPTION = """
SELECT CAST(doc_id AS VARCHAR) || '_description' AS span_id, doc_id AS unique_id, 'description' AS field_source,
  source AS text_span FROM documents WHERE doc_id % 10 <> 0 AND length(trim(source)) > 0
"""
SPAN_OUT = "SELECT span_id, unique_id, field_source, CAST(length(text_span) AS INT) AS chars, md5(text_span) AS text_md5 FROM s"
SIMPLE_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) || '_capability' AS span_id, doc_id AS unique_id, 'capability' AS field_source,
  array_to_string(string_split(text, chr(10)), '. ') AS text_span FROM documents
WHERE length(trim(array_to_string(string_split(text, chr(10)), '. '))) > 0
UNION ALL {SPAN_DESCRIPTION}
"""


@query("spans_simple", f"WITH s AS ({SIMPLE_SQL}) {SPAN_OUT}")
def spans_simple(spark, folder):
    return _span_row(spans.spans_simple(_documents(spark, folder), list_fields=["capability"]))


@query(
    "span_truncation",
    f"WITH w AS ({SIMPLE_SQL}), s AS (SELECT * REPLACE (substr(text_span, 1, 2000) AS text_span) FROM w) {SPAN_OUT}",
)
def span_truncation(spark, folder):
    built = spans.spans_simple(_documents(spark, folder), list_fields=["capability"], max_chars=config.SPAN_CHARS)
    return _span_row(built)


@query(
    "spans_chunked",
    f"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS items FROM documents),
parts AS (SELECT doc_id, items, unnest(range(0, CAST(ceil(len(items) / 4.0) AS BIGINT))) AS part FROM lines),
chunks AS (SELECT doc_id, part, array_to_string(items[part * 4 + 1 : part * 4 + 4], '. ') AS text_span FROM parts),
s AS (SELECT CAST(doc_id AS VARCHAR) || '_capability_' || CAST(part AS VARCHAR) AS span_id, doc_id AS unique_id,
    'capability' AS field_source, text_span FROM chunks WHERE length(trim(text_span)) > 0
  UNION ALL {SPAN_DESCRIPTION}) {SPAN_OUT}""",
)
def spans_chunked(spark, folder):
    return _span_row(spans.spans_chunked(_documents(spark, folder), list_fields=["capability"]))


CHUNKED_SQL = f"""
SELECT span_id, unique_id, field_source, text_span FROM (
  SELECT CAST(doc_id AS VARCHAR) || '_capability_' || CAST(part AS VARCHAR) AS span_id, doc_id AS unique_id,
    'capability' AS field_source, array_to_string(items[part * 4 + 1 : part * 4 + 4], '. ') AS text_span
  FROM (SELECT doc_id, items, unnest(range(0, CAST(ceil(len(items) / 4.0) AS BIGINT))) AS part
    FROM (SELECT doc_id, string_split(text, chr(10)) AS items FROM documents) AS l) AS p) AS c
WHERE length(trim(text_span)) > 0
UNION ALL {SPAN_DESCRIPTION}
"""


@query(
    "span_granularity",
    f"""
WITH simple AS ({SIMPLE_SQL}), chunked AS ({CHUNKED_SQL})
SELECT 'simple' AS chosen, field_source, count(*) AS spans, sum(length(text_span))::BIGINT AS chars FROM simple GROUP BY field_source
UNION ALL SELECT 'chunked', field_source, count(*), sum(length(text_span))::BIGINT FROM chunked GROUP BY field_source""",
)
def span_granularity(spark, folder):
    def counted(name):
        built = spans.spans_by(_documents(spark, folder), name, list_fields=["capability"])
        sizes = built.groupBy("field_source").agg(
            F.count(F.lit(1)).alias("spans"), F.sum(F.length("text_span")).cast("long").alias("chars")
        )
        return sizes.withColumn("chosen", F.lit(name))

    return counted("simple").unionByName(counted("chunked"))


# Vectors of `hashed_words`: word counts at places given by md5, brought to length 1.
def _vector_sql(rows: str) -> str:
    return f"""
words AS (SELECT span_id, unnest(string_split_regex(lower(text_span), '[ \t\r\n]+')) AS word FROM {rows}),
places AS (SELECT span_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS place, count(*)::DOUBLE AS n
  FROM words WHERE word <> '' GROUP BY ALL),
lengths AS (SELECT span_id, sqrt(sum(n * n)) AS length FROM places GROUP BY span_id),
parts AS (SELECT span_id, place, CAST(n / length AS FLOAT) AS x FROM places JOIN lengths USING (span_id))
"""


@query(
    "embed_spans",
    f"""
WITH s AS ({SIMPLE_SQL}), {_vector_sql("s")},
vectors AS (SELECT span_id, string_agg(CAST(place AS VARCHAR) || ':' || CAST(CAST(floor(x::DOUBLE * 16777216) AS BIGINT) AS VARCHAR), ','
  ORDER BY place) AS vector FROM parts GROUP BY span_id)
SELECT span_id, CAST(64 AS INT) AS dim, FALSE AS embedding_failed, md5(coalesce(vector, '')) AS vector_md5
FROM s LEFT JOIN vectors USING (span_id)""",
)
def embed_spans(spark, folder):
    built = spans.spans_simple(_documents(spark, folder), list_fields=["capability"])
    embedded = spans.embed_spans(built)
    parts = F.transform(
        "embedding",
        lambda x, i: F.concat_ws(":", i, F.floor(x.cast("double") * (1 << 24)).cast("long")),
    )
    vector = F.array_join(F.filter(parts, lambda p: ~p.endswith(":0")), ",")
    return embedded.select("span_id", F.size("embedding").alias("dim"), "embedding_failed", F.md5(vector).alias("vector_md5"))


def _query_vectors(spark, folder):
    """The six query vectors: the lowest vec_id of labels 0..5."""
    emb = load_table(spark, folder, "embeddings").where(F.col("label") < 6)
    rows = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()
    return {f"q{r['label']}": r["v"] for r in rows}


QUERY_SQL = """
q AS (SELECT 'q' || CAST(label AS VARCHAR) AS capability, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS qv
  FROM embeddings WHERE label < 6 GROUP BY label)
"""
TOPK_SQL = """
WITH {q}, scored AS (SELECT capability, vec_id, {score} AS score FROM embeddings CROSS JOIN q)
SELECT capability, vec_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY capability ORDER BY score DESC, vec_id) AS r FROM scored) AS x
WHERE r <= {k}"""


def _topk(spark, folder, metric, k):
    found = retrieve.vector_topk(
        load_table(spark, folder, "embeddings"), _query_vectors(spark, folder), k, metric, key="vec_id"
    )
    return found.withColumn("score", F.round("score", 6))


V = "CAST(embedding AS DOUBLE[])"


@query("vector_topk_cosine", TOPK_SQL.format(q=QUERY_SQL, k=50, score=f"list_cosine_similarity({V}, qv)"))
def vector_topk_cosine(spark, folder):
    return _topk(spark, folder, "cosine", 50)


@query("vector_topk_dot", TOPK_SQL.format(q=QUERY_SQL, k=4000, score=f"list_inner_product({V}, qv)"))
def vector_topk_dot(spark, folder):
    return _topk(spark, folder, "dot", config.TOP_K)


@query(
    "vector_topk_l2",
    TOPK_SQL.format(q=QUERY_SQL, k=50, score=f"1 / (1 + list_distance({V}, qv) * list_distance({V}, qv))"),
)
def vector_topk_l2(spark, folder):
    return _topk(spark, folder, "l2_sim", 50)


def _search_sql() -> str:
    names = list(config.CAPABILITY_QUERIES)
    vectors = spans.hashed_words(list(config.CAPABILITY_QUERIES.values()))
    values = ", ".join(f"('{n}', {i}, {x!r}::DOUBLE)" for n, v in zip(names, vectors) for i, x in enumerate(v) if x)
    return f"""
WITH s AS ({CHUNKED_SQL}), {_vector_sql("s")}, q(capability, place, y) AS (VALUES {values}),
norms AS (SELECT span_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM parts GROUP BY span_id),
qnorms AS (SELECT capability, sqrt(sum(y * y)) AS norm FROM q GROUP BY capability),
dots AS (SELECT span_id, capability, sum(x::DOUBLE * y) AS dot FROM parts JOIN q USING (place) GROUP BY ALL)
SELECT capability, span_id, unique_id, field_source, length(text_span)::INT AS chars,
  round(coalesce(dot / norms.norm / qnorms.norm, 0), 6) AS score
FROM s CROSS JOIN qnorms LEFT JOIN dots USING (span_id, capability) LEFT JOIN norms USING (span_id)"""


@query("span_search", _search_sql())
def span_search(spark, folder):
    """Documents cut into spans, embedded, every span scored for every capability, text attached."""
    built = spans.spans_chunked(_documents(spark, folder), list_fields=["capability"])
    embedded = spans.embed_spans(built).where(~F.col("embedding_failed"))
    names = list(config.CAPABILITY_QUERIES)
    vectors = dict(zip(names, spans.hashed_words(list(config.CAPABILITY_QUERIES.values())), strict=True))
    facts = embedded.select("span_id", "unique_id", "field_source", F.length("text_span").alias("chars"), "embedding")
    return retrieve.vector_topk(facts, vectors, k=None, carry=["unique_id", "field_source", "chars"]).select(
        "capability", "span_id", "unique_id", "field_source", F.round("score", 6).alias("score"), "chars"
    )


WEIGHT = "CASE field_source WHEN 'capability' THEN 1.0::DOUBLE WHEN 'procedure' THEN 0.85::DOUBLE WHEN 'equipment' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END"
BEST_SQL = f"""
best AS (SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY unique_id, capability ORDER BY weighted_score DESC, score DESC, span_id) AS r
  FROM (SELECT *, score * {WEIGHT} AS weighted_score FROM matches) AS w) AS x WHERE r = 1)
"""
CUTS_SQL = """
cuts AS (SELECT quantile_cont(weighted_score, 0.4::DOUBLE) AS low, quantile_cont(weighted_score, 0.7::DOUBLE) AS med,
  quantile_cont(weighted_score, 0.9::DOUBLE) AS high FROM best)
"""
BANDED_SQL = """
banded AS (SELECT best.*, CASE WHEN weighted_score >= high THEN 'verified' WHEN weighted_score >= med THEN 'likely'
  WHEN weighted_score >= low THEN 'weak_signal' ELSE 'no_signal' END AS evidence_status FROM best CROSS JOIN cuts)
"""


def _any(words):
    return " OR ".join(f"contains(t, '{w}')" for w in words)


KEYWORD_SQL = (
    "guarded AS (SELECT * REPLACE (CASE WHEN evidence_status = 'likely' AND NOT keyword_confirmed THEN 'weak_signal' "
    "WHEN evidence_status = 'weak_signal' AND NOT keyword_confirmed THEN 'no_signal' ELSE evidence_status END AS evidence_status) "
    "FROM (SELECT *, CASE capability "
    + " ".join(f"WHEN '{c}' THEN ({_any(w)})" for c, w in config.CAPABILITY_KEYWORDS.items())
    + " END AS keyword_confirmed FROM (SELECT *, lower(coalesce(text_span, '')) AS t FROM banded) AS a) AS k)"
)
RANK_SQL = """
ranked AS (SELECT *, (rank() OVER (ORDER BY weighted_score) + (count(*) OVER (PARTITION BY weighted_score) - 1) / 2.0::DOUBLE)
  / count(*) OVER () * 100 AS percentile_rank FROM guarded)
"""
SCORED_SQL = """
scored AS (SELECT r.*, f.richness_prior,
  least(CAST(least(100, greatest(0, round_even(percentile_rank * 0.75::DOUBLE + coalesce(f.richness_prior, 0) * 25, 0))) AS INT),
    CASE evidence_status WHEN 'no_signal' THEN 30 WHEN 'weak_signal' THEN 60 WHEN 'likely' THEN 90 ELSE 100 END) AS trust_score_pct
  FROM ranked AS r LEFT JOIN facilities AS f ON r.unique_id = f.unique_id)
"""
STEPS = [BEST_SQL, CUTS_SQL, BANDED_SQL, KEYWORD_SQL, RANK_SQL, SCORED_SQL]


def chain(upto: int, body: str) -> str:
    return with_inputs(
        "WITH " + ",".join(STEPS[:upto]) + body, matches=inputs.MATCHES, facilities=inputs.FACILITIES
    )


def _best(spark, folder):
    return score.best_match(score.weighted_score(derive(spark, folder, inputs.MATCHES)))


def _evidence(spark, folder):
    return score.capability_evidence(
        derive(spark, folder, inputs.MATCHES), derive(spark, folder, inputs.FACILITIES)
    )


@query(
    "best_evidence",
    chain(1, " SELECT unique_id, capability, field_source, text_span, score, span_id, weighted_score FROM best"),
)
def best_evidence(spark, folder):
    return _best(spark, folder).select(
        "unique_id", "capability", "field_source", "text_span", "score", "span_id", "weighted_score"
    )


@query(
    "thresholds",
    chain(2, """ SELECT unnest([0.4, 0.7, 0.9])::DOUBLE AS q, round(unnest([low, med, high]), 9) AS quantile FROM cuts"""),
)
def thresholds(spark, folder):
    return score.thresholds(_best(spark, folder)).withColumn("quantile", F.round("quantile", 9))


@query(
    "quantiles_by_capability",
    chain(1, """ SELECT capability, unnest([0.4, 0.7, 0.9])::DOUBLE AS q, round(unnest([
  quantile_cont(weighted_score, 0.4::DOUBLE), quantile_cont(weighted_score, 0.7::DOUBLE), quantile_cont(weighted_score, 0.9::DOUBLE)]), 9) AS quantile
  FROM best GROUP BY capability"""),
)
def quantiles_by_capability(spark, folder):
    cuts = exact_quantiles(_best(spark, folder), "weighted_score", config.STATUS_QUANTILES, ["capability"])
    return cuts.withColumn("quantile", F.round("quantile", 9))


@query("classify", chain(3, " SELECT unique_id, capability, evidence_status FROM banded"))
def classify(spark, folder):
    best = _best(spark, folder)
    return score.classify(best, score.thresholds(best)).select("unique_id", "capability", "evidence_status")


@query("keyword_guard", chain(4, " SELECT unique_id, capability, keyword_confirmed, evidence_status FROM guarded"))
def keyword_guard(spark, folder):
    best = _best(spark, folder)
    banded = score.classify(best, score.thresholds(best))
    return score.apply_keyword_guard(score.keyword_confirmed(banded)).select(
        "unique_id", "capability", "keyword_confirmed", "evidence_status"
    )


WORDS = {"en": ["the", "ing"], "fr": ["ent", "eau"], "de": ["sch", "ung"], "es": ["que", "ción"]}


@query(
    "keyword_documents",
    "SELECT doc_id, CASE lang "
    + " ".join(f"WHEN '{c}' THEN ({_any(w)})" for c, w in WORDS.items())
    + " END AS keyword_confirmed FROM (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents) AS d",
)
def keyword_documents(spark, folder):
    docs = load_table(spark, folder, "documents").select("doc_id", "lang", "text")
    return score.keyword_confirmed(docs, WORDS, "lang", "text").select("doc_id", "keyword_confirmed")


@query("pct_rank_avg", chain(5, " SELECT unique_id, capability, round(percentile_rank, 6) AS percentile_rank FROM ranked"))
def pct_rank_avg(spark, folder):
    ranked = score.pct_rank_avg(_best(spark, folder))
    return ranked.select("unique_id", "capability", F.round("percentile_rank", 6).alias("percentile_rank"))


@query(
    "pct_rank_ties",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round((rank() OVER (ORDER BY l_quantity)
  + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 6) AS percentile_rank FROM lineitem""",
)
def pct_rank_ties(spark, folder):
    rows = load_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    ranked = score.pct_rank_avg(rows, "l_quantity")
    return ranked.withColumn("percentile_rank", F.round("percentile_rank", 6))


@query(
    "trust_score",
    chain(6, f""" SELECT unique_id, capability, evidence_status, keyword_confirmed,
  CAST(trust_score_pct AS DOUBLE) / 100 AS trust_score, trust_score_pct, field_source, text_span,
  score, richness_prior, '{config.CONFIRM_MESSAGE}' AS confirm_message FROM scored"""),
)
def trust_score(spark, folder):
    return _evidence(spark, folder)


@query("trust_score_published", ORACLES["trust_score"])
def trust_score_published(spark, folder):
    """The same, published; its candidate and staging tables are dropped before it is read."""
    path = scratch_path(spark, "trust-score")
    with staging(spark):
        return publish(_evidence(spark, folder), path)


@query(
    "status_pivot",
    chain(4, """ SELECT capability, verified, likely, weak_signal, no_signal,
  round(verified / n * 100, 2) AS verified_pct, round(likely / n * 100, 2) AS likely_pct,
  round(weak_signal / n * 100, 2) AS weak_signal_pct, round(no_signal / n * 100, 2) AS no_signal_pct
FROM (SELECT capability, count(*)::DOUBLE AS n, count(*) FILTER (WHERE evidence_status = 'verified') AS verified,
  count(*) FILTER (WHERE evidence_status = 'likely') AS likely, count(*) FILTER (WHERE evidence_status = 'weak_signal') AS weak_signal,
  count(*) FILTER (WHERE evidence_status = 'no_signal') AS no_signal FROM guarded GROUP BY capability) AS g"""),
)
def status_pivot(spark, folder):
    return coverage.status_pivot(_evidence(spark, folder), "capability", "evidence_status", config.STATUSES)


@query(
    "status_distribution",
    chain(4, """ SELECT evidence_status, count(*) AS rows, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct
FROM guarded GROUP BY evidence_status"""),
)
def status_distribution(spark, folder):
    return coverage.distribution(_evidence(spark, folder), "evidence_status")


@query(
    "count_by",
    chain(4, " SELECT capability, evidence_status, count(*) AS rows FROM guarded GROUP BY capability, evidence_status"),
)
def count_by(spark, folder):
    return coverage.count_by(_evidence(spark, folder), "capability", "evidence_status")


@query(
    "describe_by",
    with_inputs(
        """
SELECT field_source, count(score) AS count, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS std,
  round(min(score), 9) AS min, round(max(score), 9) AS max, round(quantile_cont(score, 0.25::DOUBLE), 9) AS p25,
  round(quantile_cont(score, 0.5::DOUBLE), 9) AS p50, round(quantile_cont(score, 0.75::DOUBLE), 9) AS p75
FROM matches GROUP BY field_source""",
        matches=inputs.MATCHES,
    ),
)
def describe_by(spark, folder):
    out = serve.describe_by(derive(spark, folder, inputs.MATCHES), "field_source", "score")
    return out.select("field_source", "count", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@query(
    "top_per_status",
    chain(6, """ SELECT evidence_status, unique_id, capability, trust_score_pct, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY evidence_status ORDER BY score DESC, unique_id, capability) AS r FROM scored
  WHERE evidence_status IN ('verified', 'likely', 'weak_signal')) AS x WHERE r <= 5"""),
)
def top_per_status(spark, folder):
    order = [F.col("score").desc(), F.col("unique_id"), F.col("capability")]
    picked = serve.top_per_status(_evidence(spark, folder), "evidence_status", order, 5)
    return picked.select("evidence_status", "unique_id", "capability", "trust_score_pct", "rank")


@query(
    "degenerate_gate",
    chain(4, """,
per AS (SELECT capability, count(DISTINCT evidence_status) AS k FROM guarded GROUP BY capability),
tot AS (SELECT evidence_status, count(*)::DOUBLE AS n FROM guarded GROUP BY evidence_status)
SELECT 'every_status' AS gate, count(*) = 4 AS ok, CAST(4 - count(*) AS VARCHAR) AS detail FROM tot
UNION ALL SELECT 'largest_status_share', max(n) / sum(n) < 0.95, CAST(round(max(n) / sum(n), 4) AS VARCHAR) FROM tot
UNION ALL SELECT 'every_status_per_group', count(*) FILTER (WHERE k < 4) = 0, CAST(count(*) FILTER (WHERE k < 4) AS VARCHAR) FROM per"""),
)
def degenerate_gate(spark, folder):
    return gates.not_degenerate(_evidence(spark, folder))


@query(
    "highlight",
    """
SELECT doc_id, CAST(length(before) AS INT) AS before_chars, match, md5(before || match || after) AS joined_md5 FROM (
  SELECT doc_id, CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END AS before,
    CASE WHEN p > 0 THEN substr(text, p, length(hit)) END AS match, CASE WHEN p > 0 THEN substr(text, p + length(hit)) END AS after
  FROM (SELECT doc_id, text, hit, CASE WHEN hit IS NULL THEN 0 ELSE strpos(lower(text), hit) END AS p FROM (
    SELECT doc_id, text, CASE WHEN contains(lower(text), 'zzq') THEN 'zzq' WHEN contains(lower(text), 'ENT. ') THEN 'x'
      WHEN contains(lower(text), 'ent. ') THEN 'ent. ' WHEN contains(lower(text), 'the') THEN 'the' END AS hit
    FROM documents) AS h) AS a) AS b""",
)
def highlight(spark, folder):
    wanted = F.array(F.lit("zzq"), F.lit("ENT. "), F.lit("the"))
    cut = load_table(spark, folder, "documents").select("doc_id", highlight_span(F.col("text"), wanted).alias("h"))
    return cut.select(
        "doc_id",
        F.length("h.before").alias("before_chars"),
        "h.match",
        F.md5(F.concat("h.before", "h.match", "h.after")).alias("joined_md5"),
    )
