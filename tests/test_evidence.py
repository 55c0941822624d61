import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcover import config
from groundcover.operators import explain, gates, retrieve, rules, score, spans


def test_chunked_spans_count_null_items(spark):
    df = spark.createDataFrame(
        [("f0", []), ("f1", ["a"]), ("f4", list("abcd")), ("f5", ["a", None, "c", "d", "e"]),
         ("f9", [str(i) for i in range(9)]), ("blank", [None, " ", None, None, "x"]), ("none", None)],
        "unique_id string, capability array<string>").withColumn("description", F.lit(" text "))
    got = {r["span_id"]: r["text_span"] for r in spans.spans_chunked(df, list_fields=["capability"]).collect()}
    assert got["f1_capability_0"] == "a"
    assert (got["f5_capability_0"], got["f5_capability_1"]) == ("a. c. d", "e")
    assert "f9_capability_2" in got and "f9_capability_3" not in got
    assert "blank_capability_0" not in got and got["blank_capability_1"] == "x"
    assert "f0_capability_0" not in got and got["none_description"] == " text "
    simple = {r["span_id"]: r["text_span"] for r in spans.spans_simple(df, list_fields=["capability"]).collect()}
    assert simple["f5_capability"] == "a. c. d. e" and "f0_capability" not in simple


def test_spans_scan_the_facts_once(spark, tmp_path):
    df = spark.createDataFrame([("f", ["a"], ["b"], ["c"], "d")],
                               "unique_id string, capability array<string>, procedure array<string>, equipment array<string>, description string")
    df.write.parquet(str(tmp_path / "f"))
    plan = spans.spans_chunked(spark.read.parquet(str(tmp_path / "f")))
    assert plan.count() == 4
    assert plan._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_truncation_counts_characters(spark):
    df = spark.createDataFrame([("ü" * 2500,)], "t string")
    assert df.select(F.length(spans.truncate_span(F.col("t"), 2000))).first()[0] == 2000
    assert df.select(F.length(spans.truncate_span(F.col("t")))).first()[0] == 2500


def test_granularity_is_named(spark):
    df = spark.createDataFrame([("f", list("abcdefghi"))], "unique_id string, capability array<string>")
    options = {"list_fields": ["capability"], "text_field": None}
    assert spans.spans_by(df, "chunked", **options).count() == 3
    assert spans.spans_by(df, "simple", **options).count() == 1
    with pytest.raises(ValueError, match="granularity"):
        spans.spans_by(df, "finest", **options)


def test_embedding_failures_keep_null_vectors(spark):
    def flaky(texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(str(i), "bad" if i == 3 else "x" * (i + 1)) for i in range(6)], "span_id string, text_span string")
    out = {r["span_id"]: r for r in spans.embed_spans(df, flaky, batch=4).collect()}
    assert out["3"]["embedding"] is None and out["3"]["embedding_failed"]
    assert list(out["5"]["embedding"]) == [6.0, 1.0] and not out["5"]["embedding_failed"]
    found = retrieve.vector_topk(spans.embed_spans(df, flaky), {"q": [1.0, 0.0]}, 10, "dot")
    assert found.count() == 5


def test_hanging_and_failing_calls_cost_one_text(spark):
    """A call that never returns, one that fails, one that answers short: the others of their batches get vectors, the task goes on."""

    def difficult(texts):
        if "hang" in texts:
            time.sleep(3600)
        if "fail" in texts:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts][: 1 if "short" in texts else None]

    texts = ["hang" if i == 7 else "fail" if i == 23 else "short" if i in (31, 32) else None if i == 40 else "x" * i for i in range(50)]
    df = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "span_id int, text_span string, extra int").coalesce(1)
    started = time.time()
    out = spans.embed_spans(df, difficult, batch=5, limit=0.5, patience=0.5)
    assert out.columns == ["span_id", "text_span", "extra", "embedding", "embedding_failed"]
    rows = {r["span_id"]: r for r in out.collect()}
    assert time.time() - started < 30
    assert len(rows) == 50 and all(r["extra"] == 2 * i for i, r in rows.items())
    assert {i for i, r in rows.items() if r["embedding_failed"]} == {7, 23, 40}
    assert all((r["embedding"] is None) == r["embedding_failed"] for r in rows.values())
    assert all(list(r["embedding"]) == [float(len(texts[i])), 1.0] for i, r in rows.items() if r["embedding"])


def test_calls_run_side_by_side_and_in_order():
    running, most = [], []

    def slow(texts):
        running.append(1)
        most.append(len(running))
        time.sleep(0.05 if "0" in texts else 0.01)
        running.pop()
        return [[float(t)] for t in texts]

    texts = [str(i) for i in range(200)]
    assert spans.embed_texts(texts, slow, batch=10, workers=6) == [[float(i)] for i in range(200)]
    assert 2 <= max(most) <= 6
    assert spans.embed_texts([], slow) == []


def test_a_filter_on_the_flag_embeds_once(spark):
    df = spark.createDataFrame([(str(i), "x") for i in range(10)], "span_id string, text_span string")
    found = spans.embed_spans(df).where("NOT embedding_failed").select("span_id", "embedding", "text_span")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and found.count() == 10
    carried = retrieve.vector_topk(found, {"q": [1.0] + [0.0] * 63}, 4, "dot", carry=["text_span"])
    assert carried.columns == ["capability", "span_id", "text_span", "score", "rank"]
    assert [tuple(r)[1:3] for r in carried.orderBy("rank").collect()] == [(str(i), "x") for i in range(4)]


@pytest.mark.parametrize("k", [3, 1200])
def test_vector_topk_ties_and_nulls(spark, k):
    data = [(f"s{i:05d}", [float(i % 50), 1.0]) for i in range(3000)] + [("null", None)]
    df = spark.createDataFrame(data, "span_id string, embedding array<float>").repartition(5)
    got = retrieve.vector_topk(df, {"a": [1.0, 0.0], "b": [-1.0, 0.0]}, k, "dot").collect()
    for name, sign in (("a", 1), ("b", -1)):
        best = sorted(((-sign * v[0], s) for s, v in data if v is not None))[:k]
        mine = sorted((r["rank"], r["span_id"]) for r in got if r["capability"] == name)
        assert [s for _, s in mine] == [s for _, s in best]


def test_equal_vectors_leave_a_task_as_k_rows(spark):
    df = spark.range(20_000).selectExpr("id AS span_id", "array(1.0F, 2.0F) AS embedding").repartition(4)
    found = retrieve.vector_topk(df, {"q": [1.0, 0.0]}, 10, "dot")
    assert sorted(r["span_id"] for r in found.collect()) == list(range(10))
    whole = retrieve.vector_topk(df, {"q": [1.0, 0.0]}, None, "dot")
    assert whole.count() == 20_000 and "rank" not in whole.columns


@pytest.mark.parametrize("metric", retrieve.METRICS)
def test_search_of_embedded_text(spark, metric):
    texts = [f"ward {i % 7} icu {'ventilator ' * (i % 4)}bed {i}" for i in range(200)]
    df = spark.createDataFrame([(f"s{i:03d}", t) for i, t in enumerate(texts)], "span_id string, text_span string").repartition(3)
    target = np.array(spans.hashed_words(["icu ventilator ward"])[0])
    found = retrieve.vector_topk(spans.embed_spans(df), {"ICU": target.tolist()}, 20, metric)
    got = retrieve.attach_spans(found, df).orderBy("rank").collect()
    vectors = np.array(spans.hashed_words(texts), dtype="float32").astype("float64")
    if metric == "l2_sim":
        scores = 1 / (1 + ((vectors - target) ** 2).sum(axis=1))
    else:
        scores = (vectors * target).sum(axis=1)
        if metric == "cosine":
            scores = scores / np.sqrt((vectors**2).sum(axis=1)) / np.sqrt((target**2).sum())
    assert np.allclose([r["score"] for r in got], np.sort(scores)[::-1][:20])
    assert all(r["text_span"] == texts[int(r["span_id"][1:])] for r in got)


def test_weight_and_keyword_gaps_stop(spark):
    df = spark.createDataFrame([("u", "ICU", "other", "t", 1.0)], "unique_id string, capability string, field_source string, text_span string, score double")
    with pytest.raises(Exception, match="no weight for field_source: other"):
        score.weighted_score(df).collect()
    with pytest.raises(Exception, match="no keywords for capability"):
        score.keyword_confirmed(df.withColumn("capability", F.lit("Dental"))).collect()


def test_keyword_is_substring_and_guard_is_one_step(spark):
    df = spark.createDataFrame(
        [("ICU", "a NICU ward", "likely"), ("ICU", "dental", "likely"), ("ICU", None, "weak_signal"),
         ("ICU", "dental", "verified"), ("ICU", "dental", "no_signal")],
        "capability string, text_span string, evidence_status string")
    out = [tuple(r) for r in score.apply_keyword_guard(score.keyword_confirmed(df)).select("keyword_confirmed", "evidence_status").collect()]
    assert out == [(True, "likely"), (False, "weak_signal"), (False, "no_signal"), (False, "verified"), (False, "no_signal")]


def test_trust_score_caps_and_half_even(spark):
    df = spark.createDataFrame(
        [("a", 100.0, "verified"), ("b", 100.0, "likely"), ("c", 100.0, "weak_signal"), ("d", 100.0, "no_signal"),
         ("e", 50.0, "verified"), ("f", 2.0, "verified")], "unique_id string, percentile_rank double, evidence_status string")
    priors = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("e", None)], "unique_id string, richness_prior double")
    got = {r["unique_id"]: r["trust_score_pct"] for r in score.trust_score(df, priors).collect()}
    assert got == {"a": 100, "b": 90, "c": 60, "d": 30, "e": 38, "f": 2}  # 37.5 -> 38, 1.5 -> 2


def test_thresholds_sketch_is_close(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("weighted_score"))
    exact = [r[1] for r in score.thresholds(df).orderBy("q").collect()]
    sketch = [r[1] for r in score.thresholds(df, exact=False).orderBy("q").collect()]
    assert all(abs(a - b) <= 1.0 for a, b in zip(exact, sketch, strict=True))


FACTS = ("evidence_status string, capability string, doctors_reported boolean, capacity_reported boolean, source_type_count int, "
         "affiliated_staff_presence boolean, custom_logo_presence boolean, number_of_facts_about_the_organization double, "
         "coordinates_valid boolean, district_resolved boolean")
GOOD = dict(evidence_status="verified", capability="Maternity", doctors_reported=True, capacity_reported=True, source_type_count=5,
            affiliated_staff_presence=True, custom_logo_presence=True, number_of_facts_about_the_organization=9.0,
            coordinates_valid=True, district_resolved=True)


@pytest.mark.parametrize("change, strict, as_false", [
    ({}, [], []),
    ({"doctors_reported": False, "capacity_reported": False}, [0], [0]),
    ({"evidence_status": "likely", "doctors_reported": True, "capacity_reported": False}, [], []),
    ({"doctors_reported": None, "capacity_reported": False}, [], [0]),
    ({"capability": "ICU", "evidence_status": "likely", "source_type_count": 1}, [1], [1]),
    ({"capability": "Oncology", "source_type_count": 2}, [], []),
    ({"capability": "ICU", "source_type_count": None}, [], [1]),
    ({"affiliated_staff_presence": False, "custom_logo_presence": False, "number_of_facts_about_the_organization": 2.0}, [2], [2]),
    ({"affiliated_staff_presence": False, "custom_logo_presence": False, "number_of_facts_about_the_organization": 3.0}, [], []),
    ({"coordinates_valid": False}, [3], [3]),
    ({"coordinates_valid": None, "district_resolved": None}, [], [3, 4]),
    ({"evidence_status": "weak_signal", "capability": "ICU", "doctors_reported": False, "capacity_reported": False, "source_type_count": 1,
      "affiliated_staff_presence": False, "custom_logo_presence": False, "number_of_facts_about_the_organization": 1.0,
      "coordinates_valid": False, "district_resolved": False}, [3, 4], [3, 4]),
])
def test_rules(spark, change, strict, as_false):
    df = spark.createDataFrame([{**GOOD, **change}], FACTS)
    for mode, expected in (("strict", strict), ("as_false", as_false)):
        flags = rules.run_rules(df, mode).first()["validator_flags"]
        assert [f["rule"] for f in flags] == [rules.RULE_NAMES[i] for i in expected]
        assert [f["reason"] for f in flags] == [config.RULES[rules.RULE_NAMES[i]] for i in expected]


def test_orphans_stay_in_the_denominator(spark):
    evidence = spark.createDataFrame([("a", "ICU", "likely", True), ("gone", "ICU", "likely", None)],
                                     "unique_id string, capability string, evidence_status string, keyword_confirmed boolean")
    facilities = spark.createDataFrame([{**GOOD, "unique_id": "a", "coordinates_valid": False}], "unique_id string, " + FACTS)
    row = rules.validation_summary(evidence, facilities).first()
    assert (row["total_rows"], row["validator_flagged_rows"], row["validator_flag_rate_pct"]) == (2, 1, 50.0)
    assert row["keyword_confirmation"]["rate_pct"] == 50.0
    empty = rules.validation_summary(evidence.limit(0), facilities).first()
    assert (empty["total_rows"], empty["validator_flag_rate_pct"]) == (0, 0.0)
    with pytest.raises(gates.GateError, match="no_orphans: 1"):
        gates.enforce(gates.no_orphans(evidence, facilities, "unique_id"))


def _status(spark, counts):
    data = [(c, s) for (c, s), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "capability string, evidence_status string")


def test_degenerate_gate(spark):
    fine = {("ICU", s): 2 for s in config.STATUSES}
    gates.enforce(gates.not_degenerate(_status(spark, fine)))
    with pytest.raises(gates.GateError, match="every_status_per_group"):
        gates.enforce(gates.not_degenerate(_status(spark, {**fine, ("NICU", "likely"): 1})))
    edge = {("ICU", "verified"): 57, ("ICU", "likely"): 1, ("ICU", "weak_signal"): 1, ("ICU", "no_signal"): 1}
    with pytest.raises(gates.GateError, match="largest_status_share"):
        gates.enforce(gates.not_degenerate(_status(spark, edge)))  # exactly 0.95


def test_skew_gate_is_strict(spark):
    df = spark.createDataFrame([("a",)] * 85 + [("b",)] * 15, "coverage_status string")
    gates.enforce(gates.not_skewed(df))
    with pytest.raises(gates.GateError):
        gates.enforce(gates.not_skewed(df.unionAll(df.where("coverage_status = 'a'").limit(1))))


def test_domain_gate(spark):
    df = spark.createDataFrame([("verified", 101, None), ("odd", 5, "x")], "s string, p int, r string")
    got = {r["gate"]: (r["ok"], r["detail"]) for r in gates.domain(df, {"s": config.STATUSES}, {"p": (0, 100)}, ["r"]).collect()}
    assert got == {"domain_s": (False, "1"), "range_p": (False, "1"), "required_r": (False, "1")}


LINT = [
    ("verified", "It is verified. No flags. Confirm.", []),
    ("verified", "It is there. No flags. Confirm.", ["confidence_language"]),
    ("likely", "Likely yes. Certainly so. Confirm.", ["overconfident_language"]),
    ("weak_signal", "Limited evidence suggests it. Confirm.", []),
    ("no_signal", "No evidence. It is verified. Confirm.", ["overconfident_language"]),
    ("no_signal", "No evidence. One. Two. Confirm.", ["sentence_count"]),
    ("likely", "Likely yes. Confirm", ["confirm_message", "sentence_count"]),
]


def test_explanation_lint(spark):
    df = spark.createDataFrame([(i, s, t, "Confirm.") for i, (s, t, _) in enumerate(LINT)],
                               "i int, evidence_status string, explanation string, confirm_message string")
    out = explain.lint_explanations(df).orderBy("i").collect()
    assert [r["violations"] for r in out] == [v for _, _, v in LINT]


def test_completions(spark):
    texts = ['{"choices":[{"message":{"content":" hi "}}]}',
             '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"output_text","text":"b "}]}}]}',
             '{"choices":[]}', '{"choices":[{"message":{}}]}', "{}", '{"choices":[{"message":{"content":"[not a list"}}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    out = [(r["completion"], r["completion_error"]) for r in explain.extract_completion(df, "r").orderBy("i").collect()]
    assert out == [("hi", None), ("ab", None), (None, "no choices"), (None, "no text"), (None, "no choices"), ("[not a list", None)]
