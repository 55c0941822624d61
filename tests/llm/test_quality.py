import numpy as np
import pytest

from groundcover.llm import quality as q
from groundcover.llm.common import fold


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")
    return docs, labels


def test_held_out_documents(spark, tables):
    docs, labels = tables
    held_out = fold(q.F.col("doc_id"), 5) == 0
    model = q.train(docs, labels.where(~held_out))
    rows = q.score(docs, model).join(labels.where(held_out), "doc_id").collect()
    right = [(r["score"] >= q.THRESHOLD) == (r["label"] == 1) for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) >= 0.95
    good = [r["score"] >= q.THRESHOLD for r in rows if r["label"] == 1]
    assert sum(good) / len(good) >= 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    passages, begins, labels = rng.normal(size=(9, q.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    w = {
        "mean": np.zeros(q.FEATURES), "spread": np.ones(q.FEATURES), "E": rng.normal(size=(q.FEATURES, q.HIDDEN)) / 10,
        "e": rng.normal(size=q.HIDDEN), "V": rng.normal(size=(q.HIDDEN, q.GATE)), "U": rng.normal(size=(q.HIDDEN, q.GATE)),
        "a": rng.normal(size=q.GATE), "c": rng.normal(size=q.HIDDEN), "b": np.array(0.3),
    }

    def loss():
        z = q._forward(w, passages, begins)["logit"]
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - labels) * z))

    grads = q._gradients(w, q._forward(w, passages, begins), labels)
    for name, place in (("E", (3, 4)), ("e", (2,)), ("V", (1, 2)), ("U", (5, 3)), ("a", (6,)), ("c", (7,)), ("b", ())):
        old = float(w[name][place])
        w[name][place] = old + 1e-5
        up = loss()
        w[name][place] = old - 1e-5
        down = loss()
        w[name][place] = old
        assert grads[name][place] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_every_word_is_in_one_passage():
    for n in (1, 63, 64, 65, 300):
        text = " ".join(f"w{i}," for i in range(n))
        rows = q.encode(text)
        assert len(rows) == -(-n // q.PASSAGE_WORDS)
        assert round(float(rows[:, 102].sum() * q.PASSAGE_WORDS)) == n
    assert q.encode("").shape == q.encode("  \n ").shape == (1, q.FEATURES)


def test_odd_documents(spark, tables, odd_docs, no_docs):
    model = q.train(*tables)
    rows = q.score(odd_docs, model, "a_score").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["a_score"] <= 1 for r in rows)
    assert q.score(no_docs, model, "a_score").count() == 0
    labels = spark.createDataFrame([(6, 1), (6, 1), (7, None), (None, 0), (4, 1)], "doc_id long, label int")
    assert {r["a_score"] for r in q.score(odd_docs, q.train(odd_docs, labels), "a_score").collect()} == {1.0}
    assert {r["a_score"] for r in q.score(odd_docs, q.train(no_docs, labels.limit(0)), "a_score").collect()} == {0.5}
    both = labels.union(spark.createDataFrame([(6, 0), (1, 0), (2, 0)], "doc_id long, label int"))
    assert q.score(odd_docs, q.train(odd_docs, both), "a_score").where("a_score BETWEEN 0 AND 1").count() == odd_docs.count()
