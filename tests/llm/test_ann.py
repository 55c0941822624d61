import math

import numpy as np

from groundcover.llm import ann

KIND = "vec_id long, embedding array<float>"


def brute(rows, query_id, k=5):
    vectors = {i: [float(x) for x in v] for i, v in rows}
    q = vectors[query_id]
    scores = []
    for i, v in vectors.items():
        if i != query_id:
            dot = sum(a * b for a, b in zip(q, v))
            scores.append((-dot / (math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(b * b for b in v))), i))
    return sorted(scores)[:k]


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = {}
    for r in ann.nearest(vectors, ann.F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert len(got) == sum(i % 50 == 0 for i, _ in rows)
    hits = 0
    for query_id, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        expected = dict((i, -s) for s, i in brute(rows, query_id))
        hits += len(expected.keys() & {i for i, _ in found.values()})
        for i, score in found.values():
            if i in expected:
                assert abs(score - expected[i]) < 1e-12
    assert hits / len(got) / 5 >= 0.95


def test_small_forest_finds_most():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = ann._unit(np.repeat(centres, 100, axis=0) + 0.3 * rng.normal(size=(4000, 16)))
    forest = ann.Forest(rows, 8, 50)
    leaves = [t.assign(rows) for t in forest.trees]
    hits = seen = 0
    for i in range(0, 4000, 97):
        near = set(np.argsort(-rows @ rows[i])[1:6].tolist())
        found = set()
        for tree, leaf in forest.probe(rows[i], 24):
            found |= set(np.flatnonzero(leaves[tree] == leaf).tolist())
        hits, seen = hits + len(near & found), seen + len(found)
    assert hits / (5 * len(range(0, 4000, 97))) >= 0.9
    assert seen < 0.3 * 4000 * len(range(0, 4000, 97))


def test_copies_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1, 60)] + [(100, [2.0, 0.0, 0.0]), (150, [0.0, 1.0, 0.0]), (151, [0.0, 3e38, 0.0])]
    bad = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, nan, 0.0]), (204, [inf, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([*rows, *rows[:9], *bad, (250, [1.0, 1.0]), (205, [1.0, None, 0.0])], KIND).withColumn("ids", ann.F.lit("clash"))
    got = ann.nearest(frame, ann.F.col("vec_id") % 50 == 0).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert by_query == {
        50: [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0)],
        100: [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0)],
        150: [(151, 1.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)],
    }


def test_empty_and_lonely_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert ann.nearest(empty, ann.F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(50, [1.0, 2.0])], KIND), ann.F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(50, [1.0, 2.0]), (51, [2.0, 1.0])], KIND)
    assert [(r["vec_id"], r["rank"]) for r in ann.nearest(two, ann.F.col("vec_id") % 50 == 0).collect()] == [(51, 1)]
