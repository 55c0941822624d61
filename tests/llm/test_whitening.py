import numpy as np
import pytest

from groundcover.llm import feast, queries, whitening

KIND = "vec_id long, embedding array<float>, component int, n string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], KIND)


def brute(vectors, k=8):
    """(id, component) -> (n, deviation, whitened up to sign, explained), with numpy's own eigenvectors."""
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centred = x - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    out = {}
    for row, (i, _) in enumerate(kept):
        deviation = sum((n * int(c) - s) ** 2 for c, s in zip(x[row], sums))
        for j in range(min(k, x.shape[1])):
            e, u = values[-1 - j], axes[:, -1 - j]
            out[i, j + 1] = (n, deviation, centred[row] @ u / np.sqrt(e), e / np.trace(cov))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
def test_pairs_equal_those_of_numpy(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, 2 * size))
    values, axes = feast.largest_pairs(a @ a.T, 8)
    expected, vectors = np.linalg.eigh(a @ a.T)
    k = len(values)
    assert k == min(8, size)
    np.testing.assert_allclose(values, expected[::-1][:k], rtol=1e-12)
    np.testing.assert_allclose(np.abs((axes * vectors[:, ::-1][:, :k]).sum(axis=0)), 1, rtol=1e-10)


@pytest.mark.parametrize("spectrum", [[5] * 10 + [3] * 20 + [1] * 34, [1] * 64, 10.0 ** -np.arange(64), [1, 1, 1, 1 - 1e-13] + [0] * 60, [0] * 64])
def test_repeated_close_and_tiny_eigenvalues_are_all_found(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(64, 64)))
    matrix = (q * np.array(spectrum, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, axes = feast.largest_pairs(matrix, 8)
    largest = max(spectrum)
    np.testing.assert_allclose(values, sorted(spectrum)[::-1][:8], atol=1e-13 * max(largest, 1e-300))
    np.testing.assert_allclose(axes.T @ axes, np.eye(8), atol=1e-13)
    assert np.abs(matrix @ axes - axes * values).max() <= 1e-13 * max(largest, 1e-300)


def test_inertia_counts_eigenvalues_above_a_shift():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    counts = feast.Inertia(a + a.T)
    values = np.linalg.eigvalsh(a + a.T)
    for shift in rng.uniform(values[0] - 1, values[-1] + 1, 50):
        assert counts.above(shift) == (values > shift).sum()


def test_query_against_numpy(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = brute([tuple(r) for r in rows])
    got = queries.op11_whitening(spark, folder)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = got.collect()
    assert len(got) == len(expected) == 8 * len(rows)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - explained) < 1e-10 * explained
        if abs(whitened) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(whitened) == np.sign(r["whitened"]))
        assert abs(abs(r["whitened"]) - abs(whitened)) < 1e-8
        assert r["identity_error"] < 1e-10
    assert all(len(s) == 1 for s in signs.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=12).tolist()) for i in range(60)]
    good += [(None, good[0][1]), (3, good[3][1]), (3, good[3][1])]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, []), (102, [1.0] * 11 + [None]), (103, [nan] * 12), (104, [inf] + [0.0] * 11), (105, [1.0, 2.0])]
    got = whitening.whiten(table(spark, good + odd)).collect()
    expected = brute(good)
    assert len(got) == 8 * len(good)
    for r in got:
        n, deviation, whitened, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert abs(abs(r["whitened"]) - abs(whitened)) < 1e-8 and abs(r["explained"] - explained) < 1e-8


def test_few_equal_wide_and_no_vectors(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    equal = whitening.whiten(table(spark, [(1, [0.5] * 3), (2, [0.5] * 3)])).collect()
    assert sorted((r["vec_id"], r["component"], int(r["deviation"]), r["whitened"], r["explained"]) for r in equal) == [
        (i, c, 0, None, 0.0) for i in (1, 2) for c in (1, 2, 3)
    ]
    line = whitening.whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])).collect()
    assert {(r["vec_id"], r["component"]): r["whitened"] is None for r in line} == {(i, c): c == 2 for i in (1, 2) for c in (1, 2)}
    assert {round(abs(r["whitened"]), 9) for r in line if r["component"] == 1} == {1.0}
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {(r["vec_id"], r["deviation"] is None) for r in huge} == {(1, True), (2, True), (3, False)}  # 38 digits don't hold the first two


def test_deviations_of_every_size_are_exact():
    rng = np.random.default_rng(5)
    for reach, rows in ((500, 50), (500, 10**9), (10**6, 10**9), (2**61, 3)):
        x = rng.integers(-reach, reach, (40, 7))
        sums = [int(v) for v in rng.integers(-reach, reach, 7)]
        exact = [sum((rows * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        assert [None if v is None else int(v) for v in whitening.deviations(x, rows, sums).to_pylist()] == [v if v < 10**38 else None for v in exact]
