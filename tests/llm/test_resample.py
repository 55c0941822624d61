import hashlib
import math
import random
import re
import zlib

import pytest
from groundcover.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_run):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target, max_run=1, least=20, percent=10):
    """[(id, n_words, n_features, weight, score, rank)]"""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text, max_run)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        words, found = features(text, max_run)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for rank, row in enumerate(order[: percent * len(order) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "漢字", "A-B"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 40, 120]))) for _ in range(n)]


@pytest.mark.parametrize("max_run", [1, 3])
def test_scores_and_ranks_against_brute_force(spark, make_docs, max_run):
    rows = list(enumerate(texts(300, 1)))
    target = texts(20, 2)
    got = resample.resample(
        make_docs(rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, max_run=max_run, segment_rows=16
    )
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert collected(got) == brute(rows, target, max_run, percent=30)


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(None,), ("",), ("word same",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = resample.resample(odd_docs, target, percent=100, least_words=2)
    assert collected(got) == brute(docs, ["word same"], least=2, percent=100)
    assert resample.resample(no_docs, target).collect() == []
    assert collected(resample.resample(odd_docs, target.limit(0))) == brute(docs, [])


@pytest.mark.parametrize("size", [10, 5_000])
def test_words_of_very_long_texts_go_on_from_list_to_list(monkeypatch, size):
    monkeypatch.setattr(resample, "LONG_BYTES", 1000)
    monkeypatch.setattr(resample, "LONG_WORDS", 7)
    text = " ".join(f"Word{i * i % 97}é" for i in range(size))
    parts = list(resample.word_buckets(text, 3, 10000))
    words, expected = features(text, 3)
    assert sum(n for n, _ in parts) == len(words)
    assert sorted(b for _, found in parts for b in found.tolist()) == sorted(expected)


@pytest.mark.parametrize("number", [0, 1, 199, 640, 2000])
def test_ranks_with_ties_repeats_and_missing_ids(spark, number):
    """A third of the rows is one row; they spread over segments and still get consecutive ranks."""
    rng = random.Random(3)
    rows = [(7, 5)] * 700 + [(None, 5)] * 20 + [(2**60 + i % 50, rng.randrange(9)) for i in range(1280)]
    rng.shuffle(rows)
    scored = spark.createDataFrame(rows, "doc_id long, score long").repartition(7)
    got = resample.draw(scored, number, len(rows), segment_rows=100)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0]))
    expected = [(*r, n if n <= number else None) for n, r in enumerate(order, 1)]
    assert collected(got) == sorted(expected, key=repr)


def test_hot_rows_spread_over_segments(spark):
    scored = spark.createDataFrame([(7, 5)] * 2000, "doc_id long, score long").repartition(5)
    runs = resample.sorted_runs(scored, "score", "doc_id")
    cuts = resample.splitters(runs, "score", "doc_id", 2000, 100)
    sizes = [r["count"] for r in resample.in_segments(runs, "score", "doc_id", cuts, "segment").groupBy("segment").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 300
