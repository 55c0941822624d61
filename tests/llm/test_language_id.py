import numpy as np

from groundcover.llm import language_id as l
from groundcover.llm.common import fold


TEXTS = {"aa": "abab abba baba aab", "xy": "xyxy yxyx xx yy xyy abab"}


def brute_probability(text, gram):
    """Interpolated Kneser-Ney by its definition; gram = symbol, then the symbols before it."""
    codes, _ = l.symbols([text])
    seen = [tuple(map(int, codes[:, i])) for i in range(codes.shape[1])]
    every = {s[0] for t in TEXTS.values() for s in zip(*l.symbols([t])[0].tolist())}
    vocabulary = len(every) + 1

    def prob(k, gram):
        if k < 0:
            return 1 / vocabulary
        if k == l.ORDER - 1:
            counts = {}
            for s in seen:
                counts[s] = counts.get(s, 0) + 1
        else:
            counts = {}
            for s in {s[: k + 2] for s in seen}:
                counts[s[: k + 1]] = counts.get(s[: k + 1], 0) + 1
        context = gram[1 : k + 1]
        own = {s: n for s, n in counts.items() if s[1:] == context}
        lower = prob(k - 1, gram)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(gram[: k + 1], 0) - l.DISCOUNT, 0) / total + l.DISCOUNT * len(own) / total * lower

    return prob(l.ORDER - 1, gram)


def test_probabilities_against_the_definition(spark, make_docs):
    """Through Spark, with shards and blocks of a few entries and texts."""
    words = ["abab", "xyyx", "zzab", "ba", "abx", "a", "yyyyyyyy", "bab"]
    docs = make_docs([(i, w) for i, w in enumerate(words)])
    trained = l.fit(make_docs([(i, text, name) for i, (name, text) in enumerate(TEXTS.items())]), shard_entries=7)
    assert trained.shards > 10 and trained.languages == sorted(TEXTS)
    found = {r["doc_id"]: r for r in l.entropies(docs, trained, block_chars=250).collect()}
    assert len(found) == len(words)
    for i, word in enumerate(words):
        grams, _ = l.symbols([word])
        for j, name in enumerate(trained.languages):
            expected = sum(np.log(brute_probability(TEXTS[name], tuple(map(int, g)))) for g in grams.T)
            assert abs(found[i]["entropy"][j] * -(len(word) + 1) - expected) < 1e-4


def test_texts_add_up_their_words(spark, make_docs):
    trained = l.fit(make_docs([(i, text, name) for i, (name, text) in enumerate(TEXTS.items())]))
    texts = ["abab, xyyx! abab", "ba", "", "12", "xyyx ba ba", "abab"]
    found = {r["doc_id"]: r for r in l.entropies(make_docs(list(enumerate(texts))), trained).collect()}
    assert [found[i]["size"] for i in range(6)] == [15, 3, 0, 0, 11, 5]
    for j in range(2):
        total = [found[i]["entropy"][j] * found[i]["size"] for i in range(6)]
        assert abs(total[0] + 2 * total[1] - total[4] - 2 * total[5]) < 1e-4


def test_words():
    assert [w for some in l.words("Ab1c  \u00e9-\u6f22\u5b57 x_y \u00b2") for w in some] == ["ab", "c", "\u00e9", "\u6f22\u5b57", "x", "y"]
    long = "word " * 100_000
    assert l.counted_words(long) == {"word": 100_000}
    assert [p for _, p in l.portions(["a" * 150_000, "b" * 150_000, "c"])] == [["a" * 150_000], ["b" * 150_000, "c"]]


def test_symbols():
    grams, owner = l.symbols(["Ab1c", "", "é"])
    assert owner.tolist() == [0, 0, 0, 0, 0, 2, 2]
    assert grams[0].tolist() == [97, 98, l.END, 99, l.END, 233, l.END]
    assert grams[:, 1].tolist() == [98, 97, l.BEGIN, l.BEGIN, l.BEGIN]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold(l.F.col("doc_id"), 3) == 1
    found = l.identify(docs.where(held_out).select("doc_id", "text"), l.train(docs.where(~held_out)))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [r["lang_pred"] == r["lang"] for r in rows if r["lang_pred"] != l.UNKNOWN]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_many_languages_keep_all_grams(spark, make_docs):
    """Twenty languages of the same letters: every gram of each is in the models, and each is told from the others."""
    rng = np.random.default_rng(5)
    rows = []
    for n in range(20):
        syllables = ["".join(rng.choice(list("aeioubdgklmnprst"), 3)) for _ in range(40)]
        for k in range(12):
            rows.append((n * 12 + k, " ".join("".join(rng.choice(syllables, 2)) for _ in range(80)), f"l{n:02}"))
    docs = make_docs(rows)
    counts = {(r["lang"], r["near"], r["far"]): r["n"] for r in l.gram_counts(docs).collect()}
    expected = {}
    for _, text, lang in rows:
        for g in map(tuple, l.symbols([text])[0].T.astype(np.int64).tolist()):
            key = lang, g[0] << 42 | g[1] << 21 | g[2], g[3] << 21 | g[4]
            expected[key] = expected.get(key, 0) + 1
    assert counts == expected
    held_out = l.F.col("doc_id") % 4 == 0
    trained = l.train(docs.where(~held_out))
    found = l.identify(docs.where(held_out), trained).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 60 and all(r["lang_pred"] == r["lang"] for r in found)


def test_odd_documents(spark, make_docs, odd_docs, no_docs):
    trained = l.train(make_docs([(1, "the cat", "en"), (2, "der hund", "de"), (3, None, "fr"), (4, "sans langue", None), (5, "123", "es")]))
    assert trained.languages == ["de", "en"]
    got = l.identify(odd_docs, trained).collect()
    assert len(got) == odd_docs.count()
    assert [r["lang_pred"] == "und" and r["score"] == 0 for r in got][:5] == [True, False, True, True, True]
    assert l.identify(no_docs, trained).count() == 0
    untrained = l.train(no_docs)
    assert untrained is None and {r["lang_pred"] for r in l.identify(odd_docs, untrained).collect()} == {"und"}
    strange = l.identify(make_docs([(1, "漢字かな交じり文"), (2, "the cat")]), trained).collect()
    assert not strange[0]["accepted"] and strange[1]["lang_pred"] == "en"


def test_calibrated_on_all_texts(spark, make_docs):
    """3,000 different texts, and one far from the others: the limits and the temperature are those of all, by the definition."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list("abde" if i % 2 else "bdxy"), 4)) for _ in range(4)), f"l{i % 2}") for i in range(3000)]
    docs = make_docs([*rows, (3000, "qqjzk wvvkq", "l1"), (3001, *rows[0][1:]), (3002, "no language", None), (3003, "12", "l0")])
    trained = l.train(docs)
    found = {r["doc_id"]: r for r in l.entropies(docs, trained).collect()}
    entropy, truth = np.array([found[i]["entropy"] for i in range(3001)]), np.array([i % 2 for i in range(3000)] + [1])
    place = {key: i for i, key in reversed([*enumerate([*[r[1:] for r in rows], ("qqjzk wvvkq", "l1")])])}
    first = sorted(place.values())
    entropy, truth = entropy[first], truth[first]
    own = entropy[np.arange(len(first)), truth]
    for j in range(2):
        assert abs(trained.limits[j] - (own[truth == j].mean() + 4 * own[truth == j].std() + 0.1)) < 1e-9
    losses = [np.log(np.exp((own[:, None] - entropy) / t).sum(axis=1)).mean() for t in np.geomspace(0.01, 2, 25)]
    assert trained.temperature == np.geomspace(0.01, 2, 25)[int(np.argmin(losses))]
    apart = docs.where("doc_id IS NULL OR doc_id % 5 > 0").select("doc_id", "text", "lang")
    both = l.identify(docs, l.train(apart))
    once = l.learn_and_identify(docs.select("doc_id", "text", "lang"), l.F.col("doc_id") % 5 > 0)

    def rounded(df):
        return sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9), r["accepted"]) for r in df.collect())

    assert rounded(once) == rounded(both) and len(rounded(once)) == 3004
