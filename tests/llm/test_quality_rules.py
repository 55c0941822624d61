import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from groundcover.llm import ngram_model, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ORDER = ngram_model.ORDER


def kneser_ney(texts):
    """log probability of a text by the definition of interpolated modified Kneser-Ney."""
    counts = {k: Counter() for k in range(1, ORDER + 1)}
    for text in map(ngram_model.plain, texts):
        padded = ngram_model.PAD * (ORDER - 1) + text
        counts[ORDER].update(padded[i : i + ORDER] for i in range(len(text)))
    for k in range(ORDER - 1, 0, -1):
        lefts = defaultdict(set)
        for gram in counts[k + 1]:
            lefts[gram[1:]].add(gram[0])
        counts[k] = Counter({g: len(s) for g, s in lefts.items()})
    discounts = {}
    for k, found in counts.items():
        n = Counter(found.values())
        ds = []
        for i in (1, 2, 3):
            d = i / 2
            if n[1] and n[2] and n[i] and n[i + 1]:
                value = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i]
                d = value if value > 0 else d
            ds.append(d)
        discounts[k] = ds
    followers = {k: defaultdict(dict) for k in counts}
    for k, found in counts.items():
        for gram, n in found.items():
            followers[k][gram[:-1]][gram[-1]] = n

    def p(context, char):
        k = len(context) + 1
        shorter = p(context[1:], char) if k > 1 else 1 / (len(counts[1]) + 1)
        after = followers[k].get(context)
        if not after:
            return shorter
        total = sum(after.values())
        d = [discounts[k][min(n, 3) - 1] for n in after.values()]
        own = max(after[char] - discounts[k][min(after[char], 3) - 1], 0) / total if char in after else 0
        return own + sum(d) / total * shorter

    def log_probability(text):
        if not counts[1]:
            return None
        padded = ngram_model.PAD * (ORDER - 1) + ngram_model.plain(text)
        return sum(math.log(p(padded[i : i + ORDER - 1], padded[i + ORDER - 1])) for i in range(len(padded) - ORDER + 1))

    return log_probability


def prose(n, seed, letters="abcdeé"):
    rng = random.Random(seed)
    syllables = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3]))) for _ in range(30)]
    return [" ".join("".join(rng.choices(syllables, k=rng.choice([1, 2, 3]))) for _ in range(rng.choice([1, 9, 30, 60]))) for _ in range(n)]


@pytest.mark.parametrize("block_chars, shard_entries", [(12_000_000, 50_000), (500, 40)])
def test_probabilities_by_the_definition(spark, block_chars, shard_entries):
    train = {"x": prose(40, 1) + ["Über 漢字 1234"], "y": prose(10, 2, "opqr")}
    tested = prose(15, 3) + prose(5, 4, "opqrxyz") + ["", "a", "漢漢字 99", "\x02 \x01"]
    docs = spark.createDataFrame([(t, m) for m, ts in train.items() for t in ts] + [("never counted", None), (None, "x")], "text string, model string")
    models = ngram_model.train(docs, "text", "model", block_chars, shard_entries)
    asked = spark.createDataFrame(
        [(i, t, m) for i, t in enumerate(tested) for m in ("x", "y", "none", None)], "id long, text string, other string"
    ).repartition(3, "id")
    got = ngram_model.score(asked.select("*"), models, "id", "text", "other", block_chars=block_chars).collect()
    assert len(got) == 4 * len(tested)
    definitions = {m: kneser_ney(ts) for m, ts in train.items()}
    for r in got:
        text = tested[r["id"]]
        assert r["chars"] == len(ngram_model.plain(text))
        if r["model"] in definitions:
            assert r["log_probability"] == pytest.approx(definitions[r["model"]](text), rel=1e-5, abs=1e-5)
        else:
            assert r["log_probability"] is None


def test_probabilities_of_a_context_add_up_to_one():
    texts = prose(30, 6)
    log_p = kneser_ney(texts)
    letters = sorted(set("".join(map(ngram_model.plain, texts))))
    start = ngram_model.plain(texts[5])[:6]
    shares = [math.exp(log_p(start + c) - log_p(start)) for c in letters if c != " "]
    shares += [math.exp(log_p(f"{start} {c}") - log_p(start)) for c in letters if c != " "]
    assert sum(shares) < 1  # one letter more is possible: one never seen


def test_pieces_hold_every_place_once(monkeypatch):
    monkeypatch.setattr(ngram_model, "PIECE_CHARS", 50)
    texts = prose(20, 5) + [""]
    block = ngram_model.Block([], ["m"] * len(texts), texts, [], 0)
    (rows, _, parts), = ngram_model.counted_grams(block)
    found = Counter((int(t), grams[n]) for grams, number, of_text in parts for n, t in zip(number, of_text))
    expected = Counter()
    for i, text in enumerate(texts):
        padded = ngram_model.PAD * (ORDER - 1) + text
        expected.update((i, padded[j : j + ORDER]) for j in range(len(text)))
    assert found == expected and len(parts) > 3


@pytest.mark.parametrize("dense", [1 << 24, 4])
def test_numbering_with_and_without_a_table(monkeypatch, dense):
    monkeypatch.setattr(ngram_model, "DENSE", dense)
    codes = np.array([5, 1, 5, 9, 1, 1], np.int64)
    kinds, number = ngram_model._numbered(codes)
    assert kinds == 3 and number.tolist() == [1, 0, 1, 2, 0, 0]
    assert ngram_model._numbered(codes[:0])[0] == 0


def test_words_of_any_script_and_blank():
    for blank in map(chr, [*range(33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]):
        for text in (f"a{blank}b c", f"{blank}漢 é{blank}", blank):
            assert ngram_model.words_of(text) == WORD.findall(text)
    assert ngram_model.plain("A\x02 1\n 29Ü ") == "a\x01 0 00ü"


def measured(text):
    """The five measures as they are defined."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(hit),
    )


def test_measures_by_the_definition(spark):
    rng = random.Random(8)
    texts = ["", None, " \n ", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 9, "x\n\nx \nx\n", "<a> #1 * $2 %3 & |", "é\x1cé 漢　字\x85z"]
    texts += ["\n".join(" ".join(rng.choices("ab", k=rng.choice([0, 1, 4, 12]))) for _ in range(20)) for _ in range(30)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert quality_rules.measures(text) == measured(text)


def test_bands_by_the_definition(spark):
    rng = random.Random(4)
    rows = [(lang, round(rng.gauss(2, w), 2), False) for lang, w in (("a", 0.3), (None, 0.01)) for _ in range(101)]
    rows += [("a", 9.0, True), ("a", None, False)]
    scored = spark.createDataFrame(rows, "lang string, log_perplexity double, base_failed boolean")
    got = {r["m_lang"]: (r["low"], r["high"]) for r in quality_rules.bands(scored).collect()}
    assert set(got) == {"a", None}
    for lang in got:
        values = np.array([v for k, v, f in rows if k == lang and not f and v is not None])
        middle = np.median(values)
        reach = max(6 * 1.4826 * np.median(np.abs(values - middle)), 1.0)
        assert got[lang] == pytest.approx((middle - reach, middle + reach))


def test_other_languages_and_noise_are_rejected(spark, make_docs):
    good = [(i, t, "en") for i, t in enumerate(prose(200, 1, "abcdefgh")) if len(t) > 100]
    alphabets = ["rstuvwxyz", "αβγδεζηθ", "абвгдежз", "0#%&*+=~", "٠١٢٣٤٥٦٧"]  # one text of each
    other = [(1000 + i, max(prose(30, 2, letters), key=len), "en") for i, letters in enumerate(alphabets)]
    got = {r["doc_id"]: r for r in quality_rules.check(make_docs(good + other)).collect()}
    assert sum(got[i]["kept"] for i, _, _ in good) > 50
    assert all(got[i]["kept"] != got[i]["base_failed"] for i, _, _ in good)
    rest = [got[i] for i, _, _ in other if not got[i]["base_failed"]]
    assert rest and not any(r["kept"] for r in rest)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    got = quality_rules.check(odd_docs)
    found = sorted(((r["doc_id"], r["lang"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in got.collect()), key=repr)
    assert found == sorted(((i, lang, *measured(t)) for i, t, lang in docs), key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got.collect())
    assert quality_rules.check(no_docs).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op13_quality_rules(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        m = measured(texts[r["doc_id"]])
        assert tuple(r)[1:6] == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r["kept"] and r["base_failed"])
    passed = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) >= 0.95 * len(passed)
