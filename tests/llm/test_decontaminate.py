import random
import re

import pytest

from groundcover.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, width):
    found = WORD.findall(lowered(text))
    hit, owners = set(), set()
    for item_id, item in items:
        words = WORD.findall(lowered(item))
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            for at in range(len(found) - size + 1):
                if found[at : at + size] == words[i : i + size]:
                    hit.update(range(at, at + size))
                    owners.add("null" if item_id is None else str(item_id))
    return len(found), len(hit), len(owners), sorted(owners), bool(hit)


ITEMS = [(1, "One two three four, five six."), (10, "two THREE four"), (2, "solo"), (3, None), (4, "--"), (None, "a b c d"), (5, "one two three four five six"), (1, "é ß c")]


@pytest.mark.parametrize("shard_words", [1_000_000, 5])
def test_against_brute_force(spark, make_docs, shard_words):
    rng = random.Random(3)
    vocabulary = ["one", "two", "Three", "four", "FIVE", "six", "solo", "a", "b", "c", "d", "é", "ß", "x-y"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(120)]
    rows += [(500, "one two three four five six"), (500, "one two three four five six"), (None, None), (501, "")]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.contamination(make_docs(rows), benchmark, 4, shard_words).collect()
    for (_, text), row in zip(rows, got):
        assert tuple(row)[1:] == brute(text, ITEMS, 4), text


def test_offsets_point_into_the_original(spark, make_docs):
    text = "İ Ü, see: TWO -- three;\nFour! and two three four five six"
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    places = [(r["start"], r["end"]) for r in d.hit_offsets(make_docs([(1, text), (2, None)]), benchmark).collect()]
    assert [text[a:b] for a, b in places] == ["TWO -- three;\nFour", "two three four"]


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(odd_docs, nothing).where("contaminated OR n_hit > 0").count() == 0
    assert d.contamination(no_docs, nothing).count() == 0
    one = spark.createDataFrame([(1, "word word")], "item_id long, text string")
    kept = d.without_contaminated(odd_docs, one)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert kept.count() == odd_docs.count() - 1
