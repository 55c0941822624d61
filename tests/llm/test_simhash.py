import random

import numpy as np
import pandas as pd
import xxhash

from groundcover.llm import components, simhash as s


def brute_print(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(items, near):
    """Smallest item of each one's group."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in items}


def rows_with_copies():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 5, rng.choice([" ", "\n", "\t "]).join(changed)))
    rng.shuffle(rows)
    return rows


def test_fingerprints_and_components_against_brute_force(make_docs):
    rows = rows_with_copies() + [(1, None), (2, ""), (3, " \n\x0b"), (None, "lonely text without an id"), (9, "É One two"), (9, "É One two")]
    got = s.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    prints = {(i, brute_print(t, 4)) for i, t in rows}
    assert {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in got} == prints
    groups = brute_groups(sorted({fp for _, fp in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, fp in prints:
        if i is not None:
            least[groups[fp]] = min(i, least.get(groups[fp], i))
    for r in got:
        assert r["component_id"] == least.get(groups[r["fp"] & (2**64 - 1)]), r
    assert len({r["component_id"] for r in got}) < len(rows) * 0.8


def test_variants_link_all_near_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:100].copy()
    for _ in range(5):
        near ^= np.where(rng.random(100) < 0.7, np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64), np.uint64(0))
    dense = base[0] ^ s.MASKS[rng.integers(0, s.VARIANTS, 60)]
    prints = np.unique(np.concatenate([base, near, dense]))
    expected = brute_groups(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    for hash_bits, buckets in ((40, 3), (27, 2), (30, 700)):  # few bits: points that share a hash are told apart
        rows = pd.concat(s._packer(hash_bits, buckets)(iter([pd.DataFrame({"fp": prints.view(np.int64)})])))
        links = pd.concat([s._linker(hash_bits)(g) for _, g in rows.groupby("bucket")])
        pairs = {(a & (2**64 - 1), b & (2**64 - 1)) for a, b in links.itertuples(index=False)}
        nodes = sorted({*prints.tolist(), *(x for p in pairs for x in p)})
        linked = {(min(p), max(p)) for p in pairs}
        root = brute_groups(nodes, lambda a, b: (min(a, b), max(a, b)) in linked) if len(nodes) < 3000 else None
        assert root is not None
        by_root = {}
        for x in prints.tolist():
            by_root.setdefault(root[x], []).append(x)
        assert sorted(map(sorted, by_root.values())) == sorted(
            sorted(x for x in expected if expected[x] == r) for r in set(expected.values())
        )


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(3, 3), (7, 1000), (-5, 160)]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: -5 for i in range(100, 161)}, **{i: 7 for i in range(1000, 1100)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(make_docs, odd_docs, no_docs):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (8, "another text that is not near at all"), (None, "q r s t u v w x"), (None, "q r s t u v w x")]
    docs = make_docs(rows)
    kept = s.one_of_each(docs, width=5)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0, r["text"][:3]) for r in kept.collect()) == [(0, "q r"), (3, "a b"), (8, "ano")]
    # NULL, empty and blank texts are one group, the repeated rows another.
    assert s.one_of_each(odd_docs).count() == odd_docs.count() - 4
    assert s.one_of_each(no_docs).count() == 0 and s.near_duplicates(no_docs).count() == 0


def test_text_ids_and_long_texts(spark, make_docs):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [("b", long), ("a", long + " end"), ("c", "a short one"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert s.fingerprint(long) == brute_print(long, 4)
    assert {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c", None: "a"}
    assert sorted(r["doc_id"] for r in s.one_of_each(docs).collect()) == ["a", "c"]


def test_one_row_of_each_brute_force_group_stays(make_docs):
    rows = list({i: t for i, t in rows_with_copies()}.items())
    prints = {i: brute_print(t, 4) for i, t in rows}
    groups = brute_groups(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, fp in prints.items():
        least[groups[fp]] = min(i, least.get(groups[fp], i))
    assert sorted(r["doc_id"] for r in s.one_of_each(make_docs(rows)).collect()) == sorted(least.values())


def test_a_fingerprint_sends_little_however_many_there_are():
    prints = np.random.default_rng(5).integers(0, 2**63, 2 * s.BLOCK, dtype=np.uint64)

    def sent(n):
        """Bytes per fingerprint if there are n in all."""
        hash_bits, buckets = (n * s.VARIANTS).bit_length() + s.HASH_SLACK, -(-n * s.VARIANTS // s.BUCKET_ENTRIES)
        rows = pd.concat(s._packer(hash_bits, buckets)(iter([pd.DataFrame({"fp": prints.view(np.int64)})])))
        return sum(20 + sum(len(v) for v in r if isinstance(v, bytes)) for r in rows.itertuples(index=False)) / len(prints)

    # 0.5, 6 and 30 GB of the test tables' documents, each about 2,000 bytes
    assert sent(235_000) < 500 and sent(2_800_000) < 1000 and sent(14_000_000) < 1000


def test_near_copies_of_one_text_are_dealt_to_many_buckets():
    flips = (np.random.default_rng(6).random((50_000, 64)) < 0.03) << np.arange(64, dtype=np.uint64)
    prints = np.unique(np.uint64(0x123456789ABCDEF0) ^ flips.sum(axis=1, dtype=np.uint64))
    rows = pd.concat(s._packer(39, 2048)(iter([pd.DataFrame({"fp": prints.view(np.int64)})])))
    made = dict.fromkeys(range(2048), 0)
    for bucket, rest, some in rows[["bucket", "rest", "prints"]].itertuples(index=False):
        masks = s._masks_by_fold(39 - rest)
        made[bucket] += sum(len(masks[f]) for f in (s._folds(np.frombuffer(some, np.uint64), 39 - rest) ^ bucket).tolist())
    total = sum(made.values())
    assert total == len(prints) * s.VARIANTS and max(made.values()) < 0.006 * total


def test_links_of_many_buckets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_ENTRIES", 10_000)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 250, dtype=np.uint64)
    near = base[:100] ^ s.MASKS[rng.integers(0, s.VARIANTS, 100)] ^ s.MASKS[rng.integers(0, s.VARIANTS, 100)]
    dense = base[0] ^ s.MASKS[rng.integers(0, s.VARIANTS, 60)]
    prints = np.unique(np.concatenate([base, near, dense]))
    docs = spark.createDataFrame([(x,) for x in prints.view(np.int64).tolist()], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(s.links(docs)).collect()}
    found, expected = {}, {}
    for x, least in brute_groups(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 4).items():
        signed = int(np.uint64(x).view(np.int64))
        found.setdefault(roots.get(signed, signed), set()).add(x)
        expected.setdefault(least, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))
