"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased words of letters; a word's characters are predicted from up to four before them,
with marks at its begin and end. Per language, counts of the 5-grams of all training texts
give an interpolated Kneser-Ney model. A text gets the language with the lowest cross-entropy per character.

Spark counts the grams of all training texts, derives the continuation counts of the shorter ones from all of them, and
interpolates order by order. The models of all languages lie side by side in sorted hash arrays (64-bit hash of a gram or context,
language, logarithm), dealt by hash to shards of about SHARD_ENTRIES, one row each. They grow with the corpus, are never in one
place, and no gram is dropped.

Scoring goes by blocks of texts of about BLOCK_CHARS, fewer if they have many different words. A word's probability depends on the word alone, so a block is its distinct words
and, per text, how often it has each. A block asks every shard for the grams of its words; the answers (no more than those grams' entries)
meet the block again, each distinct word is scored once, and the texts add up their words.

The score is a softmax of the cross-entropies at a temperature fitted on all training texts, copies once;
`accepted` is false where the score is under 0.5 or the best cross-entropy is above what the training texts
of its language show. `learn_and_identify` scores texts that are both learned from and answered only once.

Defined cases: NULL texts and texts without a letter get `und` with score 0; texts and languages that are NULL
don't train; without training texts every language is `und`; repeated rows count and are answered
each; ties go to the first language by name; a run of over PORTION letters without a blank is taken in pieces.
"""

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundcover.llm.common import bounded_batches, slices
from groundcover.session import materialize

ORDER = 5
DISCOUNT = 0.75
TEMPERATURES = np.geomspace(0.01, 2, 25)
ACCEPTED = 0.5
UNKNOWN = "und"
PORTION = 200_000  # letters at a time, about 40 MB
HELD_WORDS = 200_000  # distinct words that a task counts before it passes them on
BLOCK_CHARS = 16_000_000
BLOCK_LETTERS = 2_000_000  # of the distinct words of a block
SHARD_ENTRIES = 50_000
BLOCKS_PER_TASK = 2_000  # whose questions to a shard one task answers
BEGIN, END = 1, 2
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)  # odd 64-bit numbers without relation
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER, n) codes of each predicted character and those before it, and the text of each."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = _letters()[codes]
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1]
    keep = letter | after  # letters, and the place after each word
    line = np.where(letter, codes, END)[keep].astype(np.uint64)
    first = np.ones(len(line), bool)
    first[1:] = line[:-1] == END
    at = np.arange(len(line))
    within = at - np.maximum.accumulate(np.where(first, at, 0)) if len(line) else at
    grams = np.full((ORDER, len(line)), BEGIN, np.uint64)
    grams[0] = line
    for back in range(1, ORDER):
        grams[back, back:] = np.where(within[back:] >= back, line[:-back], BEGIN)
    return grams, owner[keep]


def words(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, a slice of the text at a time."""
    for piece in slices(text, PORTION):
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        apart = np.where(_letters()[codes], codes, np.uint32(32))
        yield apart.tobytes().decode("utf-32-le", "surrogatepass").split()


def counted_words(text: str) -> Counter[str]:
    found: Counter[str] = Counter()
    for some in words(text):
        found.update(some)
    return found


def portions(some: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Lists of words of about PORTION letters, and the place of the first; a letter takes about 200 bytes in `symbols`."""
    start = size = 0
    for place, word in enumerate(some):
        if size and size + len(word) > PORTION:
            yield start, some[start:place]
            start, size = place, 0
        size += len(word) + 1
    if start < len(some):
        yield start, some[start:]


def hashes(grams: np.ndarray) -> np.ndarray:
    """(ORDER, n): row k is the hash of the k + 1 nearest symbols."""
    with np.errstate(over="ignore"):
        return np.cumsum(grams * _FACTORS[:, None], axis=0, dtype=np.uint64)


def whole_hash(grams: np.ndarray) -> np.ndarray:
    """The last row of `hashes`."""
    out = np.zeros(grams.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for symbol, factor in zip(grams, _FACTORS):
            out += symbol * factor
    return out


def keys_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER, n) keys of the grams of each order, and of their contexts (without the predicted symbol)."""
    hashed = hashes(grams)
    with np.errstate(over="ignore"):
        salt = np.arange(1, ORDER + 1, dtype=np.uint64)[:, None] * _SALT
        return (hashed + salt).view(np.int64), (hashed - grams[0] * _FACTORS[0] - salt).view(np.int64)


def distinct_grams(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 5-grams of words; for each predicted character which one it is, and its word."""
    grams, owner = symbols(some)
    _, first, place = np.unique(whole_hash(grams), return_index=True, return_inverse=True)
    return grams[:, first], place, owner


# --- training ---


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """5-grams of a task's texts with their counts, per language."""
    held: dict[str, Counter[str]] = {}

    def grams() -> Iterator[pd.DataFrame]:
        for language, found in held.items():
            counts = np.fromiter(found.values(), np.int64, len(found))
            for start, some in portions(list(found)):
                found_grams, place, owner = distinct_grams(some)
                weights = np.bincount(place, counts[start + owner], found_grams.shape[1])
                yield _rows(language, found_grams, weights.astype(np.int64))

    for batch in batches:
        for language, text in zip(batch["lang"], batch["text"]):
            held.setdefault(language, Counter()).update(counted_words(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from grams()
                held.clear()
    yield from grams()


def _rows(language: str, grams: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    near = grams[0] << np.uint64(42) | grams[1] << np.uint64(21) | grams[2]
    far = grams[3] << np.uint64(21) | grams[4]
    return pd.DataFrame({"lang": language, "near": near.astype(np.int64), "far": far.astype(np.int64), "n": counts})


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, near, far, n): 5-grams packed in 21 bits a symbol, the predicted one first, over all texts with a language."""
    bounded_batches(docs.sparkSession)
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counted = known.mapInPandas(_counter, "lang string, near long, far long, n long")
    return counted.groupBy("lang", "near", "far").agg(F.sum("n").alias("n"))


def _shortened(k: int) -> tuple:
    """(near, far) of a gram's `k` nearest symbols; the others become 0, which no symbol is."""
    near, far = F.col("near"), F.col("far")
    if k <= 3:
        off = 21 * (3 - k)
        return F.shiftleft(F.shiftright(near, off), off).alias("near"), F.lit(0).cast("long").alias("far")
    off = 21 * (ORDER - k)
    return near, F.shiftleft(F.shiftright(far, off), off).alias("far")


@dataclass
class Models:
    """`table`: (shard, keys, langs, logs), one row per shard, sorted by key and language.

    The log of a gram is that of its probability, the log of a context that of the weight of shorter ones after it.
    """

    languages: list[str]
    vocabulary: int
    table: DataFrame
    shards: int
    temperature: float = 1.0
    limits: np.ndarray = field(default_factory=lambda: np.array([]))

    def calibrate(self, found: DataFrame) -> None:
        """Temperature of least log loss; limits at four deviations above a language's mean.

        `found` has (lang, entropy) of texts with a letter: their language, and their cross-entropy in each one.
        """
        self.limits = np.full(len(self.languages), np.inf)
        number = {name: i for i, name in enumerate(self.languages)}

        @F.pandas_udf("own double, losses array<double>")
        def measured(lang: pd.Series, entropy: pd.Series) -> pd.DataFrame:
            """Cross-entropy in a text's own language, and log loss at each temperature."""
            every = np.array(entropy.tolist()).reshape(-1, len(number))
            own, best = every[np.arange(len(every)), lang.map(number).to_numpy(int)], every.min(axis=1)
            losses = [(own - best) / t + np.log(np.exp((best[:, None] - every) / t).sum(axis=1)) for t in TEMPERATURES]
            return pd.DataFrame({"own": own, "losses": np.stack(losses, axis=1).tolist()})

        known = found.where(F.col("lang").isin(self.languages)).select("lang", measured("lang", "entropy").alias("m"))
        totals = [F.sum(F.col("m.losses")[i]).alias(f"t{i}") for i in range(len(TEMPERATURES))]
        own = F.col("m.own")
        rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("std"), *totals).collect()
        if not rows:
            return
        rows.sort(key=lambda r: r["lang"])
        losses = [sum(r[f"t{i}"] for r in rows) for i in range(len(TEMPERATURES))]
        self.temperature = float(TEMPERATURES[int(np.argmin(losses))])
        for r in rows:
            self.limits[number[r["lang"]]] = r["mean"] + 4 * r["std"] + (0.1 if r["n"] > 1 else 0.5)


def fit(docs: DataFrame, shard_entries: int = SHARD_ENTRIES) -> Models | None:
    """Models of the languages in (text, lang), not calibrated; None without any text with a letter."""
    longer = materialize(gram_counts(docs), "grams")
    levels = [longer.select("lang", F.lit(ORDER).alias("k"), "near", "far", "n")]
    for k in range(ORDER - 1, 0, -1):
        level = levels[-1].select("lang", *_shortened(k)).groupBy("lang", "near", "far").agg(F.count(F.lit(1)).alias("n"))
        levels.append(level.select("lang", F.lit(k).alias("k"), "near", "far", "n"))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    around = F.col("near").bitwiseAND(F.lit((1 << 42) - 1))
    of_context = Window.partitionBy("lang", "k", "around", "far")  # as many rows as letters go on from it
    total = F.sum("n").over(of_context)
    shares = materialize(
        counts.withColumn("around", around).select(
            "lang", "k", "near", "far", "around",
            ((F.col("n") - DISCOUNT) / total).alias("own"), (DISCOUNT * F.count(F.lit(1)).over(of_context) / total).alias("weight"),
        ),
        "shares",
    )
    single = shares.where("k = 1")
    languages = sorted(r["lang"] for r in single.select("lang").distinct().collect())
    if not languages:
        return None
    vocabulary = single.select("near").distinct().count() + 1
    orders = [single.select("lang", "k", "near", "far", (F.col("own") + F.col("weight") / vocabulary).alias("p"))]
    for k in range(2, ORDER + 1):
        lower = orders[-1].select("lang", F.col("near").alias("near_"), F.col("far").alias("far_"), F.col("p").alias("lower"))
        near, far = _shortened(k - 1)
        here = shares.where(F.col("k") == k).withColumns({"near_": near, "far_": far})
        p = (F.col("own") + F.col("weight") * F.col("lower")).alias("p")
        orders.append(here.join(lower, ["lang", "near_", "far_"]).select("lang", "k", "near", "far", p))
    contexts = shares.groupBy("lang", "k", F.col("around").alias("near"), "far").agg(F.max("weight").alias("p"))
    logs = contexts.withColumn("gram", F.lit(False))
    for order in orders:
        logs = logs.unionByName(order.withColumn("gram", F.lit(True)))
    number = {name: i for i, name in enumerate(languages)}

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = (1 << 21) - 1
        for frame in frames:
            near, far = frame["near"].to_numpy(), frame["far"].to_numpy()
            grams = np.stack([near >> 42, near >> 21 & low, near & low, far >> 21, far & low]).astype(np.uint64)
            of_gram, of_context = keys_of(grams)
            row, at = frame["k"].to_numpy() - 1, np.arange(len(frame))
            key = np.where(frame["gram"].to_numpy(), of_gram[row, at], of_context[row, at])
            yield pd.DataFrame({"key": key, "lang": frame["lang"].map(number), "log": np.log(frame["p"].to_numpy())})

    entries = materialize(logs.mapInPandas(keyed, "key long, lang int, log float"), "entries")
    shards = max(1, -(-entries.count() // shard_entries))
    arrays = entries.groupBy(F.pmod("key", F.lit(shards)).cast("int").alias("shard")).agg(
        F.array_sort(F.collect_list(F.struct("key", "lang", "log"))).alias("e")
    )
    table = arrays.select("shard", F.col("e.key").alias("keys"), F.col("e.lang").alias("langs"), F.col("e.log").alias("logs"))
    return Models(languages, vocabulary, materialize(table, "model"), shards)


def _with_truth(docs: DataFrame, learned: Column) -> DataFrame:
    """`lang` and a hash of language and text, `copy`, of the rows that are learned from; NULL in the others."""
    learned = learned & F.col("text").isNotNull() & F.col("lang").isNotNull()
    return docs.withColumns({"copy": F.when(learned, F.xxhash64("lang", "text")), "lang": F.when(learned, F.col("lang"))})


def train(docs: DataFrame) -> Models | None:
    """Calibrated models of the languages in (text, lang); None without any text with a letter."""
    models = fit(docs)
    if models is None:
        return None
    labelled = _with_truth(docs.select("lang", "text"), F.lit(True)).where("copy IS NOT NULL").dropDuplicates(["copy"])
    models.calibrate(entropies(labelled, models, ["lang"]).where("size > 0"))
    return models


# --- scoring ---


def _packed(numbers) -> bytes:
    """Small whole numbers, byte by byte of equal weight."""
    numbers = np.asarray(numbers, np.uint32)
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    by_weight = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(by_weight.T).view(np.uint32).ravel().astype(np.int64)


def _known_words(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass").split()


def parts_of(some: list[str]) -> list[tuple[int, list[str], tuple]]:
    """Portions of words with their distinct grams."""
    return [(start, part, distinct_grams(part)) for start, part in portions(some)]


def wanted_keys(parts: list[tuple[int, list[str], tuple]]) -> np.ndarray:
    """Sorted distinct keys of all grams and contexts."""
    found = [np.unique(np.concatenate(keys_of(grams), axis=None)) for _, _, (grams, _, _) in parts]
    return np.unique(np.concatenate(found)) if found else np.array([], np.int64)


def word_logs(
    parts: list[tuple[int, list[str], tuple]], keys: np.ndarray, at: np.ndarray, langs: np.ndarray, logs: np.ndarray, languages: int, vocabulary: int
) -> np.ndarray:
    """(languages, words) log probability of each word.

    `logs` are the entries found in the models: language `langs[i]` knows the key `keys[at[i]]`.
    """
    out = np.zeros((languages, sum(len(part) for _, part, _ in parts)))
    order = np.argsort(langs, kind="stable")
    cuts = np.searchsorted(langs[order], np.arange(languages + 1))
    for start, part, (grams, place, owner) in parts:
        gram, context = (np.searchsorted(keys, k).astype(np.int32) for k in keys_of(grams))
        for number in range(languages):
            own = order[cuts[number] : cuts[number + 1]]
            known = np.full(len(keys), np.nan, np.float32)
            known[at[own]] = logs[own]
            total, left = np.zeros(grams.shape[1]), np.arange(grams.shape[1])
            for k in reversed(range(ORDER)):
                p = known[gram[k, left]]
                seen = ~np.isnan(p)
                total[left[seen]] += p[seen]
                left = left[~seen]
                total[left] += np.nan_to_num(known[context[k, left]])
            total[left] -= np.log(vocabulary)
            out[number, start : start + len(part)] = np.bincount(owner, total[place], len(part))
    return out


def entropies(docs: DataFrame, models: Models, id_cols: Sequence[str] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(`id_cols`, size, entropy) of each row's text: number of characters that were predicted, cross-entropy in each language."""
    spark, shards, languages, vocabulary = docs.sparkSession, models.shards, len(models.languages), models.vocabulary
    kinds_of_ids = [docs.schema[c].dataType.simpleString() for c in id_cols]
    bounded_batches(spark)
    # NULL ids would turn whole numbers into rounded ones in pandas, so they travel as text.
    rows = docs.select(F.array(*[F.col(c).cast("string") for c in id_cols]).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    block_type = "block long, shard int, keys binary, ids array<array<string>>, words binary, kinds binary, places binary, times binary"

    def in_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of each block's texts (shard -1), and one for each shard that it asks."""
        task = TaskContext.get()
        name = (task.partitionId() if task else 0) << 32
        ids, places, times, held, letters = [], [], [], 0, 0
        known: dict[str, int] = {}

        def block() -> pd.DataFrame:
            kinds = [len(p) for p in places]
            owner, place, time = np.repeat(np.arange(len(kinds)), kinds), np.concatenate(places), np.concatenate(times)
            often = np.argsort(-np.bincount(place, time, len(known)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            order = np.argsort(owner << 32 | rank[place])
            place, time = rank[place][order], time[order]
            steps = np.diff(place, prepend=0)
            first = np.diff(owner, prepend=-1) > 0
            steps[first] = place[first]
            some = list(known)
            some = [some[i] for i in often.tolist()]
            keys = wanted_keys(parts_of(some))
            of_shard = np.mod(keys, shards)
            order = np.argsort(of_shard, kind="stable")
            cuts = np.searchsorted(of_shard[order], np.arange(shards + 1))
            asked = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            body = pd.DataFrame({
                "block": [name], "shard": [-1], "keys": [None], "ids": [ids], "words": [zlib.compress("\n".join(some).encode("utf-8", "surrogatepass"), 1)],
                "kinds": [_packed(kinds)], "places": [_packed(steps)], "times": [_packed(time)],
            })
            questions = pd.DataFrame({
                "block": name, "shard": asked, "keys": [keys[order[cuts[s] : cuts[s + 1]]].tobytes() for s in asked],
                "ids": None, "words": None, "kinds": None, "places": None, "times": None,
            })
            return pd.concat([body, questions])

        for frame in frames:
            for row_id, text in zip(frame["id"].tolist(), frame["text"].tolist()):
                found = counted_words(text)
                before = len(known)
                at = np.array([known.setdefault(w, len(known)) for w in found], np.int64)
                letters += sum(len(w) for w, i in zip(found, at.tolist()) if i >= before)
                ids.append(list(row_id))
                places.append(at)
                times.append(np.fromiter(found.values(), np.int64, len(at)))
                held += len(text) + 100
                if held >= block_chars or letters >= BLOCK_LETTERS:
                    yield block()
                    name, ids, places, times, held, letters, known = name + 1, [], [], [], 0, 0, {}
        if ids:
            yield block()

    def answer(key: tuple, arrays: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        stored, langs, logs = (np.asarray(arrays[c].iat[0] if len(arrays) else []) for c in ("keys", "langs", "logs"))
        found = []
        for name, wanted in zip(asked["block"], asked["keys"]):
            wanted = np.frombuffer(wanted, np.int64)
            first, stop = np.searchsorted(stored, wanted), np.searchsorted(stored, wanted, "right")
            many = stop - first
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            found.append((name, key[0], _packed(many), _packed(langs[entry]), logs[entry].astype(np.float32).tobytes()))
        return pd.DataFrame(found, columns=["block", "shard", "many", "langs", "logs"])

    def finish(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({"id": [], "size": [], "entropy": []})
        block = next(blocks.itertuples(index=False))
        some = _known_words(block.words)
        parts = parts_of(some)
        keys = wanted_keys(parts)
        of_shard = np.mod(keys, shards)
        at, langs, logs = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.float32)]
        for reply in answers.itertuples(index=False):
            at.append(np.repeat(np.flatnonzero(of_shard == reply.shard), _unpacked(reply.many)))
            langs.append(_unpacked(reply.langs))
            logs.append(np.frombuffer(reply.logs, np.float32))
        of_word = word_logs(parts, keys, np.concatenate(at), np.concatenate(langs), np.concatenate(logs), languages, vocabulary)
        kinds, steps, times = (_unpacked(x) for x in (block.kinds, block.places, block.times))
        owner = np.repeat(np.arange(len(kinds)), kinds)
        before = np.concatenate([[0], np.cumsum(steps)])
        starts = np.cumsum(kinds) - kinds
        word = before[1:] - np.repeat(before[starts], kinds)
        length = np.array([len(w) + 1 for w in some], np.int64)
        size = np.bincount(owner, length[word] * times, len(kinds)).astype(np.int64) if len(word) else np.zeros(len(kinds), np.int64)
        entropy = np.stack([-np.bincount(owner, of_word[i][word] * times, len(kinds)) for i in range(languages)], axis=1)
        return pd.DataFrame({"id": list(block.ids), "size": size, "entropy": (entropy / np.maximum(size, 1)[:, None]).tolist()})

    blocks = materialize(rows.mapInPandas(in_blocks, block_type), "blocks")  # once: questions and texts must be of the same blocks
    bodies = blocks.where("shard = -1").drop("shard", "keys")
    groups = max(1, -(-bodies.count() // BLOCKS_PER_TASK))
    part = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("part")
    asked = blocks.where("shard >= 0").select("block", "shard", "keys", part)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part")
    answers = models.table.select("*", copies).groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(
        answer, "block long, shard int, many binary, langs binary, logs binary"
    )
    scored = bodies.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "id array<string>, size long, entropy array<double>")
    return scored.select(*[F.col("id")[i].cast(kind).alias(c) for i, (c, kind) in enumerate(zip(id_cols, kinds_of_ids))], "size", "entropy")


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row."""
    if models is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    return _judged(entropies(docs.select("doc_id", "text"), models), models)


def learn_and_identify(docs: DataFrame, learned: Column) -> DataFrame:
    """`identify` of every row of (doc_id, text, lang) by models trained on those where `learned` is true.

    The same as `train` and `identify`, with the cross-entropies of a text computed once for both.
    """
    models = fit(docs.where(learned))
    if models is None:
        return identify(docs, None)
    rows = _with_truth(docs, learned).select("doc_id", "text", "lang", "copy")
    found = materialize(entropies(rows, models, ["doc_id", "lang", "copy"]), "entropies")
    models.calibrate(found.where("copy IS NOT NULL AND size > 0").dropDuplicates(["copy"]))
    return _judged(found, models)


def _judged(found: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) from the cross-entropies."""
    found = found.withColumn("lowest", F.array_min("entropy"))
    powers = F.transform("entropy", lambda e: F.exp((F.col("lowest") - e) / models.temperature))
    best = F.array_position("entropy", F.col("lowest")).cast("int")
    readable = F.col("size") > 0
    score = F.when(readable, 1 / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in models.limits]), best)
    name = F.element_at(F.array(*[F.lit(x) for x in models.languages]), best)
    return found.select(
        "doc_id", F.when(readable, name).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"),
        (readable & (score >= ACCEPTED) & (F.col("lowest") <= limit)).alias("accepted"),
    )
