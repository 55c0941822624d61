"""Character n-gram language models with modified Kneser-Ney smoothing, counted and kept by Spark, of any size.

A model is named by a text, such as a language; one call trains any number of them. Tasks count the n-grams of their texts,
Spark adds them up. Lower orders count in how many ways an n-gram goes on to the left; discounts for counts of 1, 2 and 3 or more
come from the counts of counts of each model and order; all orders are interpolated down to a uniform distribution.

The finished model is a table of sorted hash arrays: entries (a 64-bit hash of model and n-gram, log probability, log
back-off weight) are dealt by hash to shards of about SHARD_ENTRIES, each one row of three arrays sorted by hash. It is never
gathered in one place. Scoring works in blocks of texts of about BLOCK_CHARS: each block asks every shard for the n-grams it holds (a
binary search in the shard's arrays), and the answers, no more than the block's own distinct n-grams, are brought together with
the block's texts. So memory is bounded by block and shard whatever the size of corpus and model, and nothing is cut off.

A block is named by its place and its content. Should texts come in other blocks when they are read again, as may happen with
rows that come out of a shuffle instead of a table, the job fails instead of returning other scores; write such rows first.
"""

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundcover.llm.common import bounded_batches
from groundcover.session import materialize

ORDER = 4
BLOCK_CHARS = 12_000_000
PIECE_CHARS = 2_000_000  # of a block that are looked at together
SHARD_ENTRIES = 50_000
BLOCKS_PER_TASK = 2_000  # whose questions to a shard one task answers
BROADCAST_ROWS = 100_000
DENSE = 1 << 24

PAD = "\x02"  # stands before a text ORDER - 1 times; not a character of texts
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# What str.split() takes for a blank and the word pattern doesn't.
OTHER_BLANKS = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def words_of(text: str) -> list[str]:
    """Words between blanks, tabs and line ends."""
    return WORD.findall(text) if any(c in text for c in OTHER_BLANKS) else text.split()


def plain(text: str | None) -> str:
    """What the models see of a text: lower case, single blanks, digits all alike."""
    text = " ".join(words_of(text or "")).lower().replace(PAD, "\x01")
    for digit in "123456789":
        text = text.replace(digit, "0")
    return text


def distinct_grams(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The n-grams of a padded text that don't end in padding: distinct ones, and for each place its end and which one it is."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size, letter = _numbered(codes)
    ends = np.flatnonzero(codes[ORDER - 1 :] != ord(PAD)) + ORDER - 1
    count, number = size, letter[ends - ORDER + 1]
    for k in range(ORDER - 2, -1, -1):
        wide = np.int64 if count * size >= 1 << 31 else np.int32
        count, number = _numbered(number.astype(wide, copy=False) * wide(size) + letter[ends - k])
    some = np.empty(count, np.int64)
    some[number] = ends
    return [text[e - ORDER + 1 : e + 1] for e in some.tolist()], ends, number


def _numbered(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """How many distinct codes there are, and for every place which one it holds."""
    if not len(codes):
        return 0, codes.astype(np.int32)
    space = int(codes.max()) + 1
    if space > DENSE:
        kinds, number = np.unique(codes, return_inverse=True)
        return len(kinds), number.astype(np.int32)
    seen = np.zeros(space, np.int32)
    seen[codes] = 1
    kinds = np.flatnonzero(seen)
    seen[kinds] = np.arange(len(kinds), dtype=np.int32)
    return len(kinds), seen[codes]


def pieces(texts: Sequence[str]) -> Iterator[tuple[str, int, np.ndarray]]:
    """Padded texts one after another, in pieces: (piece, where it starts, where each text starts)."""
    pad = PAD * (ORDER - 1)
    starts = np.cumsum([0] + [len(t) + ORDER - 1 for t in texts])
    whole = "".join(pad + t for t in texts)
    for at in range(0, max(1, len(whole) - ORDER + 1), PIECE_CHARS):
        yield whole[at : at + PIECE_CHARS + ORDER - 1], at, starts


# --- training ---


def counted(docs: DataFrame, text: str, model: str, block_chars: int) -> DataFrame:
    """(model, gram, n): top-order n-grams, added up over all rows; rows without a model name don't count."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in in_blocks(frames, block_chars):
            for name, rows in _rows_of(block.models).items():
                found: Counter[str] = Counter()
                for piece, _, _ in pieces([block.texts[i] for i in rows]):
                    grams, _, number = distinct_grams(piece)
                    found.update(dict(zip(grams, np.bincount(number, minlength=len(grams)).tolist())))
                if found:
                    yield pd.DataFrame({"model": name, "gram": list(found), "n": list(found.values())})

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(model).isNotNull()).select(F.lit(None).cast("int").alias("id"), F.col(model), F.col(text))
    parts = rows.mapInPandas(count, "model string, gram string, n long")
    return parts.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def _discount(n1: str, n2: str, i: int):
    """D_i = i - (i + 1) Y n_(i+1) / n_i; half of i where a count of counts is missing."""
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    value = i - (i + 1) * y * F.try_divide(F.col(n2), F.col(n1))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(n1) > 0) & (F.col(n2) > 0)
    return F.when(known & (value > 0), value).otherwise(F.lit(i / 2.0))


@dataclass
class NgramModels:
    """`table`: (shard, keys, logp, backoff), one row per shard."""

    table: DataFrame
    shards: int


def _with_few(df: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a written table; one of at most BROADCAST_ROWS rows goes to all tasks, so that no key has to go to one."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on)


def train(
    docs: DataFrame, text: str, model: str, block_chars: int = BLOCK_CHARS, shard_entries: int = SHARD_ENTRIES
) -> NgramModels:
    """One model of each name in column `model`, from the texts that carry it."""
    top = materialize(counted(docs, text, model, block_chars), "grams")
    left = [
        F.struct(F.lit(k).alias("k"), F.expr(f"substring(gram, {ORDER - k + 1}, {k})").alias("gram"), F.expr(f"substring(gram, {ORDER - k}, 1)").alias("before"))
        for k in range(1, ORDER)
    ]
    lower = top.select("model", F.explode(F.array(*left)).alias("e")).select("model", "e.*")
    counts = materialize(
        lower.groupBy("model", "k", "gram").agg(F.count_distinct("before").alias("n"))
        .unionByName(top.select("model", F.lit(ORDER).alias("k"), "gram", "n")),
        "counts",
    )
    of_counts = counts.groupBy("model", "k").agg(
        *[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)], F.count(F.lit(1)).alias("kinds")
    )
    discounts = of_counts.select(
        "model", "k", "kinds", *[_discount(f"n{i}", f"n{i + 1}", i).alias(f"d{i}") for i in range(1, 4)]
    )
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = _with_few(counts, materialize(discounts, "discounts"), ["model", "k"]).select(
        "model", "k", "gram", "n", taken.alias("d"), "kinds", F.expr("substring(gram, 1, k - 1)").alias("context")
    )
    contexts = rows.groupBy("model", "k", "context").agg(
        F.sum("n").alias("all"), (F.sum("d") / F.sum("n")).alias("weight"), F.max("kinds").alias("kinds")
    )
    contexts = materialize(contexts, "contexts")
    shares = materialize(
        rows.drop("kinds").join(contexts, ["model", "k", "context"])
        .select("model", "k", "gram", ((F.col("n") - F.col("d")) / F.col("all")).alias("own"), "weight", "kinds"),
        "shares",
    )
    uniform = 1.0 / (F.col("kinds") + 1)
    done = shares.where("k = 1").select("model", "gram", (F.col("own") + F.col("weight") * uniform).alias("p"))
    orders = [done]
    for k in range(2, ORDER + 1):
        shorter = orders[-1].select("model", F.col("gram").alias("rest"), F.col("p").alias("lower"))
        here = shares.where(F.col("k") == k).withColumn("rest", F.expr("substring(gram, 2)"))
        orders.append(here.join(shorter, ["model", "rest"]).select("model", "gram", (F.col("own") + F.col("weight") * F.col("lower")).alias("p")))
    nothing = F.lit(None).cast("double")
    known = [
        *[o.select("model", "gram", F.log("p").alias("logp"), nothing.alias("backoff")) for o in orders],
        contexts.where("k = 1").select("model", F.lit("").alias("gram"), F.log(uniform).alias("logp"), nothing.alias("backoff")),
        contexts.select("model", F.col("context").alias("gram"), nothing.alias("logp"), F.log("weight").alias("backoff")),
    ]
    union = known[0]
    for more in known[1:]:
        union = union.unionByName(more)
    entries = union.groupBy(F.xxhash64("model", "gram").alias("key")).agg(
        F.max("logp").cast("float").alias("logp"), F.max("backoff").cast("float").alias("backoff")
    )
    entries = materialize(entries, "entries")
    shards = max(1, -(-entries.count() // shard_entries))
    arrays = entries.groupBy(F.pmod("key", F.lit(shards)).cast("int").alias("shard")).agg(
        F.array_sort(F.collect_list(F.struct("key", "logp", "backoff"))).alias("e")
    )
    table = arrays.select("shard", F.col("e.key").alias("keys"), F.col("e.logp").alias("logp"), F.col("e.backoff").alias("backoff"))
    return NgramModels(materialize(table, "model"), shards)


# --- scoring ---


@dataclass
class Block:
    ids: list
    models: list[str]
    texts: list[str]
    raw: list
    name: int


def in_blocks(frames: Iterator[pd.DataFrame], block_chars: int, keep: Callable | None = None) -> Iterator[Block]:
    """Rows (id, model, text) of a task in blocks; `keep` says what to take from the raw text."""
    task = TaskContext.get()
    place, number = (task.partitionId() if task else 0), 0
    ids, models, texts, raw, held = [], [], [], [], 0

    def block() -> Block:
        content = xxhash.xxh3_64()
        for part in [str((place, number)), *models, *texts]:
            content.update((part or "").encode("utf-8", "surrogatepass"))
            content.update(b"\0")
        return Block(ids, models, texts, raw, content.intdigest() - (1 << 63))

    for frame in frames:
        for row_id, model, text in zip(frame.iloc[:, 0].tolist(), frame.iloc[:, 1].tolist(), frame.iloc[:, 2].tolist()):
            ids.append(row_id)
            models.append(model)
            texts.append(plain(text))
            raw.append(keep(text) if keep else None)
            held += len(texts[-1]) + 100
            if held >= block_chars:
                yield block()
                ids, models, texts, raw, held, number = [], [], [], [], 0, number + 1
    if ids:
        yield block()


def _rows_of(models: list[str]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, name in enumerate(models):
        if name is not None:
            found.setdefault(name, []).append(i)
    return found


class Keys(dict):
    """Hashes of n-grams in one model, as Spark's xxhash64(model, gram)."""

    def __init__(self, model: str):
        self.seed = xxhash.xxh64_intdigest(model.encode("utf-8", "surrogatepass"), 42)

    def __missing__(self, gram: str) -> int:
        key = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), self.seed)
        key = self[gram] = key - (1 << 64) if key >> 63 else key
        return key

    def of(self, grams: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, grams), np.int64, len(grams))


def _ask(grams: list[str], keys: Keys) -> None:
    """Puts all keys into `keys` that the probability of the n-grams may depend on."""
    longer = set(grams)
    for k in range(ORDER, 0, -1):
        keys.of(list(longer))
        keys.of(list({g[:-1] for g in longer}))
        longer = {g[1:] for g in longer}
    keys[""]


def wanted_keys(block: Block) -> np.ndarray:
    """Sorted distinct hashes of all n-grams, shorter n-grams and contexts of a block."""
    return _all_keys(hashes for _, hashes, _ in counted_grams(block, places=False))


def counted_grams(block: Block, places: bool = True) -> list[tuple[list[int], Keys, list]]:
    """Per model the rows of its texts, its hashes, and for each piece (grams, which one is at each place, the place's text)."""
    found = []
    for name, rows in _rows_of(block.models).items():
        keys, parts = Keys(name), []
        for piece, at, starts in pieces([block.texts[i] for i in rows]):
            grams, ends, number = distinct_grams(piece)
            _ask(grams, keys)
            if places:
                parts.append((grams, number, np.searchsorted(starts, at + ends, "right").astype(np.int32) - 1))
        found.append((rows, keys, parts))
    return found


def _all_keys(models: Iterator[Keys]) -> np.ndarray:
    found = [np.fromiter(keys.values(), np.int64, len(keys)) for keys in models]
    return np.unique(np.concatenate(found)) if found else np.array([], np.int64)


def log_probabilities(size: int, found: list, keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each of `size` texts; NaN without a model.

    `found` are the `counted_grams`; `logp` is NaN for n-grams that a model has never seen.
    """
    out = np.full(size, np.nan)
    for rows, hashes, parts in found:
        if np.isnan(logp[np.searchsorted(keys, hashes[""])]):
            continue
        total = np.zeros(len(rows))
        for grams, number, of_text in parts:
            value = np.zeros(len(grams))
            open_ = np.ones(len(grams), bool)
            for k in range(ORDER, -1, -1):
                here = np.flatnonzero(open_)
                if not len(here):
                    break
                tails = [grams[i][ORDER - k :] for i in here.tolist()]
                p = logp[np.searchsorted(keys, hashes.of(tails))]
                seen = ~np.isnan(p)
                value[here[seen]] += p[seen]
                open_[here[seen]] = False
                if k:
                    rest = here[~seen]
                    w = backoff[np.searchsorted(keys, hashes.of([tails[i][:-1] for i in np.flatnonzero(~seen).tolist()]))]
                    value[rest] += np.nan_to_num(w)
            total += np.bincount(of_text, weights=value[number], minlength=len(rows))
        out[rows] = total
    return out


def score(
    docs: DataFrame, models: NgramModels, id_col: str, text: str, model: str, measure: Callable | None = None, measured: str = "int",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per row: id, model, log_probability (NULL without a model), chars (that the model predicted), and what `measure` says of the raw text.

    `measured` is the SQL type of `measure`'s result.
    """
    spark, shards = docs.sparkSession, models.shards
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(spark)
    # NULL ids would turn whole numbers into rounded ones in pandas, so they travel as text.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(model).alias("model"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, -(-chars // (block_chars * BLOCKS_PER_TASK)))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in in_blocks(frames, block_chars):
            keys = wanted_keys(block)
            shard = np.mod(keys, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            asked = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pd.DataFrame({
                "block": block.name, "shard": asked, "part": block.name % parts,
                "keys": [keys[order[cuts[s] : cuts[s + 1]]].tobytes() for s in asked],
            })

    def answer(key: tuple, arrays: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        stored, logp, backoff = (np.asarray(arrays[c].iat[0]) if len(arrays) else np.array([0]) for c in ("keys", "logp", "backoff"))
        known, weights = [], []
        for wanted in asked["keys"]:
            wanted = np.frombuffer(wanted, np.int64)
            at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
            found = (stored[at] == wanted) & bool(len(arrays))
            known.append(np.where(found, logp[at].astype(np.float32), np.float32("nan")).tobytes())
            weights.append(np.where(found, backoff[at].astype(np.float32), np.float32("nan")).tobytes())
        return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "logp": known, "backoff": weights})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in in_blocks(frames, block_chars, measure):
            lengths = np.array([len(t) for t in block.texts], np.int64)
            joined = "".join(block.texts).encode("utf-8", "surrogatepass")
            yield pd.DataFrame({
                "block": [block.name], "ids": [block.ids], "models": [block.models], "measured": [block.raw],
                "lengths": [lengths.tolist()], "texts": [zlib.compress(joined, 1)],
            })

    def finish(key: tuple, packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in packed.itertuples(index=False):
            joined, texts, at = zlib.decompress(row.texts).decode("utf-8", "surrogatepass"), [], 0
            for n in row.lengths:
                texts.append(joined[at : at + n])
                at += n
            block = Block(list(row.ids), list(row.models), texts, [], key[0])
            grams = counted_grams(block)
            keys = _all_keys(hashes for _, hashes, _ in grams)
            shard = np.mod(keys, shards)
            logp, backoff = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
            missing = len(keys)
            for reply in answers.itertuples(index=False):
                here = np.flatnonzero(shard == reply.shard)
                logp[here], backoff[here] = np.frombuffer(reply.logp, np.float32), np.frombuffer(reply.backoff, np.float32)
                missing -= len(here)
            if missing:
                raise RuntimeError("the texts came in other blocks when read again: write them to a table first")
            found.append(pd.DataFrame({
                "id": block.ids, "model": block.models, "chars": row.lengths,
                "log_probability": log_probabilities(len(texts), grams, keys, logp, backoff), "measured": list(row.measured),
            }))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("id", "model", "chars", "log_probability", "measured")})

    asked = rows.mapInPandas(ask, "block long, shard int, part long, keys binary")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    table = models.table.select("*", copies)
    answers = table.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(
        answer, "block long, shard int, logp binary, backoff binary"
    )
    packed = rows.mapInPandas(
        pack, f"block long, ids array<string>, models array<string>, measured array<{measured}>, lengths array<long>, texts binary"
    )
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        finish, f"id string, model string, chars long, log_probability double, measured {measured}"
    )
    probability = F.when(~F.isnan("log_probability"), F.col("log_probability"))
    return scored.select(F.col("id").cast(kind).alias(id_col), "model", "chars", probability.alias("log_probability"), "measured")
