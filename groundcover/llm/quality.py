"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Every passage is encoded as shares of
adjacent character classes, word repetition and word shape; a hidden layer turns that into a representation h. Gated
attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of a document, and a
logistic output scores the weighted mean. Only document labels are known in training.

Training takes a bounded sample of labelled rows: at most about SAMPLE_DOCS documents, evenly
spaced passages up to SAMPLE_PASSAGES of each; their encodings (a few MB) are collected and fitted on the
driver. Scoring sees every passage of every text, batch by batch.

Defined cases: NULL and empty texts are one empty passage and get a score; documents without a
label, with a NULL label or a NULL id don't train; several labels of an id all count; without
both kinds of labels the score is the share of label 1 (0.5 without any). Repeated rows each give a row.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from groundcover.llm.common import bounded_batches, slices

PASSAGE_WORDS = 64
SAMPLE_DOCS = 6000
SAMPLE_PASSAGES = 24
HIDDEN, GATE = 32, 16
EPOCHS, STEP, BAGS, DECAY = 15, 0.01, 256, 1e-4
THRESHOLD = 0.3

# Character classes: lower, upper, digit, blank, line end, stop or comma, quote or bracket, dash, symbol, non-ASCII.
CLASSES = 10


def _class_table() -> np.ndarray:
    table = np.full(256, 8, np.intp)
    table[128:] = 9
    for group, chars in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"'\"()[]{}", b"-_",
    )):
        table[list(chars)] = group
    return table


_CLASS = _class_table()
FEATURES = CLASSES * CLASSES + 6


def encode(text: str) -> np.ndarray:
    """One row of FEATURES numbers per passage; every word of the text is in one passage.

    Very long texts are encoded slice by slice, so memory stays bounded.
    """
    return np.concatenate([_encode(piece) for piece in slices(text)])


def _encode(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros((1, FEATURES), np.float32)
    kind = _CLASS[data]
    blank = (kind == 3) | (kind == 4)
    begins = ~blank
    begins[1:] &= blank[:-1]
    word = np.cumsum(begins) - 1
    words = int(word[-1]) + 1
    passage = np.maximum(word, 0) // PASSAGE_WORDS
    n = int(passage[-1]) + 1
    size = CLASSES * CLASSES
    pairs = np.bincount(passage[1:] * size + kind[:-1] * CLASSES + kind[1:], minlength=n * size)[: n * size].reshape(n, size)
    out = np.zeros((n, FEATURES), np.float32)
    total = np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    out[:, :size] = np.sqrt(pairs / total)
    if words:
        found = text.split()
        for p in range(n):
            some = found[p * PASSAGE_WORDS : (p + 1) * PASSAGE_WORDS]
            if not some:
                continue
            lengths = [len(w) for w in some]
            count = len(some)
            out[p, size:] = (
                len(set(some)) / count,
                sum(a == b for a, b in zip(some, some[1:])) / count,
                count / PASSAGE_WORDS,
                min(sum(lengths) / count, 40) / 10,
                min(max(lengths), 80) / 20,
                sum(w[:1].isupper() for w in some) / count,
            )
    return out


class Model:
    """Weights of the encoder layer, the gated attention and the output."""

    def __init__(self, weights: dict[str, np.ndarray], constant: float | None = None):
        self.weights, self.constant = weights, constant

    def score(self, passages: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Scores of documents whose passages start at the rows `begins`."""
        if self.constant is not None:
            return np.full(len(begins), self.constant)
        return 1 / (1 + np.exp(-_forward(self.weights, passages, begins)["logit"].astype(np.float64)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], passages: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.r_[begins, len(passages)])
    owner = np.repeat(np.arange(len(begins)), sizes)
    x = (passages - w["mean"]) / w["spread"]
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    energy = (t * g) @ w["a"]
    energy = np.exp(energy - np.maximum.reduceat(energy, begins)[owner])
    attention = energy / np.add.reduceat(energy, begins)[owner]
    z = np.add.reduceat(attention[:, None] * h, begins, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "owner": owner, "attention": attention, "z": z, "logit": z @ w["c"] + w["b"]}


def _gradients(w: dict[str, np.ndarray], f: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    out = (_sigmoid(f["logit"]) - labels) / len(labels)
    dz = out[:, None] * w["c"]
    a, h, own = f["attention"], f["h"], f["owner"]
    per = np.einsum("ij,ij->i", dz[own], h)
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    energy = a * (per - np.add.reduceat(a * per, begins)[own])
    gate = energy[:, None] * w["a"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = a[:, None] * dz[own] + dt @ w["V"].T + dg @ w["U"].T
    de = dh * (1 - h**2)
    return {
        "c": f["z"].T @ out, "b": np.array(out.sum()), "a": (f["t"] * f["g"]).T @ energy,
        "V": h.T @ dt, "U": h.T @ dg, "E": f["x"].T @ de, "e": de.sum(axis=0),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Adam on the log loss; the same bags in the same order give the same model."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model({}, share)
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {
        "mean": rows.mean(axis=0), "spread": rows.std(axis=0) + 0.02,
        "E": draw(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
        "a": draw(GATE), "c": draw(HIDDEN), "b": np.array(np.log(share / (1 - share)), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    n = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = STEP * (1 - epoch / EPOCHS) + 1e-4
        for start in range(0, len(order), BAGS):
            chosen = order[start : start + BAGS]
            some = [bags[i] for i in chosen]
            begins = np.cumsum([0, *map(len, some[:-1])])
            f = _forward(w, np.concatenate(some), begins)
            n += 1
            for k, g in _gradients(w, f, labels[chosen]).items():
                g = g + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return Model(w)


def train(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS) -> Model:
    """A model of `labels` (doc_id, label 0 or 1), from about `n` labelled documents picked by a hash of the id."""
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("label"))
    share = min(1.0, n / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))

    @pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows = encode(text)
            if len(rows) > SAMPLE_PASSAGES:
                rows = rows[np.linspace(0, len(rows) - 1, SAMPLE_PASSAGES).astype(int)]
            out.append(rows.astype(np.float16).tobytes())
        return pd.Series(out)

    # The hash filter reaches the scan of the texts too, so only sampled texts are joined.
    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    rows = (
        sampled.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
        .select("doc_id", "label", encoded("text").alias("bag")).limit(2 * n).toPandas()
    )
    rows = rows.sort_values(["doc_id", "label", "bag"], ignore_index=True)
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in rows["bag"]]
    return fit(bags, rows["label"].to_numpy(np.float32))


def score_column(text: Column, spark, model: Model) -> Column:
    shared = spark.sparkContext.broadcast(model)  # about 5,000 numbers

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            bags = [encode(t) for t in texts]
            begins = np.cumsum([0, *map(len, bags[:-1])])
            scores = shared.value.score(np.concatenate(bags), begins) if bags else np.zeros(0)
            yield pd.Series(np.nan_to_num(scores, nan=0.5))

    return scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """`docs` with the model's score of each text."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, score_column(F.col("text"), docs.sparkSession, model))
