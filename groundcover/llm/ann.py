"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree halves a bounded sample at the median along the difference of two of its vectors until a
node holds LEAF_ROWS. Every vector is then sent to its leaf in each tree. A query walks all trees through one
priority queue, ordered by how far it is on the wrong side of the splits passed, and visits the PROBES
most promising leaves; in each of them all vectors are compared exactly, in double precision, and the best
of all leaves are ranked.

Equal vectors are indexed once, with their smallest k + 1 ids (more can't be among a
query's k nearest), so copies don't fill leaves. A leaf above CHUNK_ROWS is dealt out to several groups, and queries visit
all of them: nothing is capped. The forest (FOREST_ROWS / LEAF_ROWS leaves per tree, whatever the table's size)
is broadcast.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part, nor do rows without an
id; queries only meet vectors of their own length; repeated (id, vector) rows count once; rows with the query's id are never its
neighbours; ties go to the smaller id; queries without any candidate give no row; an empty table gives none.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundcover.llm.common import bounded_batches
from groundcover.session import materialize

TREES = 16
LEAF_ROWS = 100
FOREST_ROWS = 20_000
PROBES = 200
CHUNK_ROWS = 20_000


class Tree:
    """Split nodes as arrays; child numbers below 0 are leaves (-1 - leaf)."""

    def __init__(self, rows: np.ndarray, rng: np.random.Generator, leaf_rows: int):
        self.normals, self.cuts, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(rows, rng, leaf_rows)
        self.normals = np.array(self.normals, np.float32).reshape(len(self.cuts), rows.shape[1])
        self.cuts = np.array(self.cuts)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, leaf_rows: int) -> int:
        if len(rows) > leaf_rows:
            for _ in range(3):
                a, b = rows[rng.choice(len(rows), 2, replace=False)]
                side = rows @ (a - b)
                cut = float(np.median(side))
                over = side > cut
                if 0 < over.sum() < len(rows):
                    number = len(self.cuts)
                    self.normals.append(a - b)
                    self.cuts.append(cut)
                    self.children.append((0, 0))
                    self.children[number] = (self._grow(rows[~over], rng, leaf_rows), self._grow(rows[over], rng, leaf_rows))
                    return number
        self.leaves += 1
        return -self.leaves

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.full(len(rows), self.root, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            side = np.einsum("ij,ij->i", rows[inner], self.normals[at]) > self.cuts[at]
            node[inner] = self.children[at, side.astype(np.int64)]
        return -1 - node


class Forest:
    def __init__(self, rows: np.ndarray, trees: int, leaf_rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = rows.shape[1]
        self.trees = [Tree(rows, rng, leaf_rows) for _ in range(trees)]

    def probe(self, row: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that a query visits, most promising first."""
        sides = [t.normals @ row - t.cuts for t in self.trees]
        queue = [(-np.inf, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found = []
        while queue and len(found) < probes:
            worst, i, node = heapq.heappop(queue)
            if node < 0:
                found.append((i, -1 - node))
                continue
            margin = float(sides[i][node])
            under, over = self.trees[i].children[node]
            heapq.heappush(queue, (max(worst, margin), i, int(under)))
            heapq.heappush(queue, (max(worst, -margin), i, int(over)))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, each (id, vector) once."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", values.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["vec_id", "embedding"])


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Directions; the largest component is divided out first, so squares can't overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).astype(np.float32)


def fit(rows: DataFrame, trees: int = TREES, leaf_rows: int = LEAF_ROWS, forest_rows: int = FOREST_ROWS) -> dict[int, Forest]:
    """A forest per vector length, from about `forest_rows` vectors picked by a hash."""
    share = min(1.0, forest_rows / max(1, rows.count()))
    picked = rows.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    sample = picked.limit(2 * forest_rows).toPandas()
    if sample.empty:
        return {}
    lengths = sample["embedding"].map(len)
    forests = {}
    for dim, own in sample.groupby(lengths):
        matrix = _matrix(own["embedding"])
        forests[int(dim)] = Forest(_unit(matrix[np.lexsort(matrix.T)]), trees, leaf_rows)
    return forests


PLACE = "dim int, tree int, leaf int"


def _assigner(shared):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["embedding"].map(len)):
                forest = shared.value.get(int(dim))
                rows = _unit(_matrix(own["embedding"]))
                for i in range(len(forest.trees) if forest else 1):
                    yield pd.DataFrame({
                        "dim": dim, "tree": i, "leaf": forest.trees[i].assign(rows) if forest else 0,
                        "ids": own["ids"].to_numpy(), "embedding": own["embedding"].to_numpy(),
                    })

    return assign


def _prober(shared, probes: int):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for vec_id, vector in zip(batch["vec_id"], batch["embedding"]):
                forest = shared.value.get(len(vector))
                row = _unit(_matrix([vector]))[0]
                places = forest.probe(row, probes) if forest else [(0, 0)]
                trees, leaves = zip(*places)
                yield pd.DataFrame({"dim": len(vector), "tree": trees, "leaf": leaves, "query_id": vec_id, "query": [vector] * len(places)})

    return probe


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, row by row, so that a pair has one value wherever it is computed."""
    return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def _ranker(k: int):
    def rank(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            matrix = _matrix(rows["embedding"])
            ids = list(rows["ids"])
            first = np.array([i[0] for i in ids])
            for number, (query_id, query) in enumerate(zip(queries["query_id"], queries["query"])):
                score = cosines(np.asarray(query, np.float64), matrix)
                best = np.lexsort((first, -score))[: k + 1]  # one of them may be the query itself
                near = sorted((-score[b], i) for b in best for i in ids[b] if i != query_id)[:k]
                out.extend((query_id, query, i, -s) for s, i in near)
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"])

    return rank


def nearest(vectors: DataFrame, query_ids, k: int = 5, probes: int = PROBES, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each row that `query_ids` (a condition) picks."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialize(usable(vectors), "vectors")
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    shared = spark.sparkContext.broadcast(fit(rows, trees, leaf_rows))
    kind = "ids array<long>, embedding array<double>"
    placed = materialize(distinct.mapInPandas(_assigner(shared), f"{PLACE}, {kind}"), "leaves")
    probed = rows.where(query_ids).mapInPandas(_prober(shared, probes), f"{PLACE}, query_id long, query array<double>")
    place = ["dim", "tree", "leaf"]
    sizes = placed.groupBy(place).count().where(F.col("count") > CHUNK_ROWS)
    chunks = sizes.withColumn("chunks", F.ceil(F.col("count") / CHUNK_ROWS).cast("int")).drop("count")
    n = F.coalesce("chunks", F.lit(1))
    dealt = placed.join(F.broadcast(chunks), place, "left").withColumn("chunk", F.pmod(F.xxhash64("embedding"), n).cast("int"))
    spread = probed.join(F.broadcast(chunks), place, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    key = [*place, "chunk"]
    found = spread.drop("chunks").groupBy(key).cogroup(dealt.drop("chunks").groupBy(key)).applyInPandas(
        _ranker(k), "query_id long, query array<double>, vec_id long, score double"
    )
    found = found.groupBy("query_id", "query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
