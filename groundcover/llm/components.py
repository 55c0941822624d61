"""Connected components of an edge table, by alternating star contractions.

Every round points the neighbours of each node at its smallest neighbour, first the smaller
ones, then the larger ones. Paths shorten by about half per round, the number of edges never grows,
and no group is ever collected: a node's smallest neighbour is a partial aggregate, and its edges
meet it in a join that Spark may split where a node is hot. Each round is written to the shared
folder, so lineage stays short and lost executors cost one round at most.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundcover.session import materialize

MAX_ROUNDS = 60


def _to_smallest(pairs: DataFrame, direction: str) -> DataFrame:
    """(u, v): every `v` beside `u` becomes an edge to the smallest node of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if direction == "larger":
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for each node that isn't a root itself.

    Self-loops and repeated edges are harmless; no edges give no rows. A chain that doesn't
    settle within MAX_ROUNDS rounds (paths of more than 2^60 nodes) is an error, never a wrong result.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    current = edges.select(high.alias("u"), low.alias("v")).where("u > v").distinct()
    current = materialize(current, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        # Smaller neighbours first: links of a node to several centres become links between centres, which are few.
        narrow = _to_smallest(current, "smaller").where("u > v").distinct()
        both = narrow.union(narrow.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _to_smallest(both, "larger").where("u > v").distinct()
        current = materialize(wide, "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
