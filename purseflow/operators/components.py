"""Connected components of a graph given as a table of edges.

Alternating star contraction: each round links every node to the least node
near it, first upwards (large star), then downwards (small star). The number of
rounds grows with the logarithm of the longest path. A round is made of
aggregations with partial sums and equi-joins that adaptive execution can split,
so a hub with very many edges is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.storage import discard, materialize


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    return row.n, row.x, row.s


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, root)`` for every node that has an edge to another node; the
    root is the least node that can be reached. Loops, repeated edges and nulls
    are ignored. An empty table gives an empty table."""
    ends = (F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    now = materialize(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(*ends).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small, "edges")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
