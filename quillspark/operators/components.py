"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins on an edge table; nothing is
gathered on the driver but a row count and a checksum. The number of rounds
grows with the logarithm of the longest path. Each round's edges are staged in
the shared folder, so a lost executor never costs earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import staged


def _star(edges: DataFrame) -> DataFrame:
    """Large star: link every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Small star: link u and its smaller neighbours to the smallest of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, source: str = "u", target: str = "v", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` that isn't its component's smallest node.

    Self-links and repeated links are allowed, nulls are dropped. Node ids are
    longs or strings. An empty table gives an empty result.
    """
    a, b = F.col(source), F.col(target)
    current = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        row = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not row[0] or (row[0], row[1]) == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (row[0], row[1])
        current = staged(_small_star(_star(current)), "edges")
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")
