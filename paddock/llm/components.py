"""Connected components of a link table, by joins and aggregations.

Alternating large-star and small-star steps: every step replaces the edges of
a node by edges to the smallest neighbour, so trees become stars in a number
of rounds that grows with the logarithm of the longest path.  A node with many
neighbours is never gathered: its minimum is pre-aggregated, and the join that
hands it out can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges`` (u, v) -> (node, root): root is the smallest node reachable.

    Nodes without a link to another node are absent.  Rows with NULLs and
    self links are ignored, repeated links count once.  Both columns must be
    of one orderable type."""
    now = stored(_small_star(edges.select("u", "v").where("u != v").distinct()), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
