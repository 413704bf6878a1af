"""Connected components by alternating star contractions, a reliable checkpoint each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.text import staged


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, label: str = "stars", rounds: int = 60) -> DataFrame:
    """edges (src, dst) -> (node, root): the least node of each component, for nodes with an edge.

    Each half round sends every neighbour of a node to the least one: an aggregate and a join on the node, so
    no neighbour list is gathered. Rounds grow with the logarithm of the component's width. Loops and
    repeated edges are allowed; nulls are not. Raises if ``rounds`` do not suffice.
    """
    down = lambda a, b: [F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")]
    now = staged(edges.filter("src <> dst").select(*down("src", "dst")).distinct(), label)
    before = _mark(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = staged(small.union(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct(), label)
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components of {label} are not settled after {rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(now.select("dst", "dst")).distinct()
