"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut_lineage


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the least node of its component) for the nodes of `edges` (u, v).

    Every round points each node's larger neighbours, then the node and its smaller ones, at
    the least of them; edges never grow in number. A minimum per node is all that is gathered,
    so a node with very many neighbours is no large group. Rounds end when nothing moves.
    """
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = cut_lineage(small)
        moved = new.exceptAll(now).isEmpty()
        now = new
        if moved:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()).distinct()
