"""Connected components of a graph given by edges, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelantern.llm.common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The component of each vertex that an edge touches.

    edges: columns a and b, long. Returns v and c: c is the smallest vertex that v can reach. Self loops,
    repeated edges and both directions are allowed; an edge with a null end is ignored; no edges give no rows.

    Each round sends every label along every edge, keeps the smallest for each vertex, then replaces a label
    by its own label (pointer jumping), so the rounds grow with the logarithm of the longest path. Labels are
    checkpointed once a round; both joins read plain exchanges, so a vertex with very many edges, or a
    component with very many vertices, is split by adaptive skew handling. Raises if `rounds` were not enough.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("c")))
    for _ in range(rounds):
        jumped = labels.alias("x").join(labels.alias("y"), F.col("x.c") == F.col("y.v")).select("x.v", "y.c")
        sent = both.join(jumped, both.a == F.col("v")).select(F.col("b").alias("v"), "c")
        old = labels.select("v", "c", F.col("c").alias("old"))
        new = (
            jumped.unionByName(sent)
            .withColumn("old", F.lit(None).cast("long"))
            .unionByName(old)
            .groupBy("v")
            .agg(F.min("c").alias("c"), F.min("old").alias("old"))
        )
        new = cut(new)
        labels = new.select("v", "c")
        if new.where("c <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
