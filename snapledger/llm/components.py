"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (src, dst); equal roots, one component.

    Each round every node joins the node that comes first, in an order drawn anew for the round, among its neighbours' first neighbours,
    and edges inside the joined groups go. A star is one group after one round; the expected number of nodes shrinks by a constant
    factor whatever the shape. Neighbours are reduced by partial aggregation and the maps between rounds are stored tables, so the joins
    have plain shuffles on both sides, which adaptive execution can split where one node has many neighbours.
    """
    edges = stored(edges.select("src", "dst").filter("src <> dst").distinct())
    labels = None
    for round_no in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        turn = F.struct(F.xxhash64("dst", F.lit(round_no)).alias("h"), F.col("dst").alias("n"))
        own = F.struct(F.xxhash64("src", F.lit(round_no)).alias("h"), F.col("src").alias("n"))
        near = both.groupBy("src").agg(F.min(turn).alias("m")).select(F.col("src").alias("by"), F.least("m", own).alias("m"))
        beyond = both.join(near, F.col("dst") == F.col("by")).groupBy("src").agg(F.min("m").alias("m"))
        step = stored(beyond.select(F.col("src").alias("at"), F.col("m.n").alias("to")))
        if labels is None:
            labels = step.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            moved = labels.join(step, F.col("root") == F.col("at"), "left")
            labels = stored(moved.select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(step, F.col("src") == F.col("at")).select(F.col("to").alias("a"), "dst")
        pairs = left.join(step, F.col("dst") == F.col("at")).select("a", F.col("to").alias("b")).filter("a <> b")
        edges = stored(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
