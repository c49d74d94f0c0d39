"""Connected components of an edge table, by contraction.

In each round every node joins its smallest neighbour, and the edges between the nodes that result go on to the next round, so
the table shrinks from round to round. Nothing is collected but one count per round. Every round is written to the
shared folder, so a lost executor repeats one round at most.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): the smallest node of each component. Self loops are dropped."""
    rounds = []
    while True:
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if rounds and not edges.limit(1).count():
            break
        # Both ends of every edge, each with the smaller end: a smallest neighbour, or the node itself.
        ends = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("label"))
        best = ends.groupBy("node").agg(F.min("label").alias("label"))
        up = best.select(F.col("node").alias("label"), F.col("label").alias("up"))
        best = cut(best.join(up, "label").select("node", F.col("up").alias("label")))
        rounds.append(best)
        a, b = (best.select(F.col("node").alias(x), F.col("label").alias("new_" + x)) for x in ("a", "b"))
        edges = edges.join(a, "a").join(b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
    labels = rounds[0]
    for step in rounds[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select(
            "node", F.coalesce("up", "label").alias("label"))
    return cut(labels)
