"""Connected components of an edge table, by contraction.

Each round every node takes the smallest of itself and its neighbours as its
parent, parents are followed by doubling to the ends of their chains, and the
edges are rewritten to these; edges inside one node go.  At least half of the
nodes merge in a round, so log(n) rounds of log(n) doublings are enough, on
long paths too.  All tables are checkpointed, so a lost executor costs one
step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of edges (a, b); one root for each component.

    Null ends, loops and repeated edges are harmless: an edge with a null end
    is left out, a loop makes its node a component of its own.
    """
    edges = checkpointed(edges.where("a is not null and b is not null").select("a", "b"))
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("v"), "p")
        parent = _stars(checkpointed(parent))
        labels = checkpointed(parent.withColumnRenamed("p", "root") if labels is None else _through(labels, parent))
        x, y = (parent.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        edges = checkpointed(edges.join(x, "a").join(y, "b").where("pa <> pb")
                             .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def _stars(parent: DataFrame) -> DataFrame:
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = checkpointed(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        parent = step.drop("moved")
        if step.where("moved").isEmpty():
            return parent


def _through(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """Labels whose root was a node of this round get its parent."""
    step = parent.select(F.col("v").alias("root"), F.col("p").alias("next"))
    return labels.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
