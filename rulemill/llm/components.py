"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulemill.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, root): the smallest node that is reachable, for every node of some edge.

    Each round points every node at its smallest neighbour, follows two such steps, and contracts the edges to the new
    ends, so a star of any size is gone after one round and a path shrinks by a factor. Minima are combined before
    the shuffle. Rounds are few (logarithmic in the longest path); each is a table in the shared folder, and nothing but the
    number of its edges reaches the driver.
    """
    edges = written(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        to = ends.groupBy("e.node").agg(F.least(F.min("e.other"), F.first("e.node")).alias("to"))
        to = written(to, "graph-step")
        up = to.select(F.col("node").alias("to"), F.col("to").alias("up"))
        step = written(to.join(up, "to").select("node", F.col("up").alias("to")), "graph-step")
        steps.append(step)
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # every node of a later round is a target of the one before
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = written(step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "graph-roots")
    return roots
