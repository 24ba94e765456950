"""Connected components by contraction, for links between 64-bit node hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piecework.llm.common import cut


def contract(links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """node, component for every node of `links` (a, b) and `members` (node, component so far).

    In each round every component moves to its least neighbour and links are carried over. Node hashes are in
    random order, so a constant share of the components goes in a round and the rounds grow with the logarithm
    of the longest path. Hubs are no trouble: minima are combined before they are shuffled.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if members is None:
        found = nodes.withColumn("component", F.col("node"))
    else:
        found = members.join(nodes, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
        links = _moved(links, members.withColumnsRenamed({"node": "at", "component": "to"}))
    found = cut(found, "components")
    while True:
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return found
        both = links.union(links.select("b", "a"))
        steps = cut(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to")).where("to < at"), "steps")
        found = cut(
            found.join(steps, found["component"] == steps["at"], "left").select("node", F.coalesce("to", "component").alias("component")),
            "components",
        )
        links = _moved(links, steps)


def _moved(links: DataFrame, steps: DataFrame) -> DataFrame:
    one = links.join(steps, links["a"] == steps["at"], "left").select(F.coalesce("to", "a").alias("a"), "b")
    return one.join(steps, one["b"] == steps["at"], "left").select("a", F.coalesce("to", "b").alias("b"))
