"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.sources.sinks import materialize


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node
    that it reaches.

    Each round hooks every node to the least component among its neighbours
    and then follows that component's own hook (pointer jumping), so the
    rounds grow with the logarithm of a chain's length, not with the length.
    The state is written after each round: no lineage grows and a lost
    executor costs one round's tasks at most. Links from a node to itself only
    name the node."""
    spark = links.sparkSession
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ends = materialize(spark, ends, f"{name}-links")
    state = materialize(spark, ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), name)
    while True:
        best = (ends.join(state, ends["b"] == state["node"]).groupBy("a").agg(F.min("component").alias("offer")))
        hooked = (state.join(best, state["node"] == best["a"])
                       .select("node", F.col("component").alias("was"), F.least("component", "offer").alias("to")))
        of = state.select(F.col("node").alias("_hook"), F.col("component").alias("_on"))
        new = materialize(spark, hooked.join(of, F.col("to") == F.col("_hook"), "left")
                          .select("node", "was", F.least("to", F.coalesce("_on", "to")).alias("component")), name)
        state = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return state
