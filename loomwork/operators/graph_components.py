"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.staging import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node.

    Each round links a node to the smallest node of its neighbourhood, jumps twice
    along these links, and contracts the edges; contracted edges shrink at least by
    half in every component that is not yet one node.  Every round is a staged
    table, so no lineage grows and a lost executor costs one round.
    """
    live = stage(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter("a is not null and b is not null").distinct(),
        "edges",
    )
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    live = live.filter("a <> b")
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        for _ in range(2):
            onward = step.select(F.col("a").alias("to"), F.col("to").alias("further"))
            step = step.join(onward, "to").select("a", F.col("further").alias("to"))
        step = stage(step, "jump")
        move = step.select(F.col("a").alias("component"), "to")
        labels = stage(labels.join(move, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = step.select(F.col("a").alias("x"), "to")
        live = live.join(ends.withColumnRenamed("x", "a").withColumnRenamed("to", "p"), "a").join(ends.withColumnRenamed("x", "b").withColumnRenamed("to", "q"), "b")
        live = stage(live.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    return labels
