"""Connected components by contraction, in Spark joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import stored


def component_ids(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (x, y)``.

    The component is the smallest ``label`` of its nodes (``labels`` has ``node, label``; null only
    if all are). In each round every node is hooked to its smallest neighbour or itself, chains are
    shortened, and what a chain ends in stands for the nodes from then on; links within one node
    vanish. The number of links falls by half at least in a round.
    """
    nodes = links.select(F.col("x").alias("node")).unionAll(links.select("y")).distinct()
    member = nodes.select("node", F.col("node").alias("top"))
    edges = links
    while not edges.isEmpty():
        both = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooked = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("top"))
        hooked = stored(hooked, "hooks")
        moved = True
        while moved:  # follow each chain to its end; its length at least halves each time
            further = hooked.select(F.col("x").alias("top"), F.col("top").alias("next"))
            jumped = hooked.join(further, "top").select("x", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved"))
            jumped = stored(jumped, "jumps")
            moved = not jumped.filter("moved").isEmpty()
            hooked = jumped.select("x", "top")
        member = stored(
            member.join(hooked.select(F.col("x").alias("top"), F.col("top").alias("next")), "top", "left").select(
                "node", F.coalesce("next", "top").alias("top")
            ),
            "members",
        )
        ends = hooked.select(F.col("x").alias("end"), "top")
        edges = stored(
            edges.join(ends.select(F.col("end").alias("x"), F.col("top").alias("a")), "x")
            .join(ends.select(F.col("end").alias("y"), F.col("top").alias("b")), "y")
            .filter("a != b")
            .select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            .distinct(),
            "links",
        )
    named = member.join(labels, "node").groupBy("top").agg(F.min("label").alias("component"))
    return member.join(named, "top").select("node", "component")
