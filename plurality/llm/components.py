"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller,
    follows the hooks to their ends by pointer jumping and contracts the edges.
    All steps are equi-joins and aggregations; hubs are joined from checkpointed
    sides, which adaptive execution can split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    left = cut(both)
    member = cut(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not left.isEmpty():
        hook = cut(left.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"))
        while True:
            onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = cut(hook.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hook = jumped.select("a", "to")
            if jumped.filter("moved").isEmpty():
                break
        to = hook.select(F.col("a").alias("old"), F.col("to").alias("new"))
        member = cut(member.join(to, member["root"] == to["old"], "left").select("node", F.coalesce("new", "root").alias("root")))
        moved = left.join(to, left["a"] == to["old"], "left").select(F.coalesce("new", "a").alias("a"), "b")
        moved = moved.join(to, moved["b"] == to["old"], "left").select("a", F.coalesce("new", "b").alias("b"))
        left = cut(moved.filter("a <> b").distinct())
    return member
