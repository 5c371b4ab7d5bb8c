"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import spread_join, staged


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of the links (columns ``a`` and ``b``).

    Every round points each node at its smallest neighbour, then replaces the ends of all links by what they point at
    and drops links within one node. Rounds end when no link is left; each is written to the shared folder, and the
    driver learns only how many links remain. A node with a third of all links is dealt out over several tasks.
    """
    edges = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    steps = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node")
        to = staged(to, "pointers")
        steps.append(to)
        left = spread_join(edges, to.select(F.col("node").alias("a"), F.col("to").alias("ta")), ["a"], F.xxhash64("b"), "inner")
        right = spread_join(left, to.select(F.col("node").alias("b"), F.col("to").alias("tb")), ["b"], F.xxhash64("a"), "inner")
        edges = staged(
            right.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), "links"
        )
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    found = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), "to")
        found = spread_join(found, nxt, ["root"], F.xxhash64("node"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
