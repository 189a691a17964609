"""Connected components of a link table, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: the smallest node reachable.

    Every round gives each node the smallest root among its own and its
    neighbours', hooks the old root onto it, and then halves the paths; rounds
    grow with the logarithm of a component's width.  Both sides of every join are
    written tables, so that a join that is dealt unevenly can be split.
    """
    both = cut(links.select("a", "b").where("a <> b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        # the smallest root around a node, offered to the node and to its old root
        around = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        offers = cut(roots.join(around, roots["node"] == around["a"]).select("node", "root", F.least("root", "near").alias("best")))
        moved = offers.where("best < root")
        if moved.isEmpty():
            return roots
        hooks = offers.select("node", F.col("best").alias("root")).unionAll(moved.select(F.col("root").alias("node"), F.col("best").alias("root")))
        roots = cut(hooks.groupBy("node").agg(F.min("root").alias("root")))
        while True:  # paths are halved until every node points at a root
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top")).where("root <> top")
            if up.isEmpty():
                break
            shorter = cut(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            done = shorter.where("moved").isEmpty()
            roots = shorter.select("node", "root")
            if done:
                break
