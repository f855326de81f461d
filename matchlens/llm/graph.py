"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node reachable.

    Each round a node takes the least root among its neighbours' and its own, and then the
    root of that root, so a chain is halved at least; rounds grow with the logarithm of the
    longest path. Each round writes its table and drops its lineage. Minima are combined
    before they are shuffled; joins on a node with many links are left for adaptive
    execution to split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = written(roots.select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        seen = (
            both.join(roots, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("seen"))
        )
        nearer = roots.join(seen, "node").select(
            "node", "root", F.least("root", "seen").alias("least")
        )
        nearer = written(nearer, "roots")
        above = nearer.select(F.col("node").alias("least"), F.col("least").alias("next"))
        jumped = nearer.join(above, "least").select(
            "node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")
        )
        jumped = written(jumped, "roots")
        roots = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return roots
