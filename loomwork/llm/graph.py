"""Connected components of links between documents, in Spark from begin to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discarded, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it is linked to, over any number of links.

    Each round, a node takes the smallest root among its neighbours', and then that root's root; so a chain of n links takes
    about log n rounds. Every round is a table in the shared folder, deleted when the next one is there. Only whether a root changed is collected.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # First every node is linked to its smallest neighbour, and so are its other neighbours below it: the many links of a
    # large group that share their ends become few.
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    few = written(smallest.select("a", F.col("m").alias("b")).union(others).distinct(), "stars")
    both = few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    before = roots = written(both.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), F.least("a", "root").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        own = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jumped = own.join(roots.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        after = written(jumped.select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        discarded(before)
        before, roots = after, after.select("node", "root")
        if after.where("was <> root").limit(1).isEmpty():
            discarded(few, both)
            roots.shared_path = after.shared_path
            return roots
