"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest id reachable) of all nodes of edges u, v.

    Each round every node takes its smallest neighbour as parent and then that parent's parent, and edges between
    parents replace the edges; paths shrink geometrically. Rounds end in written tables, so plans stay short and lost
    executors cost no more than one round.
    """
    edges = write_table(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        far = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parents = write_table(near.join(far, "p").select("u", "pp"), "parents")
        labels = write_table(
            labels.join(parents, labels.comp == parents.u, "left").select("node", F.coalesce("pp", "comp").alias("comp")),
            "labels",
        )
        ends = parents.select(F.col("u").alias("v"), F.col("pp").alias("b"))
        edges = write_table(
            edges.join(parents, "u")
            .select("v", F.col("pp").alias("a"))
            .join(ends, "v")
            .filter("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct(),
            "edges",
        )
    return labels
