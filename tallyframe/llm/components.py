"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, settle


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is one node of its component, the same for all of it.

    Each round maps every node to the least of itself and its neighbours and contracts the edges by that map; the
    number of rounds grows with the logarithm of the longest shortest path, and the edges only become fewer. Minima are
    taken by partial aggregation, so a hub costs one row for each task. The edges of each round and the result are written
    to the shared folder; the rounds' maps are kept between, and come again from the edges if an executor is lost.
    Null ends and loops are dropped; repeated edges do not matter; no edges, no rows.
    """
    edges = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct())
    tables, maps = [edges], []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "from").persist()
        maps.append(least)
        ends = edges.join(least.select(F.col("from").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        ends = ends.join(least.select(F.col("from").alias("b"), F.col("to").alias("b2")), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = settle(ends.filter("a != b").distinct())
        tables.append(edges)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = maps[0].select(F.col("from").alias("node"), F.col("to").alias("root"))
    for least in maps[1:]:
        nodes = nodes.join(least, nodes["root"] == least["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
    nodes = settle(nodes)
    for least in maps:
        least.unpersist()
    release(*tables)
    return nodes
