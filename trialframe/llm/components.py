"""Connected components of an edge table, by alternating stars.

Each round replaces edges by edges to the smallest neighbour, first from larger to
smaller nodes and then among the larger ones, until every component is a star.
The number of rounds grows with the logarithm of the component's size. Edges stay
in Spark; only two numbers a round reach the driver. Minima combine before they
are shuffled, and the join to them is one that Spark can split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import drop_path, fresh_path, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b for linked nodes, to (node, root); roots are the smallest nodes.

    Nodes without an edge, and the roots themselves, are not listed.
    """
    spark = edges.sparkSession
    first = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    # written once: a round reads its edges several times
    edges, before, old = stored(first, "edges"), None, None
    for _ in range(MAX_ROUNDS):
        path = fresh_path(spark, "stars")
        _small_star(_large_star(edges) if old else edges).write.parquet(path)
        edges = spark.read.parquet(path)
        n, s = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if old:
            drop_path(spark, old)
        if (n, s) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, old = (n, s), path
    raise RuntimeError("components did not settle")
