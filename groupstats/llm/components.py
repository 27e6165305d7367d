"""Connected components of a link table by repeated smallest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupstats.session import shared_folder


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``: root is the smallest node that can be reached.

    Alternates two steps until nothing changes: hang the larger neighbours of every node on its smallest
    one, then the smaller ones too. Each round is written to the shared folder, so a lost executor costs
    one round. The number of rounds grows with the logarithm of the longest path. A node of many links
    is met as counts and minima combined before the shuffle, and as rows of a join that can be split.
    """
    spark = links.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    edges = keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links"
    )
    nodes = edges
    while True:
        # large step: every node's larger neighbours go to its smallest neighbour or itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u != v").distinct(), "large")
        # small step: a node's smaller neighbours, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark(small) == mark(edges):
            break
        edges = small
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
