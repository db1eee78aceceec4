"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparksync.session import checkpointed, drop_superseded


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node it reaches.

    Alternates two star contractions, each a map-side combined minimum and a
    join. A hub's rows are spread by the adaptive skew join. The number of
    rounds is logarithmic in the length of the longest chain.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    links = checkpointed(links)
    before = None
    while True:
        both = links.union(links.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.join(low, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        links = checkpointed(
            links.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        del low, both
        drop_superseded(edges.sparkSession)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
