"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marquee.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``links`` (u, v).

    A large star hangs all larger neighbours of a node below its smallest one; a
    small star does so with the smaller ones. Both only need the smallest
    neighbour per node, a map-side aggregate, so a node with very many links is
    no hot group. The number of rounds is logarithmic in the longest path. Each
    round is written to the shared folder.
    """
    edges = written(_down(links))
    before = None
    while True:
        nodes = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = nodes.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = nodes.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(_down(small.unionByName(lowest.withColumnRenamed("m", "v"))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
