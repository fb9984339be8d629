"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a partial minimum per node and a join, so a node of any degree is
combined before the shuffle and split by adaptive skew joins after it. Nothing is
collected; every step's edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """edges: a > b. Large star (both): link every larger neighbour to the smallest one
    of a or a itself. Small star: link a and its smaller neighbours to the smallest."""
    if both:
        sym = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b")
    return out.filter("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of links(a, b): comp is the smallest node reachable.

    Null ends and self-links are ignored. Ends when a round changes nothing.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges", keep=False)
    state = None
    for _ in range(max_rounds):
        large = materialize(_stars(edges, True), "large-star", keep=False)
        small = materialize(_stars(large, False), "small-star", keep=False)
        drop_table(edges)
        drop_table(large)
        edges = small
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)
