"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour (the larger ones, or all not larger and the node) is tied to the least."""
    e = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # small: u > v, so v are the smaller neighbours of u
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = e.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for the nodes of (a, b) edges that are not roots.

    Each round is stored in the shared folder. Rounds go on until one changes nothing; stars about
    halve a component's depth in each, so they grow with the logarithm of the longest path.

    Defined cases: edges with a null end and loops are left out; repeated edges count once; an empty
    table gives no rows.
    """
    e = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        e = stored(_star(_star(e, True), False), "edges")
        # in the fixed state every node has one edge, to a root that has none
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == last or not now["n"]:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
