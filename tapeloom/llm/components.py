"""Connected components by alternating star contractions, all in DataFrames.

Each round turns every node's neighbours towards its smallest one (large star,
then small star); the rounds needed grow with the logarithm of the longest
chain.  Edges of each round are staged in the shared folder, so lineage stays
short and lost executors cost one round at most.  Minima are pre-aggregated.  A node with
very many edges is not joined by key: such nodes are few, for a node counts as
hot from an edge share on that at most ``2 * HOT_SHARE`` nodes can have, and their minima are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.util import discard, staged


#: A node is hot if it has over 1 / HOT_SHARE of the edges, and HOT_EDGES at least.
HOT_SHARE, HOT_EDGES = 10_000, 1_000


def _with_least(edges: DataFrame, least: Column, limit: int) -> DataFrame:
    """``edges`` (u, v) with m, the least of ``least`` over the edges of u."""
    low = edges.groupBy("u").agg(F.min(least).alias("m"), F.count("*").alias("n"))
    hot = low.where(F.col("n") > limit).select("u", F.col("m").alias("hot"))
    # Each hot node has over ``limit`` of the edges, so there are at most 2 * HOT_SHARE
    marked = edges.join(F.broadcast(hot), "u", "left")
    # Edges of hot nodes have their minimum; in the join they are spread by salts that meet nothing
    salt = F.when(F.col("hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(1023))).cast("int")
    joined = marked.withColumn("s", salt).join(low.select("u", "m", F.lit(0).alias("s")), ["u", "s"], "left")
    return joined.select("u", "v", F.coalesce("hot", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge to another, with the smallest node it reaches."""
    # Directed from the larger to the smaller node.
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "edges")
    state, n = None, e.count()
    while True:
        # Stars have one edge for each of e's at most
        limit = max(HOT_EDGES, n // HOT_SHARE)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least("u", "v"), limit).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = _with_least(large, F.col("v"), limit).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        before, e = e, staged(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct(), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
