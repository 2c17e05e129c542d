"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, if_small

ROW = 64  # bytes of a vertex in a hashed table, at most


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: long) to (id, label): label is the least id reachable.

    Each round points every vertex at its least neighbour, jumps pointers until
    each tree is a star, and contracts the stars; the number of rounds grows
    with the logarithm of the longest chain.  Sums per vertex are combined
    before the shuffle, and the table that vertices are looked up in is
    broadcast while its counted rows fit (a vertex with very many edges then
    meets no shuffle) and split by adaptive execution beyond.  Ids that are in
    no edge are in no row; self-loops only add their vertex.
    """
    e = scratch.table(edges.select("a", "b").distinct())
    labels = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        p = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("up")))
        while True:
            q = if_small(p.select(F.col("id").alias("up"), F.col("up").alias("top")), ROW)
            n = scratch.table(p.join(q, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            p = n.select("id", "up")
            if n.where("moved").isEmpty():
                break
        if labels is None:
            labels = p.select("id", F.col("up").alias("label"))
        else:
            q = if_small(p.select(F.col("id").alias("label"), F.col("up").alias("top")), ROW)
            labels = scratch.table(labels.join(q, "label", "left").select("id", F.coalesce("top", "label").alias("label")))
        pa, pb = (if_small(p.toDF(x, f"r{x}"), ROW) for x in "ab")
        e = scratch.table(e.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if e.isEmpty():
            return labels
