"""Connected components of an edge table, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.llm.storage import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge table (a, b), label being the smallest node of its component.

    Alternates large-star and small-star steps: in the first every node sends its larger
    neighbours to the smallest one around it, in the second its smaller ones. Each step has at
    most as many edges as the one before; the edges end as stars around the labels. A table is
    written after each round; edges that still change after `rounds` of them are an error. Self-loops and repeated edges are harmless; edges with a null end are left out.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join has two plain sides and a node with very many neighbours can be split over tasks.
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Here every edge goes from the larger end to the smaller.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the edges of the components have not settled in {rounds} rounds")
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
