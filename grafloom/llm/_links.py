"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grafloom.llm import _store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node that a link names.

    Alternates two steps (large star, small star: Kiveris et al., 2014) on the links until nothing
    changes. Each is one grouping with minima combined on the map side, and a join that splits hot
    keys; the number of rounds grows with the logarithm of a chain's length.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = _store.table(edges, "links")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    seen = None
    while True:
        # large star: each node's larger neighbours go to the smallest of the node and its neighbours
        both = edges.union(edges.select("v", "u")).toDF("u", "n")
        low = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = both.filter(F.col("n") > F.col("u")).join(low, "u").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("n"), "m").filter(F.col("n") != F.col("m")).toDF("u", "v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = _store.table(small, "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(edges.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
