"""Retrieval: candidate filters, vector search, rankings, occurrence weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", include: DataFrame | list | None = None) -> DataFrame:
    """The ``k`` rows (id, vector) nearest to one vector, with score 1 - distance; ids may be restricted first, by a list (an empty one restricts nothing) or a table (id).

    Planned as a bounded top-k per partition and one merge.
    """
    rows = vectors.filter(F.col("vector").isNotNull())
    if isinstance(include, DataFrame):
        rows = rows.join(include.select("id").distinct(), "id", "left_semi")
    elif include:
        rows = rows.filter(F.col("id").isin(include))
    q = F.array(*(F.lit(float(x)) for x in query))
    d = squared_distance(F.col("vector").cast("array<double>"), q) if metric == "l2" else 1 - cosine(F.col("vector").cast("array<double>"), q)
    return rows.withColumn("distance", d).orderBy("distance", "id").limit(k).withColumn("score", 1 - F.abs("distance"))


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest rows of every query (query_id, query); queries are few and checked to be.

    At most 1000 queries go to every task; rows are scanned once in batches, a task keeps its k nearest
    of each query, and only those are shuffled.
    """
    asked = [(r.query_id, [float(x) for x in r.query]) for r in queries.limit(1001).collect()]
    if len(asked) > 1000:
        raise ValueError("over 1000 queries: search them by an index")
    asked = [(i, np.array(q)) for i, q in asked]

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {i: pd.DataFrame({"id": [], "distance": []}) for i, _ in asked}
        for f in frames:
            x = np.array(f["vector"].tolist(), np.float64).reshape(len(f), -1)
            for i, q in asked:
                near = pd.DataFrame({"id": f["id"], "distance": ((x - q) ** 2).sum(1) if len(f) else []})
                kept[i] = pd.concat([kept[i], near.nsmallest(k, "distance", keep="all")]).sort_values(["distance", "id"]).head(k)
        for i, rows in kept.items():
            if len(rows):
                yield pd.DataFrame({"query_id": i, "id": rows["id"].astype("int64") if kind in ("bigint", "int") else rows["id"], "distance": rows["distance"].astype(float)})

    kind = dict(vectors.dtypes)["id"]
    own = vectors.filter(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    rows = own.mapInPandas(best, f"query_id long, id {kind}, distance double")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)


def centroid(vectors: DataFrame, by: str | None = None) -> DataFrame:
    """(key, pos, mean) per component; partial sums before the shuffle."""
    key = F.col(by) if by else F.lit(0)
    return vectors.select(key.alias("key"), F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x")).groupBy("key", "pos").agg(F.avg("x").alias("mean"))


def embedding_mean(pieces: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, vector): mean of a text's piece vectors, by weight if given, scaled to length 1; a text without pieces has null."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = pieces.select("id", F.posexplode_outer("vector").alias("pos", "x"), w.alias("w"))
    sums = rows.groupBy("id", "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    lists = sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "m")))), lambda p: p["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return lists.select("id", F.when(F.size("v") > 0, F.transform("v", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))).alias("vector"))


def map_query_to_entities(entities: DataFrame, query: list[float] | None, k: int = 10, include: list[str] = (), exclude: list[str] = (), oversample: int = 2) -> DataFrame:
    """Entities (id, title, rank, vector) for a query: twice k nearest, without the excluded, not cut to k; forced ones come first.

    Without a query vector, the k of highest rank.
    """
    forced = entities.filter(F.col("title").isin(list(include))).withColumn("order", F.lit(-1.0))
    if not query:
        found = entities.orderBy(F.desc("rank"), "id").limit(k).withColumn("order", -F.col("rank").cast("double"))
    else:
        near = nearest(entities, query, k * oversample).select(F.col("id").alias("_i"), F.col("distance").alias("order"))
        found = entities.join(F.broadcast(near), F.col("id") == F.col("_i")).drop("_i")
    return forced.unionByName(found.filter(~F.col("title").isin([*exclude, *include])))


def neighbours_by_rank(entities: DataFrame, edges: DataFrame, title: str, k: int = 10, exclude: list[str] = ()) -> DataFrame:
    """The ``k`` neighbours of one entity with highest rank."""
    ends = edges.filter((F.col("source") == title) | (F.col("target") == title)).select(F.explode(F.array("source", "target")).alias("title")).distinct()
    return entities.join(ends, "title", "left_semi").filter(~F.col("title").isin([*exclude, title])).orderBy(F.desc("rank"), "title").limit(k)


def network_flags(edges: DataFrame, selected: DataFrame, title: str = "title") -> DataFrame:
    """Edges with src_in and tgt_in: whether the ends are selected."""
    a, b = (selected.select(F.col(title).alias(f"_{x}")).distinct() for x in "ab")
    out = edges.join(a, edges.source == a["_a"], "left").join(b, F.col("target") == b["_b"], "left")
    return out.withColumns({"src_in": F.col("_a").isNotNull(), "tgt_in": F.col("_b").isNotNull()}).drop("_a", "_b")


def ranked_relationships(edges: DataFrame, entities: DataFrame, by: str = "rank") -> DataFrame:
    """Edges with ``order_value``, greatest first (ties: source, target).

    The value is the column or the attribute (a map ``attributes``) named ``by``, as a whole number; ``weight`` as it is,
    null as 0; or, where edges have neither, the ranks of both ends (title, rank) added, an unknown end or rank being 0.
    """
    if by == "weight":
        return edges.withColumn("order_value", F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).orderBy(F.desc("order_value"), "source", "target")
    held = None
    if by in edges.columns:
        held = F.col(by).try_cast("long")
    elif dict(edges.dtypes).get("attributes", "").startswith("map") and edges.filter(F.map_contains_key("attributes", by)).limit(1).count():
        held = F.col("attributes")[by].try_cast("long")
    if held is not None:
        return edges.withColumn("order_value", F.coalesce(held, F.lit(0).cast("long")).cast("double")).orderBy(F.desc("order_value"), "source", "target")
    rank = entities.groupBy("title").agg(F.max("rank").alias("rank"))
    a, b = (rank.select(F.col("title").alias(f"_{x}"), F.coalesce("rank", F.lit(0)).alias(f"_{x}_rank")) for x in "ab")
    both = edges.join(a, edges.source == a["_a"], "left").join(b, F.col("target") == b["_b"], "left")
    value = F.coalesce("_a_rank", F.lit(0)) + F.coalesce("_b_rank", F.lit(0))
    return both.withColumn("order_value", value.cast("double")).drop("_a", "_b", "_a_rank", "_b_rank").orderBy(F.desc("order_value"), "source", "target")


def select_relationships(edges: DataFrame, selected: DataFrame, top_k: int, rank: str = "rank", title: str = "title", most: int | None = None) -> DataFrame:
    """All edges inside the selection, then those that leave it by (links of the outside end, rank), at most top_k for each selected; with at most one such edge no limit.

    ``most``: how many are selected, if known; more are an error. They are broadcast only if they are at most 10,000.
    """
    if most is not None and selected.select(title).distinct().limit(most + 1).count() > most:
        raise ValueError(f"over {most} are selected")
    flagged = network_flags(edges, F.broadcast(selected) if most is not None and most <= 10_000 else selected, title)
    inside = flagged.filter("src_in AND tgt_in").withColumn("links", F.lit(0).cast("long"))
    out = flagged.filter("src_in <> tgt_in").withColumn("outside", F.when(F.col("src_in"), F.col("target")).otherwise(F.col("source"))).withColumn("inside", F.when(F.col("src_in"), F.col("source")).otherwise(F.col("target")))
    links = out.groupBy("outside").agg(F.countDistinct("inside").alias("links"))
    budget = top_k * (selected.select(title).distinct().count() if most is None else most)
    out = out.join(links, "outside").orderBy(F.desc("links"), F.desc(rank), "source", "target").limit(max(budget, 1)).drop("outside", "inside")
    return inside.unionByName(out)


def occurrence_weight(membership: DataFrame, by: str, unit: str, normalize: bool = True) -> DataFrame:
    """(by, weight): distinct units, over the largest count if asked; with no units at all the weight is 0."""
    n = membership.groupBy(by).agg(F.countDistinct(unit).alias("n"))
    if not normalize:
        return n.withColumnRenamed("n", "weight")
    top = n.agg(F.max("n").alias("_top"))
    return n.join(F.broadcast(top)).select(by, F.when(F.col("_top") > 0, F.col("n") / F.col("_top")).otherwise(0.0).alias("weight"))


def latest_community(nodes: DataFrame, level: int) -> DataFrame:
    """(title, community): the largest community number of each title on levels up to ``level``."""
    return nodes.filter(F.col("level") <= level).groupBy("title").agg(F.max(F.col("community").cast("int")).alias("community"))
