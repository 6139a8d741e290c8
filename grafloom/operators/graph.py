"""Graph operators over nodes (title, ...) and edges (source, target, ...) as DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grafloom.functions import text as T

#: A capitalised word of four letters or more stands for an entity.
ENTITY = r"[A-Z][a-z]{3,}"


def rule_entities(units: DataFrame, text: str = "chunk", unit: str = "id") -> DataFrame:
    """(unit, title): distinct entities of each text unit."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)), F.upper))
    return units.select(F.col(unit).alias("unit"), F.explode(found).alias("title"))


def pair_edges(units: DataFrame, text: str = "chunk", unit: str = "id") -> DataFrame:
    """(unit, source, target): every pair of entities of a unit, source < target.

    Pairs are formed inside the row, so that nothing is shuffled; a unit's window bounds their number.
    """
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)), F.upper)))
    own = units.select(F.col(unit).alias("unit"), found.alias("t"))
    heads = own.select("unit", "t", F.posexplode("t").alias("i", "source"))
    return heads.select("unit", "source", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("target"))


def entity_lists(units: DataFrame, text: str = "chunk", unit: str = "id") -> DataFrame:
    """(unit, titles, n_pairs): each unit's distinct entities in order and the number of their pairs, from its own row."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)), F.upper)))
    own = units.select(F.col(unit).alias("unit"), found.alias("titles"))
    n = F.size("titles").cast("long")
    return own.withColumn("n_pairs", F.floor(n * (n - 1) / 2).cast("long"))


def merge_edges(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Undirected edges: source < target, summed weight, sorted distinct unit ids, comma-joined."""
    w = F.lit(1.0) if weight is None else weight
    return edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum(w).alias("weight"), F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("source_id"))


def merge_attribute(op: str, value: str, order: str, separator: str = ",", distinct: bool = True) -> Column:
    """An ordered fold of a group's values.

    replace, skip: last, first; concat: joined, sorted and distinct if asked; sum, max, min: missing
    is 0; average: the running mean of each value with the mean before; multiply: missing or 0 is 1.
    """
    v = F.col(value)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), v.alias("v")))), lambda x: x["v"])
    if op == "replace":
        return F.max_by(v, F.col(order))
    if op == "skip":
        return F.min_by(v, F.col(order))
    if op == "concat":
        if distinct:
            return F.array_join(F.array_sort(F.collect_set(v.cast("string"))), separator)
        return F.array_join(F.transform(ordered, lambda x: x.cast("string")), separator)
    if op in ("sum", "max", "min"):
        return {"sum": F.sum, "max": F.max, "min": F.min}[op](F.coalesce(v, F.lit(0)))
    numbers = F.transform(ordered, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    if op == "average":
        return F.aggregate(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.get(numbers, F.lit(0)), lambda a, x: (a + x) / 2)
    if op == "multiply":
        return F.aggregate(numbers, F.lit(1.0), lambda a, x: a * F.when(x == 0, 1.0).otherwise(x))
    raise ValueError(f"unknown operation: {op}")


def merge_rule(rule: str | dict) -> dict:
    """A merge rule in full: operation, separator (a comma) and whether values are distinct (they are)."""
    given = {"operation": rule} if isinstance(rule, str) else dict(rule)
    return {"operation": given["operation"], "separator": given.get("separator", ","), "distinct": given.get("distinct", True)}


def merge_by(rows: DataFrame, keys: list[str], rules: dict[str, str | dict], order: str) -> DataFrame:
    """Rows of equal keys merged, each column by its rule."""
    full = {c: merge_rule(r) for c, r in rules.items()}
    return rows.groupBy(*keys).agg(*(merge_attribute(r["operation"], c, order, r["separator"], r["distinct"]).alias(c) for c, r in full.items()))


def with_positions(nodes: DataFrame, level: int = 0) -> DataFrame:
    """Nodes of all levels with the place (x, y) that their id has on one level; ids that aren't on it are left out."""
    placed = nodes.filter(F.col("level") == level).select(F.col("id").alias("top_level_node_id"), "x", "y").distinct()
    return nodes.drop("x", "y").join(placed, F.col("id") == F.col("top_level_node_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """(title, degree), a loop counting twice; one pass over the edges."""
    return edges.select(F.explode(F.array("source", "target")).alias("title")).groupBy("title").agg(F.count("*").alias("degree"))


def combined_degree(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """Edges with source_degree, target_degree and rank, their sum; an unknown end has degree 0. An existing rank stays."""
    if "rank" in edges.columns:
        return edges
    s, t = (degree.select(F.col("title").alias(f"_{x}"), F.col("degree").alias(f"{x}_degree")) for x in ("source", "target"))
    out = edges.join(s, edges.source == s["_source"], "left").join(t, F.col("target") == t["_target"], "left").drop("_source", "_target")
    out = out.fillna(0, ["source_degree", "target_degree"])
    return out.withColumn("rank", F.col("source_degree") + F.col("target_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(title, neighbours sorted with repeats, links)."""
    both = edges.select(F.col("source").alias("title"), F.col("target").alias("n")).unionAll(edges.select("target", "source"))
    return both.groupBy("title").agg(F.array_sort(F.collect_list("n")).alias("neighbours"), F.count("*").alias("links"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/grafloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the folder that the cluster shares."""
    path = scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without one task that holds them all.

    Range partitions are numbered within, and start where the counts of those before end; the counts
    are one row per partition.
    """
    rows = _written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = rows.groupBy("_p").count()
    starts = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return rows.join(F.broadcast(starts), "_p").withColumn(to, (F.col("_start") + own).cast("long")).drop("_p", "_start")


def running_sum(rows: DataFrame, size: Column, order: list[Column], by: list[str], to: str, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows with the sum of sizes up to and with each, in order, for each key.

    Rows are cut into ranges of key and order; sums of the ranges before tell where a range begins, so
    that no task holds a key, or all rows. With ``most``, ranges that begin past it are left out.
    """
    cut = _written(rows.withColumn("_size", size.cast("double")).repartitionByRange(*(F.col(b) for b in by), *order).withColumn("_p", F.spark_partition_id()))
    sums = cut.groupBy(*by, "_p").agg(F.sum("_size").alias("_sum"))
    # one row for each key and range
    before = F.sum("_sum").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("_before", F.coalesce(before, F.lit(0.0)) + start)
    starts = starts if most is None else starts.filter(F.col("_before") <= most)
    same = F.col("_p") == F.col("_q")
    for b in by:
        same = same & cut[b].eqNullSafe(F.col(f"_{b}"))
    near = cut.join(starts.select(F.col("_p").alias("_q"), *(F.col(b).alias(f"_{b}") for b in by), "_before"), same).drop("_q", *(f"_{b}" for b in by))
    w = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn(to, (F.sum("_size").over(w) + F.col("_before")).cast("long")).drop("_size", "_p", "_before")


def connected_components(edges: DataFrame) -> DataFrame:
    """(title, component): the least title that edges reach, by alternating large and small stars (Kiveris et al., 2014)."""
    e = _written(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("title")).distinct()
    e, seen = e.filter("u <> v"), None
    while True:
        both = e.unionAll(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select("v", "m").toDF("u", "v").unionAll(low.toDF("u", "v")).distinct()
        e = _written(small)
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return nodes.join(e.toDF("title", "component"), "title", "left").select("title", F.coalesce("component", "title").alias("component"))
        seen = state


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest component (ties: least name), each oriented by name."""
    part = connected_components(edges)
    top = part.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = part.join(F.broadcast(top), "component").select("title")
    return edges.join(inside, edges.source == inside.title, "left_semi").withColumns({"source": F.least("source", "target"), "target": F.greatest("source", "target")})


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Of weighted edges under (title, community)."""
    a, b = communities.toDF("_s", "_a"), communities.toDF("_t", "_b")
    e = edges.join(a, edges.source == F.col("_s")).join(b, F.col("target") == F.col("_t"))
    m = e.agg(F.sum("weight")).first()[0]
    if not m:
        return 0.0
    ends = e.select(F.explode(F.array(F.struct(F.col("_a").alias("c"), "weight"), F.struct(F.col("_b").alias("c"), "weight"))).alias("x")).groupBy("x.c").agg(F.sum("x.weight").alias("d"))
    inside = e.filter(F.col("_a") == F.col("_b")).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    return inside / m - ends.agg(F.sum(F.pow(F.col("d") / (2 * m), 2))).first()[0]


def clustered_nodes(nodes: DataFrame, communities: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Nodes on every level of their communities with degree, number and an id that follows from the title.

    Unclustered nodes stay on level 0 with a null community. Numbers are dense in title order, from 0;
    titles of ``known`` (title, human_readable_id) keep theirs, and others go on from the greatest.
    """
    if known is None:
        ids = number_rows(nodes, ["title"], "human_readable_id")
    else:
        start = known.agg(F.coalesce(F.max("human_readable_id") + 1, F.lit(0)).alias("_start"))  # one row
        fresh = number_rows(nodes.join(known.select("title"), "title", "left_anti"), ["title"], "_n").join(F.broadcast(start))
        ids = nodes.join(known, "title").unionByName(fresh.withColumn("human_readable_id", F.col("_n") + F.col("_start")).drop("_n", "_start"))
    out = ids.withColumn("id", F.md5("title")).join(communities.select("title", "level", "community"), "title", "left").join(degrees(edges), "title", "left")
    return out.withColumns({"level": F.coalesce("level", F.lit(0)), "degree": F.coalesce("degree", F.lit(0)).cast("int")})


def clustered_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges once for each level of (level, ...) communities, with level, a number that is dense in the order of ends, and an id of its own.

    Levels are as many as the hierarchy is deep; without any there is level 0.
    """
    deepest = communities.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    rows = number_rows(edges, ["source", "target"], "human_readable_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    return rows.withColumn("id", T.uuid4_hex("source", "target", "level"))


def zero_layout(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "size": F.col("degree")})


def pca_layout(embeddings: DataFrame) -> DataFrame:
    """(title, x, y): the two main axes of node embeddings, as a stand-in for a nonlinear layout."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embeddings.select("title", array_to_vector("embedding").alias("v"))
    p = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("title", p[0].alias("x"), p[1].alias("y"))


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, xml): an element per node and edge, for export."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda df, skip: F.concat_ws("", *(F.concat(F.lit(f'<data key="{c}">'), esc(c), F.lit("</data>")) for c in df.columns if c not in skip))
    n = nodes.select(F.lit("node").alias("kind"), F.concat(F.lit('<node id="'), esc("title"), F.lit('">'), data(nodes, ("title",)), F.lit("</node>")).alias("xml"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat(F.lit('<edge source="'), esc("source"), F.lit('" target="'), esc("target"), F.lit('">'), data(edges, ("source", "target")), F.lit("</edge>")).alias("xml"))
    return n.unionAll(e)


def merge_selected(nodes: DataFrame, links: DataFrame, selected: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge nodes (id, ord, size) into the first selected one; re-point links (ord, source, target), drop inner and repeated ones."""
    first = nodes.filter(F.col("id").isin(selected)).agg(F.min_by("id", "ord").alias("id")).first()[0]
    to = lambda c: F.when(F.col(c).isin(selected), F.lit(first)).otherwise(F.col(c))
    merged = nodes.groupBy(to("id").alias("id")).agg(F.min("ord").alias("ord"), F.max("size").alias("size"))
    moved = links.select("ord", to("source").alias("source"), to("target").alias("target")).filter("source <> target")
    return merged, moved.groupBy("source", "target").agg(F.min("ord").alias("ord"))


def recolour(nodes: DataFrame, selected: list[str], colour: Column) -> DataFrame:
    return nodes.withColumn("color", F.when(F.col("id").isin(selected), colour).otherwise(F.col("color")))
