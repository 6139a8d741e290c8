"""A force-directed layout as joins, and the document of nodes and links that a viewer takes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from grafloom.operators import communities, graph

#: Colours of communities, in turn.
COLOURS = ("#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5", "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5")


def _repulsion(at: DataFrame, side: float, levels: int) -> DataFrame:
    """(node, fx, fy): what pushes each node away from the others, from sums over cells of ever coarser grids.

    On the finest grid the nine cells around a node act, on each coarser one the cells around its parent's
    that no finer grid has counted; a cell acts from its centroid, with its number of nodes.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("l")
    cell = lambda c: F.floor(F.col(c) / (side * F.pow(F.lit(2.0), F.col("l")))).cast("long")
    placed = graph._written(at.select("node", "x", "y", level).withColumns({"cx": cell("x"), "cy": cell("y")}))
    cells = graph._written(placed.groupBy("l", "cx", "cy").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")))
    span = F.sequence(F.lit(-3), F.lit(3))
    near = cells.select("l", "cx", "cy", F.explode(span).alias("dx")).select("l", "cx", "cy", "dx", F.explode(span).alias("dy"))
    half = lambda c, d: F.floor((F.col(c) + F.col(d)) / 2) - F.floor(F.col(c) / 2)
    touching = (F.abs("dx") <= 1) & (F.abs("dy") <= 1)
    # the coarsest grid counts all that it sees
    counted = F.when(F.col("l") == 0, touching | ((F.abs(half("cx", "dx")) <= 1) & (F.abs(half("cy", "dy")) <= 1))).otherwise(~touching & (F.abs(half("cx", "dx")) <= 1) & (F.abs(half("cy", "dy")) <= 1))
    seen = near.filter(counted).select("l", F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    acting = graph._written(seen.join(cells, ["l", "cx", "cy"]).select("l", F.col("ox"), F.col("oy"), ((F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy"))).alias("own"), "n", "mx", "my"))
    both = placed.join(acting, (placed["l"] == acting["l"]) & (placed["cx"] == acting["ox"]) & (placed["cy"] == acting["oy"]))
    # in its own cell a node doesn't push itself
    n = F.col("n") - F.col("own").cast("int")
    mx, my = (F.when(F.col("own"), (F.col(m) * F.col("n") - F.col(c)) / n).otherwise(F.col(m)) for m, c in (("mx", "x"), ("my", "y")))
    dx, dy = F.col("x") - mx, F.col("y") - my
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-4))
    return both.filter(n > 0).groupBy("node").agg(F.sum(n * dx / d2).alias("fx"), F.sum(n * dy / d2).alias("fy"))


def force_layout(edges: DataFrame, iterations: int = 30, seed: int = 1) -> DataFrame:
    """(title, x, y) of undirected edges (source, target): nodes push each other away, edges pull them together (Fruchterman and Reingold).

    A node's place at first follows from its title; steps shrink to nothing. Joined nodes lie about one
    apart. An iteration works on sums over cells and on edges, never on pairs of nodes.
    """
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    names = graph._written(graph.number_rows(pairs.select(F.explode(F.array("a", "b")).alias("title")).distinct(), ["title"], "node"))
    to = lambda t, n: names.select(F.col("title").alias(t), F.col("node").alias(n))
    half = pairs.join(to("a", "u"), "a").join(to("b", "v"), "b").select("u", "v")
    links = graph._written(half.unionAll(half.select("v", "u")))
    n = names.count()
    width = math.sqrt(max(1, n))
    place = lambda k: F.pmod(F.xxhash64("title", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20) * width
    at = graph._written(names.select("node", place(1).alias("x"), place(2).alias("y")))
    for i in range(iterations):
        heat = width / 8 * (1 - i / iterations) + 0.01
        apart = _repulsion(at, 2.0, max(1, math.ceil(math.log2(width)) - 1))
        ends = links.join(at.select(F.col("node").alias("u"), "x", "y"), "u").join(at.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
        dx, dy = F.col("vx") - F.col("x"), F.col("vy") - F.col("y")
        pull = ends.groupBy(F.col("u").alias("node")).agg(F.sum(dx * F.sqrt(dx * dx + dy * dy)).alias("px"), F.sum(dy * F.sqrt(dx * dx + dy * dy)).alias("py"))
        sx, sy = (F.coalesce(F.col(f"f{c}"), F.lit(0.0)) + F.coalesce(F.col(f"p{c}"), F.lit(0.0)) for c in "xy")
        length = F.greatest(F.sqrt(sx * sx + sy * sy), F.lit(1e-9))
        step = F.least(length, F.lit(heat)) / length
        at = graph._written(at.join(apart, "node", "left").join(pull, "node", "left").select("node", (F.col("x") + sx * step).alias("x"), (F.col("y") + sy * step).alias("y")))
    return at.join(names, "node").select("title", "x", "y")


def viewer_graph(nodes: DataFrame, edges: DataFrame, resolution: float = 0.5, iterations: int = 30) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) as a viewer takes them, rows of the document's two lists.

    ``nodes``: (title, type, description); ``edges``: (source, target, weight, description). Nodes are numbered
    in title order, coloured by constant-Potts communities and placed by forces, 20 units to one.
    """
    parts, places = communities.constant_potts(edges.select("source", "target", "weight"), resolution), force_layout(edges, iterations)
    order = F.dense_rank().over(Window.orderBy("community")) - 1
    turn = parts.select("community").distinct().withColumn("turn", F.pmod(order, F.lit(len(COLOURS))))  # a row for each community
    colour = F.get(F.array(*(F.lit(c) for c in COLOURS)), F.col("turn"))
    ids = graph._written(graph.number_rows(places, ["title"], "id"))
    told = F.concat(F.lit("TYPE: "), F.coalesce("type", F.lit("")), F.lit("\n\n\n "), F.coalesce("description", F.lit("")))
    text = F.coalesce(told, F.lit(""))
    rows = ids.join(parts, "title").join(turn, "community").join(nodes.select("title", "type", "description"), "title", "left")
    data = F.struct(F.array(F.struct("id", text.alias("text"))).alias("texts"), colour.alias("color"), F.lit(2).alias("size"))
    made = rows.select("id", data.alias("data"), F.col("title").alias("name"), F.lit(0).alias("vx"), F.lit(0).alias("vy"), (F.col("x") * 20).alias("x"), (F.col("y") * 20).alias("y"))
    to = lambda t, n: ids.select(F.col("title").alias(t), F.col("id").alias(n))
    kept = graph.number_rows(edges.filter("source <> target"), ["source", "target"], "n").join(to("source", "s"), "source").join(to("target", "t"), "target")
    told = F.struct(F.col("n").alias("id"), F.coalesce("description", F.lit("")).alias("explanation"), F.lit("#000000").alias("color"))
    return made, kept.select(F.col("s").alias("source"), F.col("t").alias("target"), told.alias("data"))
