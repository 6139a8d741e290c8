"""Random walks over a weighted graph with a bias by where they come from, and node embeddings from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grafloom.operators import graph

#: Neighbours in one row of a segment; a hub has as many segments as it takes.
SEGMENT = 1024
#: Steps between two tables that cut the lineage.
ROUNDS = 4


def weighted_neighbours(edges: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Classes (title, mass, classes) and segments (title, class, segment, near) of undirected edges.

    A node's neighbours are put into classes by the least power of two that is no smaller than the weight, and a
    class into segments of fixed length. A class weighs its length times that power: to choose a class by that, any
    place in it, and to accept with the weight over the power takes each neighbour in proportion to its weight, and
    at least every second choice is accepted. No row grows with a node's degree: a node has at most some two
    thousand classes, as a double has so many exponents. Weights of one pair add up, missing ones are 1; edges
    with a null end or without a positive finite weight are left out; a loop is one neighbour.
    """
    e = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    e = e.select("source", "target", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).filter("source IS NOT NULL AND target IS NOT NULL AND weight > 0 AND weight < double('Infinity')")
    both = e.unionAll(e.filter("source <> target").select("target", "source", "weight")).toDF("title", "near", "weight")
    near = both.groupBy("title", "near").agg(F.sum("weight").alias("weight")).withColumn("class", F.ceil(F.log2("weight")).cast("int"))
    # places by ranges, so that no task numbers a whole hub
    placed = graph.running_sum(near, F.lit(1), [F.col("near")], ["title", "class"], "_place")
    cut = placed.withColumn("segment", F.floor((F.col("_place") - 1) / segment).cast("long"))
    segments = graph._written(cut.groupBy("title", "class", "segment").agg(F.sort_array(F.collect_list(F.struct("near", "weight"))).alias("near")))
    sizes = segments.groupBy("title", "class").agg(F.sum(F.size("near")).alias("n"))
    mass = F.col("n") * F.pow(F.lit(2.0), F.col("class"))
    classes = sizes.groupBy("title").agg(F.sum(mass).alias("mass"), F.sort_array(F.collect_list(F.struct("class", "n", mass.alias("mass")))).alias("classes"))
    return graph._written(classes), segments


def _draw(seed: int, step: int, what: int) -> Column:
    """A number of [0, 1) that follows from the walk, the step and the purpose: a task run again draws the same."""
    return F.shiftrightunsigned(F.xxhash64("walk", "start", F.lit(seed), F.lit(step), F.lit(what)), 11) / F.lit(float(2**53))


def random_walks(edges: DataFrame, walks: int = 10, length: int = 40, p: float = 1.0, q: float = 1.0, seed: int = 1, segment: int = SEGMENT) -> DataFrame:
    """(walk, path): ``walks`` walks of ``length`` nodes from every node, by edge weight, with second-order bias.

    From the second step on, a neighbour's weight is divided by ``p`` if the walk came from it, kept if an edge joins
    it to where the walk came from, and divided by ``q`` otherwise. All open walks propose one step at a time by
    equi-joins with the classes and one segment; what is not accepted stays and proposes again, until no walk is open.
    """
    if length < 1 or walks < 1 or p <= 0 or q <= 0:
        raise ValueError("walks and length must be at least 1, p and q positive")
    classes, segments = weighted_neighbours(edges, segment)
    pairs = segments.select("title", F.explode("near.near").alias("cand")).toDF("prev", "cand").withColumn("joined", F.lit(True))
    open_ = classes.select(F.col("title").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    open_ = open_.select("start", "walk", F.array("start").alias("path"))
    if length == 1:
        return open_.select("walk", "path")
    done, step, top = [], 0, max(1.0, 1 / p, 1 / q)
    while True:
        for _ in range(ROUNDS):
            open_, step = _proposed(open_, classes, segments, pairs, length, segment, (p, q, top), seed, step), step + 1
        state = graph._written(open_)
        done.append(state.filter(F.size("path") == length))
        open_ = state.filter(F.size("path") < length)
        if not open_.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select("walk", "path")


def _proposed(state: DataFrame, classes: DataFrame, segments: DataFrame, pairs: DataFrame, length: int, segment: int, bias: tuple[float, float, float], seed: int, step: int) -> DataFrame:
    """Walks after one proposal each; finished ones pass by."""
    p, q, top = bias
    at = state.withColumns({"at": F.when(F.size("path") < length, F.element_at("path", -1)), "prev": F.when(F.size("path") > 1, F.get("path", F.size("path") - 2))})
    mass, each = F.col("mass") * _draw(seed, step, 0), F.col("classes")
    chosen = F.aggregate(
        each, F.struct(mass.alias("left"), F.lit(None).cast("int").alias("class"), F.lit(None).cast("long").alias("n")),
        lambda a, c: F.when(a["left"] < 0, a).otherwise(F.struct((a["left"] - c["mass"]).alias("left"), c["class"].alias("class"), c["n"].alias("n"))),
    )
    rows = at.join(classes.withColumnRenamed("title", "at"), "at", "left").withColumn("_c", chosen)
    place = F.floor(F.col("_c.n") * _draw(seed, step, 1)).cast("long")
    seg = segments.toDF("at", "class", "segment", "near")
    rows = rows.withColumns({"class": F.col("_c.class"), "segment": F.floor(place / segment).cast("long"), "_i": (place % segment).cast("int")}).drop("_c", "mass", "classes")
    rows = rows.join(seg, ["at", "class", "segment"], "left").withColumn("_n", F.get("near", "_i")).withColumns({"cand": F.col("_n.near"), "_w": F.col("_n.weight")})
    accept = _draw(seed, step, 2) * F.pow(F.lit(2.0), F.col("class")) < F.col("_w")
    if (p, q) != (1.0, 1.0):
        rows = rows.join(pairs, ["prev", "cand"], "left")
        factor = F.when(F.col("prev").isNull(), top).when(F.col("cand") == F.col("prev"), 1 / p).when(F.col("joined"), 1.0).otherwise(1 / q)
        accept = accept & (_draw(seed, step, 3) * top < factor)
    return rows.select("start", "walk", F.when(accept, F.concat("path", F.array("cand"))).otherwise(F.col("path")).alias("path"))


def node_embeddings(edges: DataFrame, dimensions: int = 64, walks: int = 10, length: int = 40, window: int = 2, iterations: int = 3, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """(title, embedding) from skip-grams over random walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths = random_walks(edges, walks, length, p, q, seed)
    model = Word2Vec(vectorSize=dimensions, windowSize=window, maxIter=iterations, minCount=0, seed=seed, inputCol="path", outputCol="v").fit(paths)
    return model.getVectors().select(F.col("word").alias("title"), vector_to_array("vector").alias("embedding"))
