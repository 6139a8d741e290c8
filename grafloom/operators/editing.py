"""Edits of a graph that a viewer shows: nodes merged, recoloured and renamed, texts and links reworded.

A graph is three tables, so that no row holds all texts of a node:
``nodes`` (id, name, color, size), ``texts`` (node, pos, id, text) and ``links`` (id, ord, source, target, explanation).
Further columns stay. Every edit is a table, so many are applied by one join; what they name and the graph lacks is
left out, and of several edits of one thing the one of the greatest ``ord`` counts. A null id is never met.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed value: the colour of a node without one.
LIGHT = "#21252D"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    texts: DataFrame
    links: DataFrame


def _picked(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """(_id, _group, _place, _first): picks (group, ord, id) that are nodes, of groups with two or more; an id of several groups belongs to the least."""
    own = picks.groupBy("id").agg(F.min(F.struct("group", "ord")).alias("p")).select(F.col("id").alias("_id"), "p.group", "p.ord")
    real = own.join(nodes.select(F.col("id").alias("_id")), "_id", "left_semi")
    firsts = real.groupBy("group").agg(F.min_by("_id", F.struct("ord", "_id")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return real.join(firsts, "group").select("_id", F.col("group").alias("_group"), F.col("ord").alias("_place"), "_first")


def _rows(df: DataFrame) -> DataFrame:
    """Whole rows as a column ``row``, so that no name of theirs meets one of a join."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def _back(df: DataFrame, like: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``row`` again, some changed."""
    return df.select(*((changed or {}).get(c, F.col("row")[c]).alias(c) for c in like.columns))


def merge_nodes(graph: Graph, picks: DataFrame, default: str = LIGHT) -> Graph:
    """Each group of picks (group, ord, id) becomes its first node.

    It keeps its own name and columns, takes the greatest size (none counts as 0), its colour or the default, and the
    texts of all, one for each text id: that of the node picked first. Links within a group go, others end in
    the first node; of links with the same ends, in the same direction, the first (``ord``, id) stays, merged or not.
    """
    own = _picked(graph.nodes, picks)
    sizes = graph.nodes.select("id", "size").join(own, F.col("id") == F.col("_id")).groupBy("_first").agg(F.max(F.coalesce("size", F.lit(0))).alias("_size"))
    gone = own.filter("_id <> _first").select("_id")
    kept = _rows(graph.nodes).join(gone, F.col("row.id") == F.col("_id"), "left_anti").join(sizes, F.col("row.id") == F.col("_first"), "left")
    merged = F.col("_first").isNotNull()
    changed = {"size": F.when(merged, F.col("_size")).otherwise(F.col("row.size")), "color": F.when(merged, F.coalesce("row.color", F.lit(default))).otherwise(F.col("row.color"))}
    nodes = _back(kept, graph.nodes, changed)

    moved = _rows(graph.texts).join(own, F.col("row.node") == F.col("_id"), "left")
    plain = _back(moved.filter(F.col("_first").isNull()), graph.texts)
    order = F.struct(F.col("_place"), F.col("_id"), F.col("row.pos"))
    # one text of each id, whichever task it lies in; places are told by the order in which nodes were picked
    one = moved.filter(F.col("_first").isNotNull()).groupBy("_first", F.col("row.id").alias("_text")).agg(F.min_by("row", order).alias("row"), F.min(order).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_first").orderBy("_o", "_text")) - 1
    joined = _back(one, graph.texts, {"node": F.col("_first"), "pos": place.cast(dict(graph.texts.dtypes)["pos"])})

    s, t = (own.select(F.col("_id").alias(f"_{c}"), F.col("_first").alias(f"_{c}_to")) for c in ("source", "target"))
    at = _rows(graph.links).join(s, F.col("row.source") == F.col("_source"), "left").join(t, F.col("row.target") == F.col("_target"), "left")
    inner = F.coalesce(F.col("_source_to") == F.col("_target_to"), F.lit(False))
    to = at.filter(~inner).select("row", *(F.coalesce(f"_{c}_to", f"row.{c}").alias(f"_{c}") for c in ("source", "target")))
    links = to.groupBy("_source", "_target").agg(F.min_by("row", F.struct("row.ord", "row.id")).alias("row"))
    return Graph(nodes, plain.unionByName(joined), _back(links, graph.links, {"source": F.col("_source"), "target": F.col("_target")}))


def recolour_nodes(graph: Graph, picks: DataFrame, default: str = LIGHT) -> Graph:
    """Each group of picks takes the colour of its first node, or the default; a missing size becomes 0."""
    own = _picked(graph.nodes, picks)
    firsts = own.filter("_id = _first").select("_first").join(graph.nodes.select("id", "color"), F.col("_first") == F.col("id")).select("_first", F.coalesce("color", F.lit(default)).alias("_color"))
    put = own.join(firsts, "_first").select("_id", "_color")
    at = _rows(graph.nodes).join(put, F.col("row.id") == F.col("_id"), "left")
    size = F.when(F.col("_id").isNotNull(), F.coalesce("row.size", F.lit(0))).otherwise(F.col("row.size"))
    return replace(graph, nodes=_back(at, graph.nodes, {"color": F.coalesce("_color", "row.color"), "size": size}))


def _edited(rows: DataFrame, edits: DataFrame, keys: dict[str, str], column: str) -> DataFrame:
    """Rows with a column taken from edits (ord, keys, column), if one meets their keys (row's name to edit's name); a new value may be null."""
    last = edits.groupBy(*(F.col(e).alias(f"_{r}") for r, e in keys.items())).agg(F.max_by(F.struct(F.col(column).alias("v")), "ord").alias("_new"))
    same = F.lit(True)
    for r in keys:
        same = same & (F.col(f"row.{r}") == F.col(f"_{r}"))
    at = _rows(rows).join(last, same, "left")
    return _back(at, rows, {column: F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(f"row.{column}"))})


def rename_nodes(graph: Graph, edits: DataFrame) -> Graph:
    """Nodes with the names of edits (ord, id, name); links name nodes by id, so they follow."""
    return replace(graph, nodes=_edited(graph.nodes, edits, {"id": "id"}, "name"))


def edit_texts(graph: Graph, edits: DataFrame) -> Graph:
    """Texts of edits (ord, node, id, text), each in its own node only."""
    return replace(graph, texts=_edited(graph.texts, edits, {"node": "node", "id": "id"}, "text"))


def explain_links(graph: Graph, edits: DataFrame) -> Graph:
    """Links with the explanations of edits (ord, id, explanation)."""
    return replace(graph, links=_edited(graph.links, edits, {"id": "id"}, "explanation"))
