"""Whole graphs as files that other tools read: GraphML, and the viewer's JSON document of nodes and links.

A document is a folder of parts in the order of their names, which put together are one valid file; every node and
link is a line of its own, so no task, row or driver holds a graph. Both readers take such folders and single files.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grafloom.operators import graph

# Attribute types of the GraphML format for Spark's.
TYPES = {"boolean": "boolean", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string"}
# The format's head and end.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
END = "</graph>\n</graphml>"

#: Characters that XML 1.0 can't hold.
_BARRED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))


def _escaped(c: Column) -> Column:
    """Text for XML; a character that it can't hold becomes a space."""
    out = F.regexp_replace(c.cast("string"), _BARRED, " ")
    for plain, coded in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def _ordered(spark: SparkSession, sections: list[DataFrame | str], path: str) -> None:
    """Write sections, (n, line) rows or a single line each, as text in their order."""
    lines = None
    for i, s in enumerate(sections):
        rows = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(s).alias("line")) if isinstance(s, str) else s.select("n", "line")
        rows = rows.withColumn("section", F.lit(i))
        lines = rows if lines is None else lines.unionByName(rows)
    lines.repartitionByRange("section", "n").sortWithinPartitions("section", "n").select("line").write.mode("overwrite").text(path)


def _keys(df: DataFrame, of: str, ends: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    """Column to (key, GraphML type) of all columns that aren't ``ends``."""
    out = {}
    for c, kind in df.dtypes:
        if c not in ends:
            if kind not in TYPES:
                raise ValueError(f"no GraphML type for {c}: {kind}")
            out[c] = (f"{of[0]}{len(out)}", TYPES[kind])
    return out


def save_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """Write nodes (title, ...) and edges (source, target, ...), all further columns of plain types, as a GraphML document.

    Nulls have no element. Nodes lie in the order of titles, edges in that of their ends.
    """
    spark, sections, head = nodes.sparkSession, [], [HEAD]
    for df, of, ends in ((nodes, "node", ("title",)), (edges, "edge", ("source", "target"))):
        keys = _keys(df, of, ends)
        plain = lambda s: re.sub('[&<>"]', lambda m: dict(_ESCAPES)[m[0]], s)
        head += [f'<key id="{k}" for="{of}" attr.name="{plain(c)}" attr.type="{t}"/>' for c, (k, t) in keys.items()]
        data = [F.concat(F.lit(f'<data key="{k}">'), _escaped(F.col(c)), F.lit("</data>")) for c, (k, _) in keys.items()]
        names = [x for e, a in zip(ends, ("id",) if of == "node" else ends, strict=True) for x in (F.lit(f' {a}="'), _escaped(F.coalesce(F.col(e).cast("string"), F.lit(""))), F.lit('"'))]
        line = F.concat(F.lit(f"<{of}"), *names, F.lit(">"), F.concat_ws("", *data) if data else F.lit(""), F.lit(f"</{of}>"))
        sections.append(graph.number_rows(df.select(*ends, line.alias("line")), [*ends, "line"], "n"))
    head.append(f'<graph edgedefault="{"directed" if directed else "undirected"}">')
    _ordered(spark, ["\n".join(head), *sections, END], path)


def load_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML document, whoever wrote it, with a typed column for each of its keys; what an element lacks is null, or the key's default."""
    # Spark's present parser gives up a part of a document, which has no root, at its first element; the one before finds all, but not a file's own encoding
    parts = sum(f.rsplit("/", 1)[-1].startswith("part-") for f in spark.read.text(path).inputFiles()) > 1
    xml = lambda tag, schema: spark.read.format("xml").options(rowTag=tag, ignoreSurroundingSpaces=False, useLegacyXMLParser=parts).schema(schema).load(path)
    # a row for each kind of attribute
    keys = xml("key", "_id string, _for string, `_attr.name` string, `_attr.type` string, default string").collect()
    back = {v: k for k, v in TYPES.items()}
    data = "data array<struct<_key: string, _VALUE: string>>"

    def typed(rows: DataFrame, of: str) -> DataFrame:
        first = lambda k: F.get(F.filter("data", lambda d: d["_key"] == k), F.lit(0))
        out = []
        for k in keys:
            if k["_for"] in (of, "all"):
                # an element without text is an empty string, an absent one is null
                value = F.when(first(k["_id"]).isNotNull(), F.coalesce(first(k["_id"])["_VALUE"], F.lit(""))).otherwise(F.lit(k["default"]))
                kind = back.get(k["_attr.type"], "string")
                out.append((value if kind == "string" else F.trim(value).try_cast(kind)).alias(k["_attr.name"]))
        return rows.select(*(c for c in rows.columns if c != "data"), *out)

    nodes = xml("node", f"_id string, {data}").withColumnRenamed("_id", "title")
    edges = xml("edge", f"_source string, _target string, {data}").withColumnsRenamed({"_source": "source", "_target": "target"})
    return typed(nodes, "node"), typed(edges, "edge")


def save_document(nodes: DataFrame, links: DataFrame, folder: str, name: str, now: datetime | None = None) -> str:
    """Write {nodes, links} to a new folder ``<name>_<date>_<minute>`` with an empty ``rep.json`` beside, read it back, and give its path.

    ``nodes`` have an id, ``links`` a source and a target; further columns are of any type, and nulls are left out.
    A document of the same minute is replaced. What is read back must hold as many rows as were written.
    """
    spark, path = nodes.sparkSession, f"{folder.rstrip('/')}/{name}_{(now or datetime.now()):%Y%m%d_%H%M}"
    comma = F.when(F.col("n") > 0, F.lit(",")).otherwise(F.lit(""))
    sections, counts = [], []
    for df, order in ((nodes, ["id"]), (links, ["source", "target"])):
        rows = df.select(*(F.col(c).alias(f"_{c}") for c in order), F.to_json(F.struct(*df.columns)).alias("json"))
        rows = graph._written(graph.number_rows(rows, [*(f"_{c}" for c in order), "json"], "n"))
        counts.append(rows.count())
        sections.append(rows.select("n", F.concat(comma, F.col("json")).alias("line")))
    _ordered(spark, ['{"nodes":[', sections[0], '],"links":[', sections[1], "]}"], f"{path}/graph.json")
    spark.range(1).select(F.lit("{}").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/rep.json")
    got = [df.count() for df in load_document(spark, f"{path}/graph.json", nodes.schema.simpleString(), links.schema.simpleString())]
    if got != counts:
        raise ValueError(f"a saved document holds {got} rows, not {counts}")
    return path


def load_document(spark: SparkSession, path: str, nodes: str = "struct<id:string>", links: str = "struct<source:string,target:string>") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a document that was saved by lines, as the given structs; a line is a link if it has a source and a target, and a node if it has an id and isn't a link.

    A line that is neither, other than those that frame a document, is an error when it is read.
    """
    line = F.regexp_replace("value", r"\A,", "")
    rows = spark.read.text(path).select(line.alias("value"))
    frame = F.col("value").isin('{"nodes":[', '],"links":[', "]}", "")
    probe = F.from_json("value", "id string, source string, target string")
    link = probe["source"].isNotNull() & probe["target"].isNotNull()
    kind = F.when(link, F.lit("link")).when(probe["id"].isNotNull(), F.lit("node")).otherwise(F.raise_error(F.concat(F.lit("no node and no link: "), F.left("value", F.lit(80)))))
    told = rows.filter(~frame).withColumn("_kind", kind)
    of = lambda k, schema: told.filter(F.col("_kind") == k).select(F.from_json("value", schema).alias("r")).select("r.*")
    return of("node", nodes), of("link", links)
