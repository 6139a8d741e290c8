"""Typed readers of index tables, and adapters that fix the column names of a built index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grafloom.operators import graph
from grafloom.operators.relational import distinct_keep_first, read_typed

# The columns of each object with their types; a name that ends in "?" may be missing.
OBJECTS: dict[str, dict[str, str]] = {
    "entity": {"id": "string", "title": "string", "type?": "string", "description?": "string", "community_ids?": "array<string>", "text_unit_ids?": "array<string>", "rank?": "int", "vector?": "array<double>"},
    "relationship": {"id": "string", "source": "string", "target": "string", "description?": "string", "weight?": "double", "text_unit_ids?": "array<string>", "rank?": "int"},
    "covariate": {"id": "string", "subject_id": "string", "covariate_type?": "string", "text_unit_ids?": "array<string>", "document_ids?": "array<string>"},
    "community": {"id": "string", "title": "string", "level": "string", "entity_ids?": "array<string>", "relationship_ids?": "array<string>"},
    "report": {"id": "string", "title": "string", "community": "string", "summary?": "string", "content": "string", "rank?": "double"},
    "text_unit": {"id": "string", "text": "string", "entity_ids?": "array<string>", "relationship_ids?": "array<string>", "n_tokens?": "int", "document_ids?": "array<string>"},
    "document": {"id": "string", "title": "string", "text?": "string", "text_unit_ids?": "array<string>"},
}


def read_objects(df: DataFrame, kind: str, columns: dict[str, str] | None = None, short_id: str | None = None, attributes: list[str] | None = None) -> DataFrame:
    """A table as typed objects: ``columns`` renames (object's name to table's), ``attributes`` go into one map of strings.

    ``short_id`` names a column; without one, rows are numbered from 0 in id order. A missing column
    is an error, unless the object can do without.
    """
    columns = columns or {}
    out = []
    for name, kind_ in OBJECTS[kind].items():
        plain = name.rstrip("?")
        out.append(read_typed(df, columns.get(plain, plain), kind_, optional=name.endswith("?")).alias(plain))
    extra = F.create_map(*(x for c in attributes for x in (F.lit(c), F.col(c).cast("string")))) if attributes else F.lit(None).cast("map<string,string>")
    rows = df.select(*out, extra.alias("attributes"), *([F.col(short_id).cast("string").alias("short_id")] if short_id else []))
    return rows if short_id else graph.number_rows(rows, ["id"], "short_id").withColumn("short_id", F.col("short_id").cast("string"))


def deepest(nodes: DataFrame, level: int | None = None) -> DataFrame:
    """(title, community): the deepest community of each title, up to a level."""
    rows = nodes.filter(F.col("community").isNotNull())
    rows = rows if level is None else rows.filter(F.col("level") <= level)
    return rows.groupBy("title").agg(F.max_by("community", F.struct("level", "community")).alias("community"))


def entities(tables: dict[str, DataFrame], level: int = 0) -> DataFrame:
    """Entities of a built index that are nodes up to a level, with the deepest community of their title there; of a repeated name the least id stays."""
    own = deepest(tables["nodes"], level).select("title", F.array(F.col("community").cast("string")).alias("community_ids"))
    there = tables["nodes"].filter(F.col("level") <= level).select("title").distinct()
    rows = distinct_keep_first(tables["entities"].withColumnRenamed("name", "title"), ["title"], [F.col("id")])
    rows = rows.join(there, "title", "left_semi").join(own, "title", "left")
    return read_objects(rows, "entity", short_id="human_readable_id")


def relationships(tables: dict[str, DataFrame]) -> DataFrame:
    return read_objects(tables["relationships"], "relationship", attributes=["rank"])


def text_units(tables: dict[str, DataFrame]) -> DataFrame:
    return read_objects(tables["final_text_units"], "text_unit")


def covariates(tables: dict[str, DataFrame]) -> DataFrame:
    rows = tables["covariates"].withColumn("text_unit_ids", F.array("text_unit_id"))
    return read_objects(rows, "covariate", short_id="human_readable_id", attributes=["object_id", "status", "start_date", "end_date", "description"])


def chosen_reports(tables: dict[str, DataFrame], level: int | None = None, min_rank: float | None = None) -> DataFrame:
    """Rows of the report table for the deepest communities of all titles up to a level, from a rank on: no parent beside its children unless a title goes no deeper."""
    rows = tables["community_reports"].join(deepest(tables["nodes"], level).select("community").distinct(), "community", "left_semi")
    rows = rows if level is None else rows.filter(F.col("level") <= level)
    return rows if min_rank is None else rows.filter(F.col("rank") >= min_rank)


def reports(tables: dict[str, DataFrame], level: int | None = None, min_rank: float | None = None) -> DataFrame:
    """Reports of a built index up to a level and from a rank on."""
    rows = chosen_reports(tables, level, min_rank).withColumns({"id": F.col("community"), "content": F.col("full_content")})
    return read_objects(rows, "report", short_id="community")
