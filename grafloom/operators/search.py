"""Search over an index: global (map and reduce over reports) and local (entities and what hangs on them).

A language model is any callable from prompt to text; an embedder any callable from text to vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from grafloom.functions import text as T
from grafloom.operators import context, entity_budget, graph, readers, retrieval, selection

Model = Callable[[str], str]

# Fixed value: what is answered where no report bears on the question.
NO_DATA = "I am sorry but I am unable to answer this question given the provided data."
_MAP = "Answer from the reports below with JSON: {\"points\": [{\"description\": ..., \"score\": 0-100}]}.\nQuestion: {query}\n\n{context}"
_REDUCE = "Combine the analysts' points into one answer of this form: {kind}.\nQuestion: {query}\n\n{context}"
_LOCAL = "Answer from the tables below in this form: {kind}.\nQuestion: {query}\n\n{context}"
_QUESTIONS = "Write {n} further questions, one a line, about the data below.\nEarlier: {history}\nLast: {query}\n\n{context}"


@dataclass
class Result:
    answer: str
    context: str
    tables: dict[str, DataFrame] = field(default_factory=dict)


def rank_sources(entities: DataFrame, relationships: DataFrame, selected: DataFrame) -> DataFrame:
    """(unit, ord, n_relationships) of units with selected entities (title, ord), by first entity, then most relationships of it in the unit."""
    first = entities.join(selected, "title").groupBy("unit").agg(F.min("ord").alias("ord"), F.min_by("title", "ord").alias("title"))
    ends = relationships.select("unit", F.explode(F.array("source", "target")).alias("title"))
    n = ends.join(selected.select("title"), "title", "left_semi").groupBy("unit", "title").agg(F.count("*").alias("n_relationships"))
    return first.join(n, ["unit", "title"], "left").fillna(0, ["n_relationships"]).select("unit", "ord", "n_relationships").orderBy("ord", F.desc("n_relationships"), "unit")


def in_context(candidates: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Candidates with a flag: whether the context holds them."""
    u = used.select(F.col(key).alias("_k")).distinct()
    return candidates.join(u, candidates[key] == u["_k"], "left").withColumn("in_context", F.col("_k").isNotNull()).drop("_k")


def global_context(reports: DataFrame, weights: DataFrame | None = None, budget: int = 12000, min_rank: float = 0, size: Callable[..., "F.Column"] = T.token_count) -> DataFrame:
    """(batch, text): reports (community, title, content, rank) of enough rank, in seeded order, cut at the budget."""
    rows = reports.filter(F.col("rank").isNotNull() & (F.col("rank") >= min_rank))
    rows = rows.join(weights, "community", "left") if weights is not None else rows.withColumn("weight", F.lit(0.0))
    rows = rows.withColumn("line", T.csv_line(*(F.col(c).cast("string") for c in ("community", "title", "weight", "content", "rank")), separator="|"))
    rows = graph.number_rows(rows.withColumn("_h", F.xxhash64("community", F.lit(86))), ["_h", "community"], "_o").withColumn("_all", F.lit(0)).drop("_h")
    cut = context.batches(rows, "_all", "_o", size("line"), budget).select(F.col("id").alias("_o"), "batch")
    order = F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), (-F.col("rank").cast("double")).alias("r"), "community", "line")
    return rows.join(cut, "_o").groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("text"))


def global_search(query: str, reports: DataFrame, model: Model, kind: str = "multiple paragraphs", budget: int = 12000, weights: DataFrame | None = None, size: Callable[..., "F.Column"] = T.token_count) -> Result:
    """Ask the model about every batch on the executors, keep points of positive score within the budget, and reduce them in one call that holds the question."""
    parts = global_context(reports, weights, budget, size=size)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"batch": f["batch"], "answer": [model(_MAP.replace("{query}", query).replace("{context}", t)) for t in f["text"]]})

    # written, as it is read for the points, their running sizes and the answer
    answers = graph._written(parts.mapInPandas(ask, "batch long, answer string"))
    points = T.with_points(answers, "answer").select("batch", F.posexplode("points").alias("n", "p")).select("batch", "n", "p.*").filter("score > 0")
    line = F.concat(F.lit("Analyst "), F.col("batch") + 1, F.lit(" ("), "score", F.lit("): "), "description")
    best = context.greedy_prefix(points.withColumn("line", line), size("line"), budget, [F.desc("score"), F.col("batch"), F.col("n")])
    text = "\n".join(r.line for r in best.orderBy(F.desc("score"), "batch", "n").select("line").collect())
    if not text:
        return Result(NO_DATA, "", {"points": points})
    return Result(model(_REDUCE.replace("{query}", query).replace("{kind}", kind).replace("{context}", text)), text, {"points": best})


def local_search(query: str, tables: dict[str, DataFrame], embed: Callable[[str], list[float]], model: Model, k: int = 10, budget: int = 12000, unit_share: float = 0.5, community_share: float = 0.1, kind: str = "multiple paragraphs", size: Callable[..., "F.Column"] = T.token_count, history: str = "") -> Result:
    """Entities near the question, their community reports, relationships and sources, each within its share of the budget.

    What is left of the budget by the shares of sources and reports goes to entities, then to relationships and
    claims by whole entities. ``size`` counts a text's tokens. ``history`` is text of the conversation so far
    (``context.conversation_context``), which stands first and whose tokens the budget pays.

    ``tables``: entities (id, title, description, rank, vector), relationships (source, target,
    description, weight, rank), mentions (unit, title), units (unit, chunk), and optionally nodes
    (title, level, community) with reports (community, content, rank), and claims (id, subject_id,
    object_id, status, description).
    """
    if unit_share + community_share > 1:
        raise ValueError("the shares of the budget are over 1")
    sel = retrieval.map_query_to_entities(tables["entities"], embed(query), k).orderBy("order", "id")
    sel = sel.select("id", "title", "description", "rank", F.row_number().over(Window.orderBy("order", "id")).alias("ord"))
    parts: list[str] = []
    used: dict[str, DataFrame] = {}
    if history:
        parts.append(f"-----Conversation History-----\n{history}")
        budget = max(0, budget - sel.sparkSession.range(1).select(size(F.lit(parts[0]))).first()[0])

    def section(name: str, rows: DataFrame, line: "F.Column", order: list, share: float) -> None:
        kept = context.greedy_prefix(rows.withColumn("line", line), size("line"), int(budget * share), order)
        lines = [r.line for r in kept.orderBy(*order).select("line").collect()]
        if lines:
            parts.append(f"-----{name}-----\n" + "\n".join(lines))
        used[name.lower()] = kept

    if "reports" in tables:
        hits = tables["nodes"].join(sel.select("title"), "title").groupBy("community").agg(F.countDistinct("title").alias("matches"))
        section("Reports", tables["reports"].join(hits, "community"), T.csv_line(F.col("community").cast("string"), F.col("content"), separator="|"), [F.desc("matches"), F.desc("rank"), F.col("community")], community_share)
    rest = int(budget * (1 - unit_share - community_share))
    order = [F.col("ord")]
    row = T.csv_line(*(F.col(c).cast("string") for c in ("id", "title", "description", "rank")), separator="|")
    section("Entities", sel, row, order, 1 - unit_share - community_share)
    spent = used["entities"].agg(F.coalesce(F.max("used"), F.lit(0))).first()[0]
    line = T.csv_line(*(F.col(c).cast("string") for c in ("source", "target", "description", "weight")), separator="|")
    edges = tables["relationships"].withColumn("line", line).withColumn("size", size("line"))
    claims = None
    if "claims" in tables:
        line = T.csv_line(*(F.col(c).cast("string") for c in ("id", "subject_id", "object_id", "status", "description")), separator="|")
        claims = tables["claims"].withColumn("line", line).withColumn("size", size("line"))
    whole = entity_budget.whole_entities(sel.select("title", "ord"), edges, rest, claims, spent, k)
    for name, rows, by in (("Relationships", whole.relationships, [F.col("out"), F.desc("links"), F.desc("rank"), F.col("source"), F.col("target")]), ("Claims", whole.claims, [F.col("ord"), F.col("id")])):
        if rows is not None:
            lines = [r.line for r in rows.orderBy(*by).select("line").collect()]
            if lines:
                parts.append(f"-----{name}-----\n" + "\n".join(lines))
            used[name.lower()] = rows
    near = rank_sources(tables["mentions"], tables.get("unit_edges", tables["mentions"].select("unit", F.col("title").alias("source"), F.col("title").alias("target")).limit(0)), sel.select("title", "ord"))
    section("Sources", near.join(tables["units"], "unit"), T.csv_line(F.col("unit"), F.col("chunk"), separator="|"), [F.col("ord"), F.desc("n_relationships"), F.col("unit")], unit_share)
    text = "\n\n".join(parts)
    return Result(model(_LOCAL.replace("{query}", query).replace("{kind}", kind).replace("{context}", text)), text, used)


#: The community level that engines take where none is given.
LEVEL = 2


def local_engine(tables: dict[str, DataFrame], embed: Callable[[str], list[float]], model: Model, level: int | None = LEVEL, min_rank: float | None = None, **settings) -> Callable[[str], Result]:
    """A local search over the tables of a built index: entities, relationships, final_text_units, nodes, community_reports, covariates.

    Each title counts for its deepest community up to ``level`` (None: any), and reports rank as their writer said.
    """
    e = tables["entities"].withColumnRenamed("name", "title")
    units = tables["final_text_units"]
    given = {
        "entities": e.select("id", "title", "description", "rank", "vector"),
        "relationships": tables["relationships"],
        "mentions": e.select(F.explode("text_unit_ids").alias("unit"), "title"),
        "unit_edges": tables["relationships"].select(F.explode("text_unit_ids").alias("unit"), "source", "target"),
        "units": units.select(F.col("id").alias("unit"), F.col("text").alias("chunk")),
        "nodes": readers.deepest(tables["nodes"], level),
        "reports": readers.chosen_reports(tables, level, min_rank).select("community", F.col("full_content").alias("content"), "rank"),
    }
    if "covariates" in tables:
        given["claims"] = tables["covariates"].withColumn("subject_id", F.upper("subject_id"))
    return lambda query, **more: local_search(query, given, embed, model, **(settings | more))


def global_engine(tables: dict[str, DataFrame], model: Model, level: int | None = LEVEL, min_rank: float | None = None, **settings) -> Callable[[str], Result]:
    """A global search over the reports of the deepest communities up to ``level`` (None: any) of a built index."""
    reports = readers.chosen_reports(tables, level, min_rank).select("community", "title", F.col("full_content").alias("content"), "rank")
    return lambda query, **more: global_search(query, reports, model, **(settings | more))


def questions(history: list[str], found: Result, model: Model, n: int = 5) -> list[str]:
    """Further questions: the last of the history is the query, the others are its past."""
    *past, last = history or [""]
    prompt = _QUESTIONS.replace("{n}", str(n)).replace("{history}", "; ".join(past)).replace("{query}", last).replace("{context}", found.context)
    return [q.strip() for q in model(prompt).split("\n") if q.strip()]


def restrict_nodes(nodes: DataFrame, titles: list[str]) -> DataFrame:
    """The node table of a search that is limited to selected nodes; none selected: all."""
    return nodes.filter(F.col("title").isin(titles)) if titles else nodes
