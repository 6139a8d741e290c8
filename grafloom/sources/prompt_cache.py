"""Cached answers: prompts (id, prompt, graph, response) and their selected nodes (prompt_id, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grafloom.sources.versions import Versions


def with_nodes(prompts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Prompts with their sorted nodes; none gives an empty array."""
    n = chosen.filter(F.col("node").isNotNull()).groupBy("prompt_id").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return prompts.join(n, prompts.id == n.prompt_id, "left").drop("prompt_id").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))


def newest(prompts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(prompt, nodes, id, response): the newest answer of each prompt and node set."""
    return with_nodes(prompts, chosen).groupBy("prompt", "nodes").agg(F.max("id").alias("id"), F.max_by("response", "id").alias("response"))


def lookup(prompts: DataFrame, chosen: DataFrame, prompt: str, nodes: list[str], graph: str | None = None) -> str | None:
    """The newest answer to a prompt with exactly these nodes, in one graph if named."""
    rows = prompts.filter(F.col("prompt") == prompt)
    if graph is not None:
        rows = rows.filter(F.col("graph") == graph)
    want = F.array(*(F.lit(n) for n in sorted(nodes))).cast("array<string>")
    hit = with_nodes(rows, chosen).filter(F.col("nodes") == want).orderBy(F.desc("id")).select("response").first()
    return hit.response if hit else None


def history(prompts: DataFrame, chosen: DataFrame, graph: str) -> DataFrame:
    return with_nodes(prompts.filter(F.col("graph") == graph), chosen).orderBy(F.desc("id"))


def save(prompts_path: str, nodes_path: str, prompts: DataFrame, chosen: DataFrame) -> None:
    """Append answers and their nodes; nodes first, so that a broken write leaves no answer without its nodes."""
    chosen.write.mode("append").parquet(nodes_path)
    prompts.write.mode("append").parquet(prompts_path)


def commit(versions: Versions, prompts: DataFrame, chosen: DataFrame) -> int:
    """Append answers and their nodes in one step: no reader sees the one without the other."""
    return versions.commit(appended={"prompt_histories": prompts, "prompt_selected_nodes": chosen})


def committed(versions: Versions) -> tuple[DataFrame, DataFrame]:
    """(prompts, nodes) of one version."""
    pinned = versions.manifest()
    return versions.read("prompt_histories", pinned), versions.read("prompt_selected_nodes", pinned)
