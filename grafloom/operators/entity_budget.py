"""A context's budget spent by whole entities: each brings its relationships and claims with it, or nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from grafloom.operators import graph


@dataclass
class WholeEntities:
    """What the first ``taken`` entities bring; ``totals`` (n, relationships, claims, total) has a row for each number of entities."""

    taken: int
    relationships: DataFrame
    claims: DataFrame | None
    totals: DataFrame


def prefixes(relationships: DataFrame, selected: DataFrame, n: int, top_k: int) -> DataFrame:
    """Relationships (source, target, rank, size) that the first ``n`` and fewer of the selected (title, ord from 1) bring.

    A row for each relationship and number of entities ``at``: those inside the first ``at`` entities (out = 0),
    then those that leave them, by how many of them their outer end is linked to (links) and rank, at most
    ``top_k`` for each entity. A relationship belongs to the first of its ends that is selected and is inside from
    the second on. An end that is null is an outer end like any other. A title given twice counts at its first place, yet each place adds to what may leave. Only the
    best ``top_k * n`` of each number are sorted, and each task drops the others before they move.
    """
    places = selected.groupBy("title").agg(F.min("ord").alias("ord"))
    s, t = places.toDF("source", "_s"), places.toDF("target", "_t")
    met = relationships.join(F.broadcast(s), "source", "left").join(F.broadcast(t), "target", "left").filter("_s IS NOT NULL OR _t IS NOT NULL")
    each = met.withColumn("at", F.explode(F.sequence(F.least("_s", "_t"), F.lit(n)))).withColumn("out", F.when((F.col("_s") <= F.col("at")) & (F.col("_t") <= F.col("at")), 0).otherwise(1))
    src_in = F.coalesce(F.col("_s") <= F.col("at"), F.lit(False))
    each = each.withColumns({"_outer": F.when(src_in, F.col("target")).otherwise(F.col("source")), "_inner": F.when(src_in, F.col("source")).otherwise(F.col("target"))})
    leaving = each.filter("out = 1")
    links = leaving.groupBy("at", "_outer").agg(F.countDistinct("_inner").alias("links"))
    best = Window.partitionBy("at").orderBy(F.desc("links"), F.desc("rank"), "source", "target")
    links = links.toDF("_at", "_end", "links")
    with_links = leaving.join(links, (F.col("at") == F.col("_at")) & F.col("_outer").eqNullSafe(F.col("_end"))).drop("_at", "_end")
    kept = with_links.withColumn("_n", F.row_number().over(best)).filter((F.col("_n") <= max(1, top_k * n)) & (F.col("_n") <= F.greatest(F.lit(1), top_k * F.col("at"))))
    inside = each.filter("out = 0").withColumn("links", F.lit(0).cast("long"))
    return inside.unionByName(kept.drop("_n")).drop("_s", "_t", "_outer", "_inner")


def whole_entities(selected: DataFrame, relationships: DataFrame, budget: int, claims: DataFrame | None = None, used: int = 0, top_k: int = 10, header: int = 0, claim_header: int = 0) -> WholeEntities:
    """The longest run of first entities whose relationships and claims fit, with what the entities took already (``used``).

    ``selected`` (title, ord) is ranked from 1 and as short as a question's selection is; ``relationships`` (source,
    target, rank, size) and ``claims`` (id, subject_id, size) are tables of any size. Sections have a header each, if
    they hold a candidate; a section alone stops before the line that takes it over the budget. The first number
    of entities whose sum is over the budget ends the run, even if a later one were under it. Sizes and ranks
    that are null count as 0; no entities, or none that fit: nothing.
    """
    few = [(r.title, r.ord) for r in selected.select("title", "ord").collect()]  # a question's selection
    spark, n = selected.sparkSession, max((o for _, o in few), default=0)
    chosen = spark.createDataFrame(few, "title string, ord int")
    rows = relationships.withColumns({"size": F.coalesce("size", F.lit(0)), "rank": F.coalesce(F.col("rank").cast("double"), F.lit(0.0))})
    brought = graph._written(prefixes(rows, chosen, n, top_k))
    order = [F.col("out"), F.desc("links"), F.desc("rank"), F.col("source"), F.col("target")]
    fits = graph.running_sum(brought, F.col("size"), order, ["at"], "_used", header, budget).filter(F.col("_used") <= budget)
    fits = graph._written(fits)
    steps = spark.range(1, n + 1).select(F.col("id").cast("int").alias("at"))
    any_rel, sums = brought.select("at").distinct().withColumn("_any", F.lit(header)), fits.groupBy("at").agg(F.max("_used").alias("_most"))
    totals = steps.join(any_rel, "at", "left").join(sums, "at", "left").select("at", F.coalesce("_most", "_any", F.lit(0)).cast("long").alias("relationships"))
    kept_claims = None
    if claims is None:
        totals = totals.withColumn("claims", F.lit(0).cast("long"))
    else:
        mine = claims.withColumn("size", F.coalesce("size", F.lit(0))).join(F.broadcast(chosen.withColumnRenamed("title", "subject_id")), "subject_id")
        kept_claims = graph._written(graph.running_sum(mine, F.col("size"), [F.col("ord"), F.col("id")], [], "_used", claim_header, budget).filter(F.col("_used") <= budget))
        # the header stands from the first on, if there are claims at all
        some = claim_header if claims.limit(1).count() else 0
        by_owner = kept_claims.groupBy(F.col("ord").alias("_o")).agg(F.max("_used").alias("_c"))
        totals = totals.join(F.broadcast(by_owner), F.col("_o") <= F.col("at"), "left").groupBy("at", "relationships").agg(F.coalesce(F.max("_c"), F.lit(some)).cast("long").alias("claims"))
    totals = graph._written(totals.select(F.col("at").alias("n"), "relationships", "claims", (F.col("relationships") + F.col("claims") + used).alias("total")))
    taken = 0
    for r in totals.orderBy("n").collect():  # a row for each selected entity
        if r.total > budget:
            break
        taken = r.n
    rel = fits.filter(F.col("at") == taken).drop("at", "_used")
    return WholeEntities(taken, rel, None if kept_claims is None else kept_claims.filter(F.col("ord") <= taken).drop("_used"), totals)
