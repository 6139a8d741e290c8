"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source has a target number of words. A document is to be taken target / source size times on
average: the whole part of that is certain, the rest a copy probability. Units are paired; words of
probability move from one to the other, up or down at random so that expectations stay, until one of
the two is integral. A block of units leaves at most one fractional unit; blocks of those residuals
are paired again, level by level, until each source has one unit left, which goes to the nearer side.
The sum of size times probability never changes but in that last step, so that a source's taken words
miss its target by half a document at most.

The units of a source are dealt to blocks by hash, so that a source with a third of all rows has many
blocks; a block is folded in one expression. Draws are hashes of the unit and the level: reruns agree.

Defined cases: null texts have size 0; a null source is a source, the last in order; documents of one
doc_id are one unit of their summed size (repeated rows are taken alike) and yield a row each; sizes
of 0 are never drawn; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from grafloom.llm import _store

WORD = r"[^\x20\x09-\x0D]+"
#: Units of a block on average; most copies of a document.
BLOCK, MOST = 48, 3.0
_UNIT = "id long, none boolean, size double, p double"
_DONE = "array<struct<id: bigint, none: boolean, up: boolean>>"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, have the weights in turn. No target is over ``most`` times its
    source; the excess goes to the others by weight: with sources ordered by limit over weight, those
    before the first whose limit holds at the level that is then left get their limit. One row per
    source is ordered as a whole, in one task: a bound of some ten million sources, however many documents.
    """
    one = Window.partitionBy(F.lit(0))
    w = F.lit(None).cast("double")
    for i, x in enumerate(weights):
        w = F.when(F.col("n") % len(weights) == i, F.lit(float(x))).otherwise(w)
    by = one.orderBy((F.col("limit") / F.col("w")), "n")
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("n", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("w", w).withColumn("limit", F.col("source_size") * float(most))
        .withColumn("level", (F.sum("source_size").over(one) - F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct(F.col("limit") / F.col("w"), F.col("n"), F.col("level")))).over(one))
        .select("source", "source_size", F.coalesce(F.least(F.col("open.level") * F.col("w"), F.col("limit")), F.col("limit")).alias("target"))
    )


def _draw(level: int, seed: int, *of: "F.Column") -> "F.Column":
    """A number from 0 to under 1, the same for the same unit and level."""
    return F.pmod(F.xxhash64(*of, F.lit(level), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _fold(level: int, seed: int) -> "F.Column":
    """Fold a block's sorted units: (one open unit, decided units)."""
    start = F.struct(F.lit(None).cast(f"struct<{_UNIT.replace(' ', ': ').replace(',:', ',')}>").alias("open"), F.array().cast(_DONE).alias("done"))

    def pair(state: "F.Column", unit: "F.Column") -> "F.Column":
        a, b = state["open"], unit
        mass_a, mass_b = a["size"] * a["p"], b["size"] * b["p"]
        # a gains up to `rise`, or loses up to `fall`, of the words that b loses or gains
        rise = F.least(a["size"] - mass_a, mass_b)
        fall = F.least(mass_a, b["size"] - mass_b)
        moved = F.when(_draw(level, seed, a["id"], a["none"], b["id"], b["none"]) * (rise + fall) < fall, rise).otherwise(-fall)
        # exactly one of the four bounds is met; which one is known without comparing sums
        up = moved == rise
        a_ends = F.when(up, a["size"] - mass_a <= mass_b).otherwise(mass_a <= b["size"] - mass_b)
        decided = F.when(a_ends, F.struct(a["id"].alias("id"), a["none"].alias("none"), up.alias("up"))).otherwise(F.struct(b["id"].alias("id"), b["none"].alias("none"), (~up).alias("up")))
        left = F.when(a_ends, _unit(b, (mass_b - moved) / b["size"])).otherwise(_unit(a, (mass_a + moved) / a["size"]))
        return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(F.struct(left.alias("open"), F.concat(state["done"], F.array(decided)).alias("done")))

    return F.aggregate("units", start, pair)


def _unit(u: "F.Column", p: "F.Column") -> "F.Column":
    return F.struct(u["id"].alias("id"), u["none"].alias("none"), u["size"].alias("size"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))


def round_copies(units: DataFrame, seed: int = 1) -> DataFrame:
    """(source, id, none, up) for units (source, id, none, size, p) with 0 < p < 1: whether each is taken once more.

    The number of levels follows from the largest source: each level keeps about one unit in BLOCK.
    """
    open_ = units
    most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done = None
    level = 0
    while most > 1:
        blocks = open_.groupBy("source").count().select("source", F.ceil(F.col("count") / BLOCK).alias("blocks"))
        folded = (
            open_.join(blocks, open_.source.eqNullSafe(blocks.source)).drop(blocks.source)
            .withColumn("block", F.pmod(F.xxhash64("id", "none", F.lit(level), F.lit(seed)), F.col("blocks")))
            .groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "none", "size", "p"))).alias("units"))
            .select("source", _fold(level, seed).alias("r"))
        )
        folded = _store.table(folded.select("source", "r.open", "r.done"), f"level{level}")
        part = folded.select("source", F.explode("done").alias("d")).select("source", "d.*")
        done = part if done is None else done.unionByName(part)
        open_ = folded.select("source", "open.*")
        most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    last = open_.select("source", "id", "none", (F.col("p") >= 0.5).alias("up"))
    return last if done is None else done.unionByName(last)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    sized = _store.table(sizes(docs), "sizes")
    goal = _store.table(targets(sized, weights, most), "targets")
    # one row per source: joined by value, so a hot source is split by the adaptive join or broadcast when small
    rows = sized.join(goal, sized.source.eqNullSafe(goal.source), "left").drop(goal.source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate + 1e-12)).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    units = (
        rows.groupBy("source", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
        .agg(F.sum("size").cast("double").alias("size"), F.first("p").alias("p")).filter((F.col("size") > 0) & (F.col("p") > 1e-12))
    )
    drawn = round_copies(_store.table(units.select("source", "id", "none", "size", "p"), "units"), seed)
    drawn = drawn.filter("up").select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("none").alias("o"), F.lit(1).alias("more"))
    joined = rows.join(drawn, rows.source.eqNullSafe(F.col("s")) & (F.coalesce(rows.doc_id, F.lit(0)) == F.col("i")) & (rows.doc_id.isNull() == F.col("o")), "left")
    copies = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")
    return joined.select("doc_id", rows.source, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix every document by weights 1, 2, 3 in turn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
