"""A vector index on shared files: lists by cell, with codes of what a vector differs from its cell's centre.

Rows lie in folders by cell, so a search reads the folders of the nearest cells only. There it reads the codes
first, a byte a component; each row's coding error is stored, so the codes bound the distance from both sides,
and just the rows that may be among the nearest are read in full and compared exactly. How many cells a search
opens is measured when the index is made: as many as the asked recall took for rows of a sample. Centres are
as many as the square root of the rows, ``CELLS`` at most; they, and nothing that grows with the table, are
sent to tasks. Appending codes new rows by the centres at hand; overwriting makes a new index. Both are
published as a version (``sources.versions``).

Rows without a vector, of another length than most, or with components that aren't finite are left out; under
cosine also zero vectors. Of repeated ids each row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.operators import graph
from grafloom.sources.versions import Versions

CELLS = 4096
#: Rows that centres are fitted to, for each cell; rows whose neighbours are looked for to measure recall.
SAMPLE, PROBES = 64, 128
RECALL = 0.97


def _usable(df: DataFrame, metric: str, size: int | None) -> tuple[DataFrame, int]:
    """Rows (id, text, vector, attributes) that take part, and the length of their vectors; cosine's are of length 1."""
    v = F.col("vector").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.select("id", *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("text", "attributes")), v.alias("vector")).filter(F.coalesce(good, F.lit(False)))
    if metric == "cosine":
        rows = rows.filter(F.exists("vector", lambda x: x != 0)).withColumn("vector", F.transform("vector", lambda x: x / norm))
    if size is None:
        common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = common.n if common else 0
    return rows.filter(F.size("vector") == size), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _nearest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argsort(1, kind="stable")


def _listed(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """Rows with their cell, code (a byte a component, in steps of ``step``) and coding error."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), size)
            cell = np.concatenate([((sent.value**2).sum(1) - 2 * x[i : i + 1024] @ sent.value.T).argmin(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)
            rest = x - sent.value[cell]
            step = np.abs(rest).max(1, initial=0.0) / 127
            step[step == 0] = 1.0
            code = np.rint(rest / step[:, None]).astype(np.int8)
            error = np.sqrt(((rest - code * step[:, None]) ** 2).sum(1))
            made = {"cell": pa.array(cell, pa.int32()), "code": pa.array([c.tobytes() for c in code], pa.binary()), "step": pa.array(step), "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays([*b.columns, *made.values()], names=[*b.schema.names, *made])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell int, code binary, step double, error double")


def _write(versions: Versions, listed: DataFrame) -> str:
    """Rows by cell; a large cell is as many files as tasks hold it."""
    import uuid

    folder = f"data/rows-{uuid.uuid4().hex}"
    listed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{versions.base}/{folder}")
    return folder


class VectorIndex:
    """The newest version of an index under ``base``, or the one named."""

    def __init__(self, spark: SparkSession, base: str, number: int | None = None) -> None:
        self.spark, self.versions = spark, Versions(spark, base)
        self.manifest = self.versions.manifest(number)
        head = self.versions.read("head", self.manifest).first()
        self.metric, self.size, self.probes = head.metric, head["size"], head.probes
        self.centres = np.frombuffer(head.centres, np.float64).reshape(-1, max(1, self.size)) if self.size else np.zeros((0, 0))

    @staticmethod
    def build(df: DataFrame, base: str, metric: str = "l2", recall: float = RECALL, k: int = 10, cells: int | None = None) -> VectorIndex:
        """Write an index of (id, vector, and if there text, attributes), or a new version over an older one."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric: {metric}")
        spark = df.sparkSession
        versions = Versions(spark, base)
        rows, size = _usable(df, metric, None)
        rows = graph._written(rows)
        n = rows.count()
        cells = min(n, cells or max(1, min(CELLS, round(n**0.5))))
        centres = np.zeros((0, size))
        if n:
            some = rows.sample(min(1.0, 1.5 * SAMPLE * cells / n), seed=1).limit(SAMPLE * cells) if n > SAMPLE * cells else rows
            model = KMeans(k=max(2, cells), seed=1, maxIter=8).fit(some.select(array_to_vector("vector").alias("features"))) if cells > 1 else None
            centres = np.array(model.clusterCenters()) if model else np.array([rows.select("vector").first()[0]])
        folder = _write(versions, _listed(rows, centres, size))
        asked = rows.orderBy(F.xxhash64("id", F.lit(3))).limit(PROBES).select("vector").collect() if n else []
        probes = _cells_for(rows, np.array([r.vector for r in asked]), centres, size, k, recall) if n else 0
        head = spark.createDataFrame([(metric, size, probes, centres.tobytes())], "metric string, size int, probes int, centres binary")
        was = versions.manifest()
        number = versions.publish({"head": [versions.write(head, "head")], "rows": [folder]}, was["number"])
        return VectorIndex(spark, base, number)

    def append(self, df: DataFrame) -> VectorIndex:
        """A version with further rows, coded by the centres at hand."""
        rows, _ = _usable(df, self.metric, self.size)
        folder, was = _write(self.versions, _listed(graph._written(rows), self.centres, self.size)), self.versions.manifest()
        number = self.versions.publish(was["tables"] | {"rows": [*was["tables"]["rows"], folder]}, was["number"])
        return VectorIndex(self.spark, self.versions.base, number)

    def rows(self) -> DataFrame:
        """All rows, the cell among their columns."""
        parts = [self.spark.read.parquet(f"{self.versions.base}/{f}") for f in self.manifest["tables"]["rows"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def cells(self, query: list[float], probes: int | None = None) -> list[int]:
        """The cells that a search opens, the nearest first."""
        x = self._query(query)
        return [int(c) for c in _nearest_cells(x[None], self.centres)[0][: probes or self.probes]]

    def _query(self, query: list[float]) -> np.ndarray:
        x = np.array(query, np.float64)
        if len(x) != self.size:
            raise ValueError(f"a query of {len(x)} components, vectors of {self.size}")
        return x / (np.sqrt((x**2).sum()) or 1.0) if self.metric == "cosine" else x

    def search(self, query: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """(id, text, attributes, distance): the ``k`` nearest rows of the opened cells, ties by id; squared distance, or 1 - cosine."""
        if not len(self.centres):
            return self.spark.createDataFrame([], "id string, text string, attributes string, distance double")
        x, opened = self._query(query), self.cells(query, probes)
        inside = self.rows().filter(F.col("cell").isin(opened))  # of a bounded number; folders of others are not read
        centres, q = self.centres, x
        kind = inside.schema["id"].dataType.simpleString()

        def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    code = np.frombuffer(b"".join(f["code"]), np.int8).reshape(len(f), -1)
                    near = np.sqrt(((centres[f.cell.to_numpy()] + code * f.step.to_numpy()[:, None] - q) ** 2).sum(1))
                    yield pd.DataFrame({"id": f.id, "cell": f.cell, "low": near - f.error.to_numpy() - 1e-9, "high": near + f.error.to_numpy() + 1e-9})

        bounds = graph._written(inside.select("id", "cell", "code", "step", "error").mapInPandas(bound, f"id {kind}, cell int, low double, high double"))
        limit = bounds.orderBy("high").limit(k).agg(F.max("high"), F.count("*")).first()
        if not limit[1]:
            return inside.select("id", "text", "attributes", F.lit(0.0).alias("distance")).limit(0)
        may = bounds.filter(F.col("low") <= limit[0]).select("id", "cell").distinct()
        exact = F.aggregate(F.zip_with("vector", F.array(*(F.lit(float(v)) for v in x)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
        # of unit vectors the squared distance is twice one less the cosine
        exact = exact / 2 if self.metric == "cosine" else exact
        return inside.join(may, ["id", "cell"], "left_semi").select("id", "text", "attributes", exact.alias("distance")).orderBy("distance", "id").limit(k)


def _cells_for(rows: DataFrame, asked: np.ndarray, centres: np.ndarray, size: int, k: int, recall: float) -> int:
    """How many cells hold the share ``recall`` of the ``k`` nearest to the asked vectors, themselves left out; all rows are compared, a block at a time."""
    sent = rows.sparkSession.sparkContext.broadcast((asked, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, c = sent.value
        place = _nearest_cells(q, c).argsort(1)  # of each cell in each query's order
        best: list[list[tuple[float, int]]] = [[] for _ in q]
        for b in batches:
            x = _matrix(b.column("vector"), size)
            cell = _nearest_cells(x, c)[:, 0]
            d = np.maximum(((q**2).sum(1)[:, None] + (x**2).sum(1)) - 2 * q @ x.T, 0)
            for i in range(len(q)):
                top = np.argpartition(d[i], min(k, len(x) - 1))[: k + 1]
                best[i] = sorted([*best[i], *((float(d[i, j]), int(place[i, cell[j]])) for j in top)])[: k + 1]
        flat = [(i, d, p) for i, own in enumerate(best) for d, p in own]
        if flat:
            i, d, p = zip(*flat, strict=True)
            yield pa.record_batch({"q": pa.array(i, pa.int32()), "d": pa.array(d, pa.float64()), "place": pa.array(p, pa.int32())})

    found = rows.select("vector").mapInArrow(run, "q int, d double, place int").toPandas()  # k + 1 rows for each query and task
    found = found.sort_values(["q", "d"]).groupby("q").head(k + 1)
    places = np.sort(found.groupby("q").apply(lambda f: f.iloc[1:], include_groups=False)["place"].to_numpy())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1
