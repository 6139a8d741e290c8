"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, learned independently on the halves of normalised vectors, form a product grid; a
vector lies in the cell of its two nearest centres. The multi-sequence traversal visits cells by
growing sum of squared distances of the two halves. How many are visited follows from the target
recall: sample vectors are turned away to exactly the least similarity, and the number is the
traversal rank of the cells that RECALL of them land in. Vectors met there are verified by cosine in
double precision. A pair counts when either side's visit meets the other.

Equal vectors are one class and expand to no pairs. Each pair of a query chunk and a cell's chunk is
a bounded block, so that a crowded cell is many blocks; a block yields numbers of links and a
spanning forest of them, not the pairs.

The number of centres grows with the root of the number of vectors, and the sample with it, so that a
cell of an even table holds about 100 vectors at every size.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length than
most, and rows with a null label, link with nothing and are kept; rows of one vec_id are one row, with
the smallest of their labels and vectors; a component's smallest vec_id stands for it; empty tables give
no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.llm import _links, _store
from grafloom.llm._vectors import alike, k_means, matrix, usable

#: Sample rows (at least, and for each centre); recall of the traversal; members of a block.
SAMPLE, EACH, RECALL, CHUNK = 6000, 32, 0.995, 1000
#: Cells of all rows' traversals formed at once.
SLICE = 1 << 20


@dataclass
class Model:
    left: np.ndarray
    right: np.ndarray
    visits: int

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return tuple(((p**2).sum(1)[:, None] - 2 * p @ c.T + (c**2).sum(1)) for p, c in ((x[:, :h], self.left), (x[:, h:], self.right)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def traverse(self, x: np.ndarray, n: int) -> np.ndarray:
        """Each row's first ``n`` cells in the order of the multi-sequence traversal.

        The n smallest sums of two sorted lists lie where (i + 1)(j + 1) <= n, so only those are formed.
        """
        a, b = self._distances(x)
        ia, ib = a.argsort(1), b.argsort(1)
        i, j = (g.ravel() for g in np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij"))
        keep = (i + 1) * (j + 1) <= n
        i, j = i[keep], j[keep]
        total = np.take_along_axis(a, ia, 1)[:, i] + np.take_along_axis(b, ib, 1)[:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, :n]
        rows = np.arange(len(x))[:, None]
        return ia[rows, i[first]] * len(self.right) + ib[rows, j[first]]

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells each row's traversal visits before ``cell``: those of a smaller sum."""
        a, b = self._distances(x)
        rows = np.arange(len(x))
        rest = (a[rows, cell // len(self.right)] + b[rows, cell % len(self.right)])[:, None] - a
        b = np.sort(b, axis=1)
        return np.array([np.searchsorted(b[r], rest[r] - 1e-12).sum() for r in rows])


def centres(rows: int) -> int:
    """Of each half's codebook, for ``rows`` vectors."""
    return max(2, int(np.sqrt(rows / 100)))


def fit(x: np.ndarray, rows: int, least: float, seed: int = 0) -> Model:
    """Codebooks for ``rows`` vectors from unit sample rows, and the visits that meet RECALL at similarity ``least``."""
    k = centres(rows)
    h = x.shape[1] // 2
    m = Model(k_means(x[:, :h], k, seed=seed), k_means(x[:, h:], k, seed=seed + 1), 1)
    rng = np.random.default_rng(seed)
    y = x[rng.integers(0, len(x), 2000)]
    u = rng.normal(size=y.shape)
    u -= (u * y).sum(1, keepdims=True) * y
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    mate = m.cells(least * y + np.sqrt(1 - least**2) * u)
    # one more than the sample's quantile, for ties
    m.visits = min(len(m.left) * len(m.right), int(np.sort(m.rank(y, mate))[int(RECALL * (len(y) - 1))]) + 2)
    return m


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links that form a spanning forest of the links a-b."""
    parent: dict[int, int] = {}
    keep = []
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent.get(u, u) != u:
            parent[u] = u = parent.get(parent[u], parent[u])
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        if u != v:
            parent[max(u, v)] = min(u, v)
            keep.append(i)
    return np.array(keep, np.int64)


def link(table: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    least_row = F.min(F.struct(F.col("label").isNull().alias("a"), "label", F.col("embedding").isNull().alias("b"), "embedding")).alias("r")
    rows = _store.table(table.select("vec_id", "label", "embedding").groupBy("vec_id").agg(least_row).select("vec_id", "r.label", "r.embedding"), "rows")
    good = alike(usable(rows).filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    member = _store.table(good, "members")
    class_ = member.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = _store.table(class_, "classes")
    size = classes.count()
    if not size:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = matrix(classes.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, EACH * centres(size))).toArrow().column("embedding"))
    model = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), size, least)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE // int(min(len(model.left) * len(model.right), model.visits * (1 + np.log(model.visits)))))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x = matrix(b.column("embedding"))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                visits = model.traverse(unit, model.visits)
                lists = pa.ListArray.from_arrays(np.arange(0, visits.size + 1, visits.shape[1], dtype=np.int32), pa.array(visits.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.cells(unit), pa.int32()), lists], [*b.schema.names, "cell", "visits"])

    placed = _store.table(classes.mapInArrow(place, "label " + dict(classes.dtypes)["label"] + ", embedding array<double>, id long, n long, cell int, visits array<int>"), "placed")
    held = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    have = placed.join(held, ["label", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    ask = placed.select("label", "embedding", "id", "n", F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    # queries of a cell are as many as its members times the visits: as many query chunks, and every pair of chunks a block
    asked = ask.groupBy("label", "cell").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("turns"))
    have = have.join(asked, ["label", "cell"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    ask = ask.join(held, ["label", "cell"]).join(asked, ["label", "cell"]).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(3)), F.col("turns"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["label", "cell", "chunk", "turn"]
    have = have.select(*key, "id", "n", "embedding", "visits").withColumn("chunk", F.col("chunk").cast("int")).withColumn("turn", F.col("turn").cast("int"))
    ask = ask.select(F.col("label").alias("q_label"), F.col("cell").alias("q_cell"), F.col("chunk").cast("int").alias("q_chunk"), F.col("turn").cast("int").alias("q_turn"), F.col("id").alias("q_id"), F.col("n").alias("q_n"), F.col("embedding").alias("q_embedding"), F.col("own").alias("q_own"))

    def verify(have: pa.Table, ask: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], []]
        if have.num_rows and ask.num_rows:
            x, y = matrix(ask.column("q_embedding")), matrix(have.column("embedding"))
            cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
            ids, jds = ask.column("q_id").to_numpy(), have.column("id").to_numpy()
            q, m = np.nonzero((cos >= least) & (ids[:, None] != jds))
            if len(q):
                wq, wm = ask.column("q_n").to_numpy(), have.column("n").to_numpy()
                # a member counts the query here only if its own visits don't meet it
                visits = matrix(have.column("visits")).astype(np.int64)
                one_way = ~(visits[m] == ask.column("q_own").to_numpy()[q][:, None]).any(1)
                for who, by, w in ((ids[q], len(q), wm[m]), (jds[m[one_way]], one_way.sum(), wq[q[one_way]])):
                    if by:
                        u, back = np.unique(who, return_inverse=True)
                        cols[0] += u.tolist()
                        cols[1] += [None] * len(u)
                        cols[2] += np.bincount(back, w).astype(np.int64).tolist()
                f = _forest(ids[q], jds[m])
                cols[0] += ids[q[f]].tolist()
                cols[1] += jds[m[f]].tolist()
                cols[2] += [0] * len(f)
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})

    met = _store.table(have.groupBy(*key).cogroup(ask.groupBy(*(f"q_{k}" for k in key))).applyInArrow(verify, "a long, b long, n long"), "met")
    parts = _links.components(met.filter("b is not null"))
    links = met.groupBy("a").agg(F.sum("n").alias("more"))
    result = classes.select("label", "embedding", "id", "n").join(links, F.col("id") == F.col("a"), "left").join(parts, F.col("id") == F.col("node"), "left")
    result = result.select("label", "embedding", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = member.join(result, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    own = rows.select(F.col("vec_id").alias("v"))
    got = own.join(linked, F.col("v") == F.col("vec_id"), "left").select(F.col("v").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "v").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of equal label with cosine 0.98 or more."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
