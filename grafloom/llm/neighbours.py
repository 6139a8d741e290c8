"""Approximate nearest neighbours by inner product through multi-index hashing.

Vectors are put into classes of like length (a power of the root of two), scaled by their class and
lengthened by one component so that the largest inner product becomes the smallest angle, rotated by
learned rotations (iterative quantisation: alternate signs and the orthogonal map that fits them best)
and reduced to signs: a few long vectors squeeze no others' angles. Codes are computed once, split into
substrings, and each index shard, of one class, keeps a table of rows by value for every substring. Of two codes within Hamming radius
R, some substring pair is within R // m (pigeonhole), so probing all values that near in every
table retrieves every code within R; the rest of the retrieved is dropped by the whole code, and
what is left is ranked by inner products of the original vectors.

The rotation and the radius are learned from a bounded sample: the radius holds RECALL of the true
neighbours within the sample, of which as many are taken as stand for the k nearest among all rows. A shard in which
fewer than k codes are that near widens its radius until there are k.

Queries and rows meet in blocks: a task holds one shard of rows and one block of queries.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length
than most take no part; rows of one vec_id are one row, with the smallest of their vectors; with fewer
candidates than k all are returned; equal vectors have equal scores to the last bit, and ties go to the
smaller vec_id; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from grafloom.llm import _store
from grafloom.llm._vectors import alike, matrix, usable

#: Rotations learned, bits of a substring, sample rows and queries, recall the radius is set for.
ROTATIONS, BITS, SAMPLE, SAMPLE_QUERIES, RECALL = 4, 8, 4000, 400, 0.96
#: Rows of a shard and queries of a block.
SHARD, QUERIES = 8_000, 4_000
_NEAR = np.array([bin(i).count("1") for i in range(1 << BITS)], np.uint8)


@dataclass
class Model:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int


def _class(norm: np.ndarray) -> np.ndarray:
    """Vectors of class c are at most as long as 2 ** (c / 2)."""
    return np.ceil(2 * np.log2(norm) - 1e-9).astype(np.int64)


def _longer(x: np.ndarray, query: bool) -> np.ndarray:
    """Rows as unit vectors whose angles order inner products within a class: queries are scaled to length 1, others filled up to it."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.c_[x / norm, np.zeros(len(x))]
    y = x / 2 ** (_class(norm) / 2)
    return np.c_[y, np.sqrt(np.maximum(0.0, 1.0 - (y**2).sum(1)))]


def _codes(x: np.ndarray, m: Model, query: bool) -> np.ndarray:
    """A byte per substring."""
    return np.packbits((_longer(x, query) - m.mean) @ m.rotation > 0, axis=1)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; each row's sum is formed alike, so that equal rows have equal ones."""
    return (x * q).sum(1)


def fit(x: np.ndarray, rows: int, k: int = 20, seed: int = 0) -> Model:
    """Learn rotations from sample rows, and the radius that the ``k`` nearest of ``rows`` vectors need."""
    y = _longer(x, False)
    mean = y.mean(0)
    y = y - mean
    _, _, axes = np.linalg.svd(y, full_matrices=False)
    width = min(64, axes.shape[0]) // 8 * 8 or axes.shape[0]
    p = y @ axes[:width].T
    rng, parts = np.random.default_rng(seed), []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(p.shape[1], p.shape[1])))[0]
        for _ in range(20):
            u, _, v = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (u @ v).T
        parts.append(axes[:width].T @ r)
    m = Model(mean, np.concatenate(parts, 1), 0)
    if m.rotation.shape[1] % 8:
        m.rotation = np.pad(m.rotation, ((0, 0), (0, 8 - m.rotation.shape[1] % 8)))
    q = x[rng.permutation(len(x))[:SAMPLE_QUERIES]]
    # as many neighbours as stand for the k nearest among all rows
    near = np.argsort(-(q @ x.T), axis=1)[:, 1 : 1 + max(1, round(k * min(1.0, len(x) / max(1, rows))))]
    if near.size:
        a, b = _codes(q, m, True), _codes(x, m, False)
        d = np.sort(_NEAR[a[:, None, :] ^ b[near]].sum(2).ravel())
        m.radius = int(d[min(len(d) - 1, int(RECALL * len(d)))])
    return m


class _Shard:
    """One shard's substring tables."""

    def __init__(self, x: np.ndarray, code: np.ndarray, m: Model) -> None:
        self.x, self.m, self.code = x, m, code
        self.whole = np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 8)))).view(np.uint64)
        self.tables = []
        for s in range(code.shape[1]):
            order = np.argsort(code[:, s], kind="stable")
            self.tables.append((order, np.bincount(code[:, s], minlength=1 << BITS)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within ``radius`` of a code, by probing every table."""
        hit = np.zeros(len(self.x), bool)
        most, over = divmod(radius, len(self.tables))
        for s, (order, size) in enumerate(self.tables):
            # radius = most * tables + over: only the first over + 1 tables need the larger substring radius
            near = _NEAR[np.arange(1 << BITS) ^ code[s]] <= most - (s > over)
            hit[order[np.repeat(near, size)]] = True
        rows = np.flatnonzero(hit)
        whole = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        return rows[np.bitwise_count(self.whole[rows] ^ whole).sum(1) <= radius]

    def search(self, q: np.ndarray, codes: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
        who, found, score = [], [], []
        for i in range(len(q)):
            radius = self.m.radius
            while True:
                rows = self.within(codes[i], radius)
                rows = rows[ids[rows] != own[i]]
                if len(rows) >= k or radius >= BITS * codes.shape[1]:
                    break
                radius += 4
            s = _scores(self.x[rows], q[i])
            best = np.lexsort((ids[rows], -s))[:k]
            who += [own[i]] * len(best)
            found += ids[rows][best].tolist()
            score += s[best].tolist()
        return who, found, score


def _coded(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with their class, their code and, for queries, the code that they ask with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"))
            if len(x):
                codes = [pa.array([c.tobytes() for c in _codes(x, model, q)], pa.binary()) for q in (False, True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_class(np.linalg.norm(x, axis=1))), *codes], [*b.schema.names, "class", "code", "asks"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, query boolean, class long, code binary, asks binary")


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def search(table: DataFrame, queries: "F.Column", k: int = 20, model: Model | None = None) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``table`` (vec_id, embedding) where ``queries`` holds."""
    rows = usable(table.select("vec_id", "embedding")).filter(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = _store.table(rows.withColumn("query", F.coalesce(queries, F.lit(False))), "vectors")
    rows = alike(rows)
    n, nq = rows.agg(F.count("*"), F.count_if("query")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not nq:
        return table.sparkSession.createDataFrame([], out)
    if model is None:
        sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        model = fit(matrix(sample.column("embedding")), n, k)
    coded = _store.table(_coded(rows, model), "coded")
    blocks = -(-nq // QUERIES)
    # classes are few: lengths of doubles span about 4,200 of them
    shards = coded.groupBy("class").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    every = shards.select("class", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    keyed = coded.join(F.broadcast(shards), "class").select("vec_id", "embedding", "code", "class", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = coded.filter("query").select("vec_id", "embedding", "asks", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    places = every.agg(F.collect_list(F.struct("class", "shard")).alias("places"))
    asked = asked.join(F.broadcast(places)).withColumn("place", F.explode("places")).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"), "asks", F.col("place.class").alias("q_class"), F.col("place.shard").alias("q_shard"), F.col("block").alias("q_block"))

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        shard = _Shard(matrix(have.column("embedding")), _bytes(have.column("code")), model)
        who, found, score = shard.search(matrix(ask.column("q_embedding")), _bytes(ask.column("asks")), ask.column("q_id").to_numpy(), have.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    key = ["class", "shard", "block"]
    found = keyed.groupBy(*key).cogroup(asked.groupBy(*(f"q_{c}" for c in key))).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
