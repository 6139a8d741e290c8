"""Vectors compressed to codes: integer codebooks, nearest entries through kd-trees.

Each component x becomes floor(256 * x). A vector is cut into equal consecutive parts, each with a codebook
of its own that starts as that part of the vectors with the smallest ids. A round broadcasts a kd-tree for
each codebook (``entries`` points each, whatever the table's size); tasks search it by branch and bound,
whole batches at a time, and add up what each entry got as integers. The sums of a round are one row for
each entry and task, added by Spark; a row for each entry reaches the driver. A branch whose bound equals
the best distance is still visited, so that among equally near entries the lower index wins.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a zero vector
is kept; vectors of other lengths than the longest, or whose length the parts don't divide, are filled up
with zeros; repeated ids are rows of their own, ordered by vector where both count for a codebook; a null
id is ordered last; fewer rows than entries give smaller codebooks; an empty table gives an empty result;
other columns are not read, whatever their names. Components beyond 2**18 in size raise an error, as their
squared distances would pass 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.llm import _store

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a leaf.
LEAF = 4
#: Greatest integer component.
LIMIT = 1 << 26
#: Rows searched at a time.
STEP = 8192


class Tree:
    """A kd-tree over a codebook: nodes with the box of their entries, leaves with entry numbers ascending."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        x = self.entries[own]
        at, lo, hi = len(self.nodes), x.min(0), x.max(0)
        self.nodes.append(())
        axis = int((hi - lo).argmax())
        if len(own) <= LEAF or hi[axis] == lo[axis]:
            self.nodes[at] = (lo, hi, own, -1, -1)
        else:
            order = own[np.argsort(x[:, axis], kind="stable")]
            left, right = order[: len(own) // 2], order[len(own) // 2 :]
            self.nodes[at] = (lo, hi, None, self._grow(np.sort(left)), self._grow(np.sort(right)))
        return at

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distance to the node's box."""
        lo, hi = self.nodes[node][:2]
        gap = np.maximum(np.maximum(lo - x, x - hi), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry to each row; of equally near ones the lowest number."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        found = np.full(len(x), len(self.entries))
        self._visit(0, x, np.arange(len(x)), best, found)
        return found, best

    def _visit(self, node: int, x: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, own, left, right = self.nodes[node]
        if own is not None:
            for i in own:
                gap = x[rows] - self.entries[i]
                d = np.einsum("ij,ij->i", gap, gap)
                won = (d < best[rows]) | ((d == best[rows]) & (i < found[rows]))
                best[rows[won]], found[rows[won]] = d[won], i
            return
        a, b = self._bound(left, x[rows]), self._bound(right, x[rows])
        for near, far, bound, these in ((left, right, b, a <= b), (right, left, a, a > b)):
            mine, past = rows[these], bound[these]
            self._visit(near, x, mine, best, found)
            # an equal bound may hide an entry just as near with a lower number
            self._visit(far, x, mine[past <= best[mine]], best, found)


@dataclass
class Codebooks:
    """Integer codebooks (part, entry, position)."""

    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree(b) for b in self.books]


def _kept(table: DataFrame, parts: int, label: str | None = "label") -> tuple[DataFrame, int]:
    """Rows (vec_id, label, v) with integer components, all of one length that the parts divide; and that length."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select("vec_id", *([F.col(label).alias("label")] if label else [F.lit(None).cast("int").alias("label")]), v.alias("v")).filter(F.coalesce(good, F.lit(False)))
    size, top = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (top or 0) > LIMIT // 256:
        raise ValueError(f"components beyond {LIMIT // 256} can't be coded")
    size = max(1, -(-(size or 0) // parts)) * parts
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("long"))
    return rows.withColumn("v", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _searched(b: pa.RecordBatch, trees: list[Tree], size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch, a step at a time: their vectors by part, the numbers and the distances of the nearest entries."""
    x = _matrix(b.column("v"), size)
    for at in range(0, len(x), STEP):
        y = x[at : at + STEP].reshape(-1, len(trees), size // len(trees))
        near = [t.nearest(np.ascontiguousarray(y[:, p])) for p, t in enumerate(trees)]
        yield slice(at, at + STEP), y, np.stack([n for n, _ in near], 1), np.stack([d for _, d in near], 1)


def _sums(rows: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """(part, entry, n, total): how many parts each entry is nearest to, and their sums by position."""
    sent = rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        parts, width = len(trees), size // len(trees)
        n = np.zeros((parts, len(trees[0].entries)), np.int64)
        total = np.zeros((*n.shape, width), np.int64)
        for b in batches:
            for _, y, near, _ in _searched(b, trees, size):
                for p in range(parts):
                    np.add.at(n[p], near[:, p], 1)
                    np.add.at(total[p], near[:, p], y[:, p])
        p, e = np.nonzero(n)
        if len(p):
            yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    made = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    width = size // len(books.books)
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(width))).alias("total"))


def fit(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all rows of ``table`` (vec_id, embedding); None where no row is kept."""
    rows, size = _kept(table, parts, None)
    return _fit(rows, size, parts, entries, rounds)


def _fit(rows: DataFrame, size: int, parts: int, entries: int, rounds: int) -> Codebooks | None:
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not first:
        return None
    books = Codebooks(np.array([r.v for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        new = books.books.copy()
        for r in _sums(rows, books, size).collect():  # a row for each entry
            new[r.part, r.entry] = np.array(r.total, np.int64) // r.n
        books = Codebooks(new)
    return books


def _encode(rows: DataFrame, books: Codebooks, size: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, near, far in _searched(b, sent.value, size):
                code = pa.array([r.tobytes() for r in near.astype(np.uint8)], pa.binary())
                yield pa.record_batch({"vec_id": b.column("vec_id")[at], "label": b.column("label")[at], "code": code, "error": pa.array(far.sum(1), pa.int64())})

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label}, code binary, error long")


def encode(table: DataFrame, books: Codebooks, label: str | None = None) -> DataFrame:
    """(vec_id, label, code, error): a byte for each part, and the squared distance to what the code stands for."""
    rows, size = _kept(table, len(books.books), label)
    if size != books.books.shape[0] * books.books.shape[2]:
        raise ValueError(f"vectors of {size} components, codebooks of {books.books.shape[0] * books.books.shape[2]}")
    return _encode(rows, books, size)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, embedding): the vectors that codes stand for, in the middle of their integer steps."""
    sent = codes.sparkSession.sparkContext.broadcast(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            x = (np.concatenate([sent.value[p][c[:, p]] for p in range(c.shape[1])], 1) + 0.5) / 256
            yield pa.record_batch({"vec_id": b.column("vec_id"), "embedding": pa.array(list(x), pa.list_(pa.float64()))})

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with each label's summed error and a digest of the codebooks."""
    rows, size = _kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), PARTS)
    books = _fit(rows, size, PARTS, ENTRIES, ROUNDS)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = _store.table(_encode(rows, books, size), "codes")
    by = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
