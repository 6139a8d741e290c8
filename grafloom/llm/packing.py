"""Mixture-controlled packing by deficit round-robin over source queues.

Documents are dealt over partitions by a hash, so that every partition holds every large source in
about its share, in whatever order the table lies. Each partition keeps a queue of token runs per source. A window of
2048 tokens is filled by turns: the source furthest behind its target share serves up to a quantum of
tokens, documents being cut freely, and what a source is owed or has overdrawn carries on to the next
window. Between partitions it carries too: a pass over text sizes by partition and source gives, by sums
over the partitions before it, what each source is owed where a partition begins (in tokens, at
TOKENS_PER_BYTE). A partition's last, shorter run is cut at powers of two, which need no padding.

Every source has a queue, in the partitions that hold any of it. What a partition must know of its
sources, a row for each, travels with its documents and comes first; nothing is broadcast. Memory is
bounded by the look-ahead and one slice of text.

Defined cases: a null text is empty and gives its end id; a null source is a source; of sources that are
equally far behind the first by name is served; repeated rows are packed each; an empty table gives no
pieces; a very long text is tokenised whole, by one task, at about 40 bytes a byte of text. Other columns
are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from grafloom.llm import _store, _tokens, _words
from grafloom.llm._tokens import WINDOW, crc

QUANTUM, LOOKAHEAD, TOKENS_PER_BYTE = 512, 64 * WINDOW, 0.35
#: Bytes of text of a partition: at most, and at least where there are fewer than three for each core.
LARGE, SMALL = 128 << 20, 4 << 20
#: Bytes of text that are tokenised at once.
SLICE = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Packer:
    """The queues of one partition, with each source's share and what it is owed."""

    def __init__(self, sources: list[tuple[str | None, float, float]], base: int) -> None:
        sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
        self.queue = {s: i for i, (s, _, _) in enumerate(sources)}
        self.share, self.got = (np.array([s[k] for s in sources], float) for k in (1, 2))
        self.got = -self.got
        self.served, self.base, self.sequence = 0.0, base, 0
        self.queues: list[deque] = [deque() for _ in sources]
        self.waiting, self.ready = 0, np.zeros(len(sources), bool)
        self.rows: list[tuple] = []

    def add(self, source: str | None, doc_id: int | None, ids: np.ndarray) -> None:
        q = self.queue[source]
        self.queues[q].append([doc_id, ids, 0])
        self.ready[q] = True
        self.waiting += len(ids)

    def fill(self, size: int) -> None:
        """One sequence of exactly ``size`` tokens."""
        offset = 0
        while offset < size:
            debt = np.where(self.ready, self.share * self.served - self.got, -np.inf)
            q = int(debt.argmax())
            doc_id, ids, at = head = self.queues[q][0]
            room, left = size - offset, len(ids) - at
            n = min(room, left)
            if n > QUANTUM and n - QUANTUM >= QUANTUM // 4:
                n = QUANTUM
            self.rows.append((doc_id, at, n, crc(ids[at : at + n]), len(ids), self.base + self.sequence, offset))
            head[2] += n
            if head[2] == len(ids):
                self.queues[q].popleft()
                self.ready[q] = bool(self.queues[q])
            self.got[q] += n
            self.served += n
            offset += n
            self.waiting -= n
        self.sequence += 1

    def finish(self) -> None:
        while self.waiting >= WINDOW:
            self.fill(WINDOW)
        while self.waiting:
            self.fill(1 << (self.waiting.bit_length() - 1))

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * len(_COLUMNS)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], _COLUMNS)


def _plan(docs: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """(p, source, share, owed): each source's target share, and the tokens it is owed where partition ``p`` begins.

    Windows run over one row per partition and, for a source, over the partitions that hold it.
    """
    sizes = docs.groupBy("p", "source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("double").alias("n"))
    sizes = _store.table(sizes, "sizes")
    sources = sizes.groupBy("source").agg(F.sum("n").alias("w"))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(s, s is None, float(w)) for s, w in weights.items()], "name string, none boolean, given double")
        sources = sources.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").select("source", F.coalesce("given", F.lit(0.0)).alias("w"))
    total = sources.agg(F.sum("w")).first()[0] or 1.0
    share = sources.select(F.col("source").alias("s"), (F.col("w") / total).alias("share"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = sizes.groupBy("p").agg(F.sum("n").alias("n")).select(F.col("p").alias("_p"), before(Window.orderBy("p")).alias("all_before"))
    own = sizes.withColumn("own_before", before(Window.partitionBy("source").orderBy("p")))
    rows = own.join(whole, F.col("p") == F.col("_p")).join(share, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("p", "source", "share", (TOKENS_PER_BYTE * (F.col("share") * F.col("all_before") - F.col("own_before"))).alias("owed"))


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents; ``weights`` by source, if not their shares of the text."""
    docs = docs.select("doc_id", "text", "source")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // LARGE), min(3 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // SMALL)))
    docs = docs.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("p", F.pmod("h", F.lit(parts)))
    none = F.lit(None)
    told = _plan(docs, weights).select("p", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "source", "share", "owed")
    rows = told.unionByName(docs.select("p", F.lit(1).alias("kind"), "h", "doc_id", "text", "source", none.cast("double").alias("share"), none.cast("double").alias("owed")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.shared(tokenizer)
        packer, at, sources = None, None, []
        for b in _words.slices(batches, most=SLICE):
            ids, offs = tokens.ids(b.column("text"))
            cols = (b.column(c).to_pylist() for c in ("p", "kind", "doc_id", "source", "share", "owed"))
            for i, (p, kind, doc_id, source, share, owed) in enumerate(zip(*cols, strict=True)):
                if p != at:
                    if packer is not None:
                        packer.finish()
                        yield packer.flush()
                    packer, at, sources = None, p, []
                if not kind:
                    sources.append((source, share, owed))
                    continue
                if packer is None:
                    packer = _Packer(sources, p << 33)
                packer.add(source, doc_id, ids[offs[i] : offs[i + 1]])
            while packer is not None and packer.waiting >= LOOKAHEAD:
                packer.fill(WINDOW)
            if packer is not None:
                yield packer.flush()
        if packer is not None:
            packer.finish()
            yield packer.flush()

    # a total order but for rows that are alike: a task that runs again, after a lost executor, cuts the same pieces
    return rows.repartitionById(parts, F.col("p").cast("int")).sortWithinPartitions("p", "kind", "h", "doc_id", "source").mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document towards the sources' own shares."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
