"""N-gram Jaccard join through a token-group matrix.

A document's set is its distinct word shingles as 64-bit hashes; equal sets are one class and are
compared once. The join is exact: which documents are connected does not depend on any choice below.

Order and bounds. Two sets link only if they share ``alpha`` tokens, alpha = ceil(t (|x| + |y|) / (1 + t)).
All tokens stand in one total order, frequent ones last, so that what is a document's own comes first.
Of two sets that link, the l-th common token stands at place |x| - alpha + l - 1 or before in x, and
so in y. Hence only prefixes are compared at first: the smaller set is found by its first
|x| - alpha(x, x) + k tokens, the larger asks with its first |y| - ceil(t |y|) + k, and k of them agree,
k = 1 + (|x| - ceil(t |x|)) // 6. A near copy with more tokens of its own than links allow meets
nothing, however large its family. How often a token occurs is counted over all tokens of all texts;
any order leaves the join exact, so the list that tells it is bounded (HOT most frequent ones) and
its keys are cut to so many bits that few tokens fall together.

Groups. In each token's list the document that has the fewest rarer tokens is its leader; documents that
link with the leader of most of their tokens form a component with it at once. All documents are then
partitioned into groups of up to about BLOCK of like size: members of one component, or unlinked ones
that have the same leader. The matrix has a row for each token and group: the places and sizes of the members that hold
it. A document meets a group of another component if the rows that they share are k or more and stand
early enough; the group is opened only if the union of its members' sets holds alpha of the document's
tokens: no member can share more.

Tokens travel in compressed blocks of sorted arrays, not as rows. Texts of classes that may have a
partner are read again; no table of all sets is made. Tables that grow with the input are joined by
sorting (``merge``) at every size, never by broadcast, so that a plan that holds on a small table is the
plan of a large one.

Defined cases: null and wordless texts are empty and link with nothing; shorter texts than a shingle
are one shingle; repeated rows are copies and link; an empty table gives no rows; a very long text is
one set, held by one task at about 60 bytes a word. Classes are told apart by a 64-bit sum over their
tokens. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grafloom.llm import _blocks, _links, _store, _words

#: Most frequent tokens that are put last; bytes of text per range of the key space; members of a group; queries that meet it in a task.
HOT, RANGE, BLOCK, QUERIES = 1 << 20, 16 << 20, 64, 512
#: Holders from which a token's list is not put together in one task: it has no leader, and its rows lie by class.
LONG = 50_000
#: Keys or postings that a task holds before it sends them.
HELD = 3 << 19
#: Groups hold sets of which the largest is at most about so many times the smallest.
LIKE = 1.1


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles (ascending), their rows, the sets' sizes and signatures."""
    raw, offs = _words.buffers(texts)
    raw = _words.lower(raw)
    start, end, row = _words.words(raw, offs)
    h, r = _words.distinct(*_words.shingles(_words.hashes(raw, start, end), row, len(texts), words))
    n = np.bincount(r, minlength=len(texts))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_words.mix(h), dtype=np.uint64)])
    edge = np.concatenate([[0], np.cumsum(n)])
    return h, r, n, _words.mix(total[edge[1:]] - total[edge[:-1]] + n.astype(np.uint64)).view(np.int64)


def _once(sig: np.ndarray) -> np.ndarray:
    """Which rows are the first of their class."""
    first = np.zeros(len(sig), bool)
    first[np.unique(sig, return_index=True)[1]] = True
    return first


def _alpha(a, b, percent: int):
    """Tokens that sets of sizes ``a`` and ``b`` share at least if they link; numpy."""
    return -(-percent * (a + b) // (100 + percent))


def _common(n, percent: int):
    """How many prefix tokens a set of ``n`` shares with one at least as large; numpy."""
    return 1 + (n + (-percent * n) // 100) // 6


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n) // 100 + _common(n, percent)


def _sql_alpha(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9).cast("long")


def _sql_common(n: Column, percent: int) -> Column:
    return 1 + F.floor((n - F.floor((n * percent + 99) / 100)) / 6)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size) and sig (equal for equal sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _words.slices(batches):
            _, _, n, sig = _sets(b.column("text"), words)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n": pa.array(n), "sig": pa.array(sig)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long")


def _mask(size: int) -> np.uint64:
    """The bits of a token that tell its frequency: eight keys or more for each byte of text."""
    return np.uint64(2**64 - 2 ** max(0, 64 - max(16, size.bit_length() + 3)))


def _frequent(docs: DataFrame, words: int, ranges: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT masked tokens that stand in most texts, ascending, and in how many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            return _blocks.batch(list(_blocks.by_range("n", [keys, c.astype("<u4")], ranges)))

        for b in _words.slices(batches):
            h, r, _, sig = _sets(b.column("text"), words)
            # copies within a slice count once
            held.append(h[_once(sig)[r]] & mask)
            size += len(held[-1])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, blocks in _blocks.groups(batches):
            keys, c = (np.concatenate(x) for x in zip(*blocks, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, c = keys[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, c = keys[first], np.minimum(np.add.reduceat(c, first), 2**32 - 1)
            top = np.flatnonzero(c >= 3)
            top = np.sort(top[np.lexsort((keys[top], -c[top]))[: max(1, HOT // ranges)]])
            yield _blocks.batch([("hot", part, _blocks.pack(keys[top], c[top].astype("<u4")))])

    got = _blocks.shuffled(docs.select("text").mapInArrow(count, _blocks.SCHEMA), ranges).mapInArrow(merge, _blocks.SCHEMA).collect()
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    cols = [_blocks.unpack(bytes(r.block)) for r in sorted(got, key=lambda r: r.part)]
    return np.concatenate([c[0] for c in cols]), np.concatenate([c[1] for c in cols])


def _ordered(h: np.ndarray, r: np.ndarray, n: np.ndarray, percent: int, hot: np.ndarray, often: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, ...]:
    """The prefixes' tokens under the order (frequency, hash): token, row, place, frequency."""
    c = np.ones(len(h), np.uint32)
    if len(hot) and len(h):
        key = h & mask
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        hit = hot[at] == key
        c[hit] = often[at[hit]]
        order = np.lexsort((h, c, r))
        h, r, c = h[order], r[order], c[order]
    place = np.arange(len(h)) - (np.cumsum(n) - n)[r]
    keep = place < _prefix(n, percent)[r]
    return h[keep], r[keep], place[keep], c[keep]


def _lists(docs: DataFrame, words: int, percent: int, ranges: int, mask: np.uint64, hot: np.ndarray, often: np.ndarray) -> DataFrame:
    """(token, sig, place, leader) for prefix tokens that more than one class may hold."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, often))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, s, place, c = (np.concatenate(x) for x in zip(*held, strict=True))
            out = []
            for kind, use, cols in (("long", c > LONG, (s, h, place)), ("list", c <= LONG, (h, s, place))):
                order = np.flatnonzero(use)
                order = order[np.argsort(cols[0][order], kind="stable")]
                out += _blocks.by_range(kind, [x[order] for x in cols], ranges)
            return _blocks.batch(out)

        for b in _words.slices(batches):
            h, r, n, sig = _sets(b.column("text"), words)
            h, r, place, c = _ordered(h, r, n, percent, *shared.value, mask)
            use = _once(sig)[r]
            h, r, place, c = h[use], r[use], place[use], c[use]
            held.append((h, sig[r].view("<u8"), place.astype("<u4"), c))
            size += len(h)
            if size > HELD // 2:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, blocks in _blocks.groups(batches):
            a, b, place = (np.concatenate(x) for x in zip(*blocks, strict=True))
            # copies of a class have equal places
            order = np.lexsort((b, place, a))
            a, b, place = a[order], b[order], place[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            a, b, place = a[new], b[new], place[new]
            if kind == "list":
                first = np.r_[True, a[1:] != a[:-1]]
                leader = b[np.flatnonzero(first)][np.cumsum(first) - 1]
                two = ~(first & np.r_[a[1:] != a[:-1], True])
                token, sig, place, leader = a[two], b[two], place[two], pa.array(leader[two].view(np.int64))
            else:
                token, sig, leader = b, a, pa.nulls(len(a), pa.int64())
            yield pa.record_batch({"token": pa.array(token.view(np.int64)), "sig": pa.array(sig.view(np.int64)), "place": pa.array(place.astype(np.int64)), "leader": leader})

    return _blocks.shuffled(docs.select("text").mapInArrow(emit, _blocks.SCHEMA), ranges).mapInArrow(keep, "token long, sig long, place long, leader long")


def _partnered(lists: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Rows, with n, of classes that other classes share enough prefix tokens with, the first of them early enough."""
    n = F.col("n")
    smallest = F.floor((n * percent + 99) / 100).cast("long")
    # a class has no more rows than its prefix
    own = Window.partitionBy("sig")
    rows = lists.join(sketch.select("sig", "n").distinct().hint("merge"), "sig").withColumn("k", F.count("*").over(own)).withColumn("first", F.min("place").over(own))
    rows = rows.filter((F.col("k") >= _sql_common(smallest, percent)) & (F.col("first") <= n - smallest))
    return rows.select("token", "sig", "n", "place", "leader")


#: Bits of the filter that keeps most sets without a partner from being sent; its size is fixed.
FILTER = 1 << 24


def _filter(met: DataFrame) -> np.ndarray:
    """A bitmap of signatures, of FILTER bits whatever their number."""
    place = F.pmod(F.col("sig"), F.lit(FILTER))
    rows = met.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(sig, {FILTER}) & 63 AS INT))")).alias("b")).toPandas()
    words = np.zeros(FILTER // 64, np.int64)
    words[rows.w.to_numpy(np.int64)] = rows.b.to_numpy(np.int64)
    return words.view(np.uint64)


def _sets_of(docs: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """(sig, tokens) of the classes in ``met``: texts are read again where they lie, and only sets that the filter passes are sent."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in _words.slices(batches):
            h, _, n, sig = _sets(b.column("text"), words)
            at = sig % FILTER
            hit = (bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            edge = np.concatenate([[0], np.cumsum(n)])
            keep = []
            for i in np.flatnonzero(hit):
                if int(sig[i]) not in done:
                    done.add(int(sig[i]))
                    keep.append(int(i))
            yield pa.record_batch({"sig": pa.array(sig[keep]), "tokens": pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in keep], pa.binary())})

    return docs.select("text").mapInArrow(run, "sig long, tokens binary").join(met.hint("merge"), "sig", "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens"))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


_GROUP = ["family", "loose", "bucket", "block"]


def _open(asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between queries and the groups that they meet."""

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        a, b = [], []
        if have.num_rows and ask.num_rows:
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in have.column("tokens")]
            ids = have.column("sig").to_pylist()
            one = not have.column("loose")[0].as_py()
            union, least = np.unique(np.concatenate(sets)), min(map(len, sets))
            for q, x in zip(ask.column("q").to_pylist(), ask.column("q_tokens"), strict=True):
                x = np.frombuffer(x.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(union, x), len(union) - 1)
                if int((union[at] == x).sum()) < _alpha(len(x), max(least, -(-percent * len(x) // 100)), percent):
                    continue
                for i, y in zip(ids, sets, strict=True):
                    if i != q and len(y) <= len(x) and _linked(x, y, percent):
                        a.append(q)
                        b.append(i)
                        # what is asked for is which documents are connected: one link with a component is enough
                        if one:
                            break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy(*_GROUP, "turn").cogroup(asked.groupBy(*(f"q_{g}" for g in _GROUP), "q_turn")).applyInArrow(run, "a long, b long")


def _leaders(lists: DataFrame) -> DataFrame:
    """(sig, n, anchor, hits): the leader of most of each class's tokens, without one a token of its own, and of how many."""
    each = lists.groupBy("sig", "n", "leader").agg(F.count("*").alias("hits"), F.min("token").alias("token"))
    order = F.struct(F.col("leader").isNotNull(), "hits", "leader")
    best = each.groupBy("sig", "n").agg(F.max_by(F.struct(F.coalesce("leader", "token").alias("anchor"), F.when(F.col("leader").isNotNull(), F.col("hits")).otherwise(0).alias("hits")), order).alias("best"))
    return best.select("sig", "n", "best.anchor", "best.hits")


def _groups(near: DataFrame, links: DataFrame) -> DataFrame:
    """sig, component, and the group that each class is put into."""
    parts = _store.table(_links.components(links), "stars_parts")
    named = near.join(parts.toDF("sig", "component"), "sig", "left").join(parts.toDF("anchor", "anchored"), "anchor", "left")
    named = named.select("sig", F.coalesce("component", "sig").alias("component"), F.coalesce("component", "anchored", "anchor").alias("family"), F.col("component").isNull().alias("loose"), F.floor(F.log(F.col("n")) / float(np.log(LIKE))).alias("bucket"))
    named = _store.table(named, "families")
    extent = named.groupBy(*_GROUP[:3]).agg(F.count("*").alias("members"))
    return named.join(extent, _GROUP[:3]).withColumn("block", F.pmod(F.xxhash64("sig"), F.ceil(F.col("members") / BLOCK))).select("sig", "component", *_GROUP)


def _met(lists: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """(q, group): what the token-group matrix cannot exclude."""
    rows = lists.select("token", "sig", "n", "place").join(group.hint("merge"), "sig")
    mixed = rows.groupBy("token").agg((F.min("component") != F.max("component")).alias("mixed")).filter("mixed").select("token")
    rows = _store.table(rows.join(mixed.hint("merge"), "token", "left_semi"), "mixed")
    n, place = F.col("n"), F.col("place")
    index = rows.filter(place < n - _sql_alpha(n, n, percent) + _sql_common(n, percent))
    matrix = index.groupBy("token", *_GROUP).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(n - place).alias("rest"), F.min("sig").alias("one"), F.max("sig").alias("two"))
    matrix = matrix.select(F.col("token").alias("t"), *(F.col(g).alias(f"q_{g}") for g in _GROUP), "low", "high", "rest", "one", "two")
    # no partner is smaller than this
    least = F.greatest("low", F.floor((n * percent + 99) / 100).cast("long"))
    alpha, k = _sql_alpha(n, least, percent), _sql_common(n, percent)
    other = F.col("q_loose") | (F.col("q_family") != F.col("component"))
    held = ~((F.col("one") == F.col("sig")) & (F.col("two") == F.col("sig")))
    fits = (F.col("low") <= n) & (F.col("high") * 100 >= n * percent) & (n - place + k - 1 >= alpha) & (F.col("rest") + k - 1 >= alpha)
    hits = rows.join(matrix.hint("merge"), (F.col("token") == F.col("t")) & other & held & fits)
    hits = hits.groupBy(F.col("sig").alias("q"), *(f"q_{g}" for g in _GROUP)).agg(F.count("*").alias("hits"), F.max((n - place >= alpha) & (F.col("rest") >= alpha)).alias("early"), F.min(_sql_common(least, percent)).alias("k"))
    return hits.filter("early AND hits >= k").select("q", *(f"q_{g}" for g in _GROUP))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, mask = max(4, -(-size // RANGE)), _mask(size)
    sketch = _store.table(sketches(docs, words), "sketches")
    every = _store.table(_lists(docs, words, percent, ranges, mask, *_frequent(docs, words, ranges, mask)), "lists")
    lists = _store.table(_partnered(every, sketch, percent), "partnered")
    _store.drop(every)
    near = _store.table(_leaders(lists), "leaders")
    sets = _store.table(_sets_of(docs, near.select("sig"), words), "sets")
    smallest = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    stars = near.filter((F.col("sig") != F.col("anchor")) & (F.col("hits") >= _sql_common(smallest, percent)))
    links = _store.table(_verify(stars.select(F.col("sig").alias("a"), F.col("anchor").alias("b")), sets, percent), "stars")

    group = _store.table(_groups(near, links), "groups")
    asked = _store.table(_met(lists, group, percent), "asked")
    key = [f"q_{g}" for g in _GROUP]
    turns = asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    asked = asked.join(turns, key).withColumn("q_turn", F.pmod(F.xxhash64("q"), F.col("turns"))).join(sets.toDF("q", "q_tokens").hint("merge"), "q").select("q", *key, "q_turn", "q_tokens")
    members = group.join(turns.toDF(*_GROUP, "turns"), _GROUP).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).join(sets.hint("merge"), "sig").select(*_GROUP, "turn", "sig", "tokens")
    links = _store.table(links.unionByName(_open(asked, members, percent)), "all_links")
    for done in (lists, sets, group):
        _store.drop(done)

    parts = _store.table(_links.components(links), "parts")
    named = sketch.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(parts, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("component", "sig").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("sig").alias("s"), "component_id")
    return sketch.join(named, F.col("sig") == F.col("s"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents connected by four-word shingles at a Jaccard similarity of 0.85 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
