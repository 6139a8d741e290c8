"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays that
workers map into memory, used for log-probabilities and perplexity.

The order is a parameter, three or two. Of the highest order, n-grams seen at most ``prune`` times are
counted but not stored: their probability goes to the shorter context. With ``prune`` 0 all are kept.

Counting. Tasks count the distinct keys of their own texts and send them in blocks, one for each
range of the key space, so that a shuffle row is a compressed array and not a key; what a task holds is
bounded. Keys are mixed bijectively, so ranges are even whatever the words. First come words (the
vocabulary: sorted hashes, counts), then n-grams, keyed by the numbers of their last two words and, for
order three, the number of the word before. A range of pairs therefore knows how often each pair
occurs, how many distinct words stand before it, and its triples. From it come partial sums by first and by
second word, and what is stored of triples and their contexts, combined by ranges of their own: no task
holds all followers of a frequent word.

Model files, one for each range: ``words`` (counts), ``pairs`` (counts, and for order three ``before``, the
distinct words before the pair), ``second`` (the distinct words before a word), ``first`` (of a word as
context: ``total``, and its followers by count one, two, more), ``triples`` (counts) and ``contexts``
(of a pair as context, over its stored triples: ``total``, and how many have count one, two, more), each with
ascending ``keys``. They lie in the shared folder and are read through the page cache. Lookups go in
key order, so that they run through the files once per slice of text.

Probability. With discounts D1, D2, D3+ of each order from its counts of counts, c the counts of the
highest order and numbers of distinct words before of the lower ones:
p(w|uv) = max(c(uvw) - D(c), 0) / c(uv) + backoff(uv) p(w|v), backoff the mass that the stored leave;
p(w|v) = max(c(vw) - D(c), 0) / c(v) + backoff(v) p(w);
p(w) = max(b(w) - D'(b(w)), 0) / B + backoff' / (V + 1), b(w) the distinct words before w, B their sum.

Defined cases: a null text is empty and has its end token only; repeated rows are counted and scored
each; an empty table gives no rows; a corpus without training rows leaves p = 1 / (V + 1) with V = 0;
a vocabulary of 2**32 - 1 words or more is an error; a very long text is held whole by one task, at
about 150 bytes a word. Words are told apart by 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.llm import _blocks, _store, _words
from grafloom.llm.toxicity import held_out

#: Order of the model, and up to which count its longest n-grams are not stored.
ORDER, PRUNE = 3, 1
#: The key of the end token.
END = np.uint64(0xE5D)
#: Bytes of text that a range of the key space stands for; keys that a task holds; files that a worker maps.
RANGE, HELD, MAPS = 16 << 20, 2 << 20, 8192
_U = np.uint64
#: The number that stands before a text's first word.
_BEGIN = _U(0xFFFFFFFF)


def _sum(keys: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys (of one or two columns, the first ascending), and each value summed."""
    if not len(keys[0]):
        return [*keys, *values]
    # two columns are told apart by their hash: sorting by one column is several times faster
    one = keys[0] if len(keys) == 1 else _triple(keys[1].astype(np.uint64), keys[0])
    order = np.argsort(one)
    one = one[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    out = [*(k[order[first]] for k in keys), *(np.add.reduceat(v[order], first) for v in values)]
    if len(keys) > 1:
        order = np.argsort(out[0])
        out = [x[order] for x in out]
    return out


class _Sums:
    """Keys with summed values; merges what it is given whenever that has doubled."""

    def __init__(self, keys: int, values: int) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.keys, self.values, self.held, self.size = keys, values, 0, 0

    def add(self, *cols: np.ndarray) -> None:
        self.parts.append(list(cols))
        self.size += len(cols[0])
        if self.size > max(1 << 20, 2 * self.held):
            self.done()

    def done(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.uint64)] * self.keys + [np.zeros(0, np.int64)] * self.values
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        merged = _sum(cols[: self.keys], cols[self.keys :])
        self.parts, self.held, self.size = [merged], len(merged[0]), len(merged[0])
        return merged


def _sent(kind: str, parts: Iterator[list[np.ndarray]], keys: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of summed keys and counts, at most about HELD keys at a time."""
    sums = _Sums(keys, 1)
    for cols in parts:
        sums.add(*cols)
        if sums.size > HELD and len(sums.done()[0]) > HELD // 2:
            yield _blocks.batch(list(_blocks.by_range(kind, _wide(sums.done()), ranges)))
            sums = _Sums(keys, 1)
    yield _blocks.batch(list(_blocks.by_range(kind, _wide(sums.done()), ranges)))


def _wide(cols: list[np.ndarray]) -> list[np.ndarray]:
    return [c if c.dtype == np.uint32 else c.astype("<u8") for c in cols]


def _merged(batches: Iterator[pa.RecordBatch], keys: dict[str, int]) -> Iterator[tuple[str, int, list[np.ndarray]]]:
    """The sums of each (kind, part) of a shuffled partition; ``keys``: columns of the key by kind, if not one."""
    for kind, part, blocks in _blocks.groups(batches):
        sums = None
        for cols in blocks:
            k = keys.get(kind, 1)
            sums = sums or _Sums(k, len(cols) - k)
            sums.add(*cols[:k], *(c.astype(np.int64) for c in cols[k:]))
        yield kind, part, sums.done()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of every text, lower-cased in A-Z, END after each; where each text starts."""
    raw, offs = _words.buffers(texts)
    raw = _words.lower(raw)
    start, end, row = _words.words(raw, offs)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)) + 1)])
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(row)) + row] = _words.hashes(raw, start, end)
    return out, first


class Files:
    """A model's folder; a file holds ascending keys and columns of counts as narrow as they allow, and is mapped when first used."""

    def __init__(self, path: str, ranges: int) -> None:
        self.path, self.ranges = path, ranges
        self.maps: dict[tuple[str, int], dict[str, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {"path": self.path, "ranges": self.ranges, "maps": {}}

    def put(self, name: str, part: int, keys: np.ndarray, **cols: np.ndarray) -> None:
        cols = {k: c.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(c) or int(c.max()) < 2 ** (8 * int(t[2])))) for k, c in cols.items()}
        head = " ".join([str(len(keys)), *(f"{k}:{c.dtype.itemsize}" for k, c in cols.items())]).ljust(127) + "\n"
        _store.put(f"{self.path}/{name}-{part:06d}.bin", head.encode() + b"".join([keys.astype("<u8").tobytes(), *(c.tobytes() for c in cols.values())]))

    def get(self, name: str, part: int) -> dict[str, np.ndarray]:
        if (name, part) not in self.maps:
            if len(self.maps) > MAPS:
                self.maps.clear()
            path, cols = f"{self.path}/{name}-{part:06d}.bin", {}
            if os.path.exists(path):
                whole = np.memmap(path, np.uint8, "r")
                n, *parts = bytes(whole[:127]).decode().split()
                at = 128
                for k, size in [("keys", 8), *((p.split(":")[0], int(p.split(":")[1])) for p in parts)]:
                    cols[k] = whole[at : at + int(n) * size].view(f"<u{size}")
                    at += int(n) * size
            self.maps[name, part] = cols
        return self.maps[name, part]

    def find(self, name: str, keys: np.ndarray, cols: tuple[str, ...]) -> list[np.ndarray]:
        """Each column's value at each of the ascending keys, 0 where it is absent; last, each key's place in its range, -1 if absent."""
        out = [np.zeros(len(keys), np.int64) for _ in cols] + [np.full(len(keys), -1, np.int64)]
        part = _range_of(keys, self.ranges)
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            file = self.get(name, int(part[lo]))
            if not len(file.get("keys", ())):
                continue
            have = file["keys"]
            at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
            hit = have[at] == keys[lo:hi]
            for o, c in zip(out, cols, strict=False):
                o[lo:hi][hit] = file[c][at[hit]]
            out[-1][lo:hi][hit] = at[hit]
        return out

    def words(self, keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's numbers of ascending keys, from 1, 0 for unknown words; and their counts."""
        count, at = self.find("words", keys, ("counts",))
        return np.where(at >= 0, base[_range_of(keys, self.ranges)] + at + 1, 0).astype(np.uint64), count


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.minimum(keys // _U(2**64 // ranges), _U(ranges - 1)).astype(np.int64)


@dataclass
class Model:
    files: Files
    order: int
    prune: int
    #: Number of the first word of each range, distinct words, all tokens, texts.
    base: np.ndarray
    vocabulary: int
    total: int
    texts: int
    #: Discounts of the highest order, of pairs and of words; B and the mass that words leave to unknown ones.
    triple_discount: np.ndarray
    pair_discount: np.ndarray
    word_discount: np.ndarray
    before: int
    left: float


def _numbered(files: Files, base: np.ndarray, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of the distinct words, the beginning last; and each token's place there, that of the one before it and of the one before that."""
    uniq, word = np.unique(keys, return_inverse=True)
    number, count = files.words(uniq, base)
    begin = len(uniq)
    one = np.concatenate([[begin], word[:-1]])
    one[first[:-1]] = begin
    two = np.concatenate([[begin], one[:-1]])
    two[first[:-1]] = begin
    return np.append(number, _BEGIN), count, word, one, two


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _words.mix((v << _U(32)) | w)


def _triple(u: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """A triple's hash, from its first word and the key of its last two."""
    return _words.mix(pair + _words.mix(u + _U(1)))


def _kinds(c: np.ndarray) -> list[np.ndarray]:
    return [(c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]


def fit(docs: DataFrame, train: "F.Column", order: int = ORDER, prune: int = PRUNE) -> Model:
    """Count and store a model of the texts of the rows where ``train`` holds."""
    if order not in (2, 3):
        raise ValueError("the order is two or three")
    spark = docs.sparkSession
    rows = docs.filter(train).select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-size // RANGE))
    files = Files(_store.model_dir(spark, "lm"), ranges)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (np.unique(tokens(b.column("text"))[0], return_counts=True) for b in _words.slices(batches))
        yield from _sent("words", own, 1, ranges)

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, (keys, n) in _merged(batches, {}):
            files.put("words", part, keys, counts=n)
            yield pa.record_batch({"part": pa.array([part]), "distinct": pa.array([len(keys)]), "total": pa.array([int(n.sum())])})

    base, total = np.zeros(ranges, np.int64), 0
    for r in _blocks.shuffled(rows.mapInArrow(count_words, _blocks.SCHEMA), ranges).mapInArrow(merge_words, "part long, distinct long, total long").collect():
        base[r.part], total = r.distinct, total + r.total
    vocabulary = int(base.sum())
    if vocabulary >= 2**32 - 1:
        raise ValueError("over 2**32 - 2 distinct words")
    base = np.cumsum(base) - base

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[list[np.ndarray]]:
            for b in _words.slices(batches):
                number, _, word, one, two = _numbered(files, base, *tokens(b.column("text")))
                key = [_pair(number[one], number[word])] + ([number[two].astype(np.uint32)] if order == 3 else [])
                yield _sum(key, [np.ones(len(word), np.int64)])

        yield from _sent("grams", own(), order - 1, ranges)

    def merge_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, seen, texts = _Sums(1, 4), _Sums(1, 1), np.zeros((2, 5), np.int64), 0
        triples, contexts = _Sums(1, 1), _Sums(1, 4)
        for _, part, (keys, *prev, c) in _merged(batches, {"grams": order - 1}):
            pairs = keys
            if order == 3:
                u = prev[0].astype(np.uint64)
                seen[1] += np.bincount(np.minimum(c, 5), minlength=6)[1:]
                keep = c > prune
                v = _words.unmix(keys[keep]) >> _U(32)
                triples.add(_triple(u[keep], keys[keep]), c[keep])
                contexts.add(*_sum([_pair(u[keep], v)], [c[keep], *_kinds(c[keep])]))
                begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                pairs, count, before = keys[begins], np.add.reduceat(c, begins), np.diff(np.append(begins, len(keys)))
                files.put("pairs", part, pairs, counts=count, before=before)
            else:
                count = before = c
                files.put("pairs", part, pairs, counts=c)
            pair = _words.unmix(pairs)
            texts += int(count[pair >> _U(32) == _BEGIN].sum())
            seen[0] += np.bincount(np.minimum(before, 5), minlength=6)[1:]
            firsts.add(*_sum([_words.mix(pair >> _U(32))], [before, *_kinds(before)]))
            seconds.add(*_sum([_words.mix(pair & _BEGIN)], [np.ones(len(pair), np.int64)]))
        out = []
        for kind, sums in (("first", firsts), ("second", seconds), ("triples", triples), ("contexts", contexts)):
            out += _blocks.by_range(kind, _wide(sums.done()), ranges)
        yield _blocks.batch([*out, ("seen", 0, np.concatenate([seen.ravel(), [texts]]).astype("<i8").tobytes())])

    sums = _store.table(_blocks.shuffled(rows.mapInArrow(count_grams, _blocks.SCHEMA), ranges).mapInArrow(merge_grams, _blocks.SCHEMA), "sums")
    names = {"second": ("counts",), "first": ("total", "n1", "n2", "n3"), "triples": ("counts",), "contexts": ("total", "n1", "n2", "n3")}

    def merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(5, np.int64)
        for name, part, (keys, *v) in _merged(batches, {}):
            files.put(name, part, keys, **dict(zip(names[name], v, strict=True)))
            if name == "second":
                seen += np.bincount(np.minimum(v[0], 5), minlength=6)[1:]
        yield _blocks.batch([("seen", 1, seen.astype("<i8").tobytes())])

    # counts of counts, a few numbers from each task, reach the driver
    grams, words = np.zeros(11, np.int64), np.zeros(5, np.int64)
    for r in sums.filter("kind = 'seen'").collect():
        grams += np.frombuffer(r.block, "<i8")
    for r in _blocks.shuffled(sums.filter("kind <> 'seen'"), ranges).mapInArrow(merge_sums, _blocks.SCHEMA).collect():
        words += np.frombuffer(r.block, "<i8")
    _store.drop(sums)
    discount = _discounts(words)
    left = float(discount @ [words[0], words[1], words[2:].sum()])
    return Model(files, order, prune, base, vocabulary, total, int(grams[10]), _discounts(grams[5:10]), _discounts(grams[:5]), discount, int(grams[:5].sum()), left)


def _discounts(seen: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from how many events were seen once to four times (Chen and Goodman), within what is possible."""
    n1, n2, n3, n4 = (float(x) for x in seen[:4])
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.clip(d, [0.05, 0.05, 0.05], [0.99, 1.99, 2.99])


def _less(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(c - np.r_[0.0, d][np.minimum(c, 3)], 0.0)


def _lookup(files: Files, name: str, keys: np.ndarray, *cols: str) -> list[np.ndarray]:
    """Columns at keys in any order."""
    order = np.argsort(keys)
    found = files.find(name, keys[order], cols)[: len(cols)]
    out = [np.empty_like(x) for x in found]
    for o, x in zip(out, found, strict=True):
        o[order] = x
    return out


def score_texts(texts: pa.Array, m: Model) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    keys, first = tokens(texts)
    number, c, word, one, two = _numbered(m.files, m.base, keys, first)
    # what follows from one word is looked up once for each distinct one
    c = c[word]
    total, n1, n2, n3 = (x[one] for x in _lookup(m.files, "first", _words.mix(number), "total", "n1", "n2", "n3"))
    b = _lookup(m.files, "second", _words.mix(number[:-1]), "counts")[0][word]
    word, one, two = number[word], number[one], number[two]
    pair = _pair(one, word)
    count, before = _lookup(m.files, "pairs", pair, "counts", "before") if m.order == 3 else 2 * _lookup(m.files, "pairs", pair, "counts")
    d = m.pair_discount
    low = (_less(b, m.word_discount) + m.left / (m.vocabulary + 1)) / m.before if m.before else np.full(len(b), 1 / (m.vocabulary + 1))
    p = np.where(total > 0, (_less(before, d) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * low) / np.maximum(total, 1), low)
    if m.order == 3:
        # a context's count is that of the pair before; what was stored has a count over prune, and so has its context
        context = np.concatenate([[0], count[:-1]])
        context[first[:-1]] = m.texts
        may = np.flatnonzero(context > m.prune)
        whole, *kinds = _lookup(m.files, "contexts", _pair(two[may], one[may]), "total", "n1", "n2", "n3")
        d = m.triple_discount
        kept = np.zeros(len(p))
        both = count[may] > m.prune
        kept[may[both]] = _less(_lookup(m.files, "triples", _triple(two[may[both]], pair[may[both]]), "counts")[0], d)
        rest = np.ones(len(p))
        rest[may] = 1 - (whole - d[0] * kinds[0] - d[1] * kinds[1] - d[2] * kinds[2]) / context[may]
        p = kept / np.maximum(context, 1) + rest * p
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    add = lambda x: np.bincount(row, x, minlength=len(texts))
    base = np.log10((c + 1) / (m.total + m.vocabulary + 1))
    return {"n_tokens": np.diff(first), "n_known": add(c > 0).astype(np.int64), "base_score": add(base), "score": add(np.log10(p))}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each text's tokens, known tokens, add-one score and model score (log10 of its probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _words.slices(batches):
            yield pa.record_batch({"doc_id": b.column("doc_id"), **{k: pa.array(v) for k, v in score_texts(b.column("text"), model).items()}})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out("doc_id", 7, 2)
    model = fit(docs, ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
