"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon (whole-word) features, hashed into one weight
table; the chain has learned transitions, so a word of a code-switched text is labelled in its
context. Forward-backward gives each word's marginals; a document's language has the largest summed
marginal over its words that hold a letter, and the score is that share.

Training uses runs of words of labelled documents; runs of two languages are joined so that
transitions between languages occur. The chain of a document is cut into blocks whose transfer
matrices are combined exactly, so that long texts are handled whole and without a step per word.

Every language that the training rows name is learned; with many of them features share the weight
table's rows, whose number of weights is bounded.

Defined cases: null texts and texts without a letter are ``und`` with score 0; of languages with equal
sums the first by name is taken; repeated rows each get a row; an empty table gives no rows; without
training rows everything is ``und``; a very long text is one chain, held by one task at about 150 bytes
a byte of text and language. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grafloom.llm import _words
from grafloom.llm.toxicity import held_out

#: Rows of the weight table for up to 64 languages (fewer for more); words of a training run; words of a block.
BUCKETS, RUN, BLOCK = 1 << 17, 24, 48
#: Most training documents of each language, and of all (one of each language at least).
SAMPLE, SAMPLE_ALL = 400, 16_000
#: Bytes of text that are labelled at once.
SLICE = 1 << 19
_SEED = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    languages: list[str]
    emit: np.ndarray
    step: np.ndarray


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes that are, or may belong to, letters; of those that start with 0xC2 three signs are (U+00AA, U+00B5, U+00BA)."""
    sign = np.zeros(len(raw), bool)
    sign[:-1] = (raw[:-1] == 0xC2) & ((raw[1:] == 0xAA) | (raw[1:] == 0xB5) | (raw[1:] == 0xBA))
    return ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90)) | (raw >= 0xC3) | sign


def _features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words (as rows of the weight table) and where each word's begin."""
    size = end - start
    total = int(size.sum())
    owner = np.repeat(np.arange(len(start)), size)
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    byte = raw[np.repeat(start, size) + at].astype(np.uint64)
    left = np.repeat(size, size) - at
    parts, owners = [_words.hashes(raw, start, end) * _SEED[0]], [np.arange(len(start))]
    gram = np.zeros(total, np.uint64)
    for n in range(1, 5):
        if total < n:
            break
        gram = gram[: total - n + 1] * np.uint64(257) + byte[n - 1 :] + np.uint64(1)
        inside = left[: total - n + 1] >= n
        head, tail = inside & (at[: total - n + 1] == 0), inside & (left[: total - n + 1] == n)
        for keep, seed in ((inside if n in (2, 3) else None, _SEED[n]), (head, _SEED[4 + n]), (tail, _SEED[8 + n - 1])):
            if keep is not None:
                parts.append(gram[keep] * seed)
                owners.append(owner[: total - n + 1][keep])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    f = (_words.mix(np.concatenate(parts)[order]) % np.uint64(buckets)).astype(np.int64)
    return f, np.searchsorted(own[order], np.arange(len(start)), "left")


def _emissions(raw: np.ndarray, start: np.ndarray, end: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """A score per word and language; equal words of the slice are computed once."""
    _, where, back = np.unique(_words.hashes(raw, start, end), return_index=True, return_inverse=True)
    f, first = _features(raw, start[where], end[where], len(emit))
    count = np.diff(np.append(first, len(f)))
    return (np.add.reduceat(emit[f], first, axis=0) / np.sqrt(count)[:, None])[back]


def marginals(e: np.ndarray, row: np.ndarray, rows: int, step: np.ndarray) -> np.ndarray:
    """Forward-backward over the chains of all rows at once; exact, by blocks of BLOCK words."""
    if not len(e):
        return e
    k = e.shape[1]
    psi = np.exp(e - e.max(1, keepdims=True))
    t = np.exp(step - step.max())
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    blocks = -(-count // BLOCK)
    owner = np.repeat(np.arange(rows), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[owner] + nth * BLOCK
    size = np.minimum(BLOCK, first[owner] + count[owner] - begin)
    # padding with ones and an identity step leaves the products as they are
    grid = begin[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    em = np.where(real[..., None], psi[np.minimum(grid, len(psi) - 1)], 1.0)
    eye = np.eye(k)

    def transfer(j: int, carry: np.ndarray) -> np.ndarray:
        new = (carry @ t) * em[:, j, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        return np.where(real[:, j, None, None], new, carry)

    whole = np.broadcast_to(eye, (len(owner), k, k))
    for j in range(BLOCK):
        whole = transfer(j, whole)
    # vectors that enter each block from the left and from the right
    into, back = np.full((len(owner), k), 1.0 / k), np.ones((len(owner), k))
    for j in range(1, int(blocks.max())):
        b = np.flatnonzero(nth == j)
        v = np.einsum("bi,bij->bj", into[b - 1], whole[b - 1])
        into[b] = v / v.sum(1, keepdims=True)
    last = blocks[owner] - 1 - nth
    for j in range(1, int(blocks.max())):
        b = np.flatnonzero(last == j)
        v = np.einsum("bij,bj->bi", whole[b + 1], back[b + 1])
        back[b] = v / v.max(1, keepdims=True)
    alpha = np.empty((len(owner), BLOCK, k))
    a = into
    for j in range(BLOCK):
        new = (a @ t) * em[:, j]
        new /= new.sum(1, keepdims=True)
        a = np.where(real[:, j, None], new, a)
        alpha[:, j] = a
    out = np.empty_like(psi)
    b = back
    for j in range(BLOCK - 1, -1, -1):
        got = alpha[:, j] * b
        keep = real[:, j]
        out[grid[keep, j]] = (got / got.sum(1, keepdims=True))[keep]
        new = (b * em[:, j]) @ t.T
        new /= new.max(1, keepdims=True)
        b = np.where(keep[:, None], new, b)
    return out


def fit(texts: list[str], labels: list[str], epochs: int = 12, runs: int = 24) -> Model | None:
    """Learn weights and transitions by stochastic gradients of the chain's likelihood (AdaGrad)."""
    if not texts:
        return None
    names, lab = np.unique(np.array(labels, object), return_inverse=True)
    names, buckets = names.tolist(), max(1 << 10, BUCKETS * 64 // max(64, len(names)))
    raw, offs = _words.buffers(pa.array(texts, pa.string()))
    start, end, row = _words.words(raw, offs)
    if not len(start):
        return None
    rng = np.random.default_rng(9)
    first, count = np.searchsorted(row, np.arange(len(lab)), "left"), np.bincount(row, minlength=len(lab))
    halves = []
    for r in np.flatnonzero(count):
        for _ in range(min(runs, -(-int(count[r]) // (RUN // 2)))):
            s = first[r] + rng.integers(0, max(1, count[r] - RUN // 2 + 1))
            halves.append((np.arange(s, s + RUN // 2).clip(max=first[r] + count[r] - 1), lab[r]))
    rng.shuffle(halves)
    # a run is two halves: of one document's language three times in four, else of any two
    by = {y: [h for h in halves if h[1] == y] for y in range(len(names))}
    seqs = []
    for w, y in halves:
        other = by[y][rng.integers(len(by[y]))] if rng.random() < 0.75 else halves[rng.integers(len(halves))]
        seqs.append((np.concatenate([w, other[0]]), np.repeat([y, other[1]], RUN // 2)))
    word = np.stack([s for s, _ in seqs])
    gold = np.stack([g for _, g in seqs])
    used, ids = np.unique(word, return_inverse=True)
    ids = ids.reshape(word.shape)
    _, where, back = np.unique(_words.hashes(raw, start[used], end[used]), return_index=True, return_inverse=True)
    # a few words at a time: training runs beside the driver's own memory
    parts = [_features(raw, start[used][where[i : i + 8192]], end[used][where[i : i + 8192]], buckets) for i in range(0, len(where), 8192)]
    f = np.concatenate([p.astype(np.int32) for p, _ in parts])
    n = np.concatenate([np.diff(np.append(b, len(p))) for p, b in parts])
    begin = np.cumsum(n) - n
    del parts
    ids = back[ids]
    k = len(names)
    emit, step = np.zeros((buckets, k)), np.zeros((k, k))
    ge, gs = np.full((buckets, k), 1e-2), np.full((k, k), 1.0)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // 256)):
            u, inv = np.unique(ids[part], return_inverse=True)
            inv = inv.reshape(ids[part].shape)
            fu = np.concatenate([f[begin[i] : begin[i] + n[i]] for i in u])
            cut = np.cumsum(n[u]) - n[u]
            eu = np.add.reduceat(emit[fu], cut, axis=0) / np.sqrt(n[u])[:, None]
            flat, rows = inv.reshape(-1), np.repeat(np.arange(len(part)), RUN // 2 * 2)
            g = gold[part]
            m, pair = _expect(eu[flat].reshape(len(part), -1, k), step)
            d = np.eye(k)[g] - m
            grad = np.zeros_like(eu)
            np.add.at(grad, flat, d.reshape(-1, k))
            grad = np.repeat(grad / np.sqrt(n[u])[:, None], n[u], axis=0)
            fs, fi = np.unique(fu, return_inverse=True)
            full = np.stack([np.bincount(fi, grad[:, c], minlength=len(fs)) for c in range(k)], 1) / len(part) - 1e-5 * emit[fs]
            ge[fs] += full**2
            emit[fs] += 0.3 * full / np.sqrt(ge[fs])
            real = np.zeros((k, k))
            np.add.at(real, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
            sg = (real - pair) / len(part)
            gs += sg**2
            step += 0.3 * sg / np.sqrt(gs)
    return Model(names, emit.astype(np.float32), step)


def _expect(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of sequences of one length, and expected transitions summed over all."""
    psi, t = np.exp(e - e.max(2, keepdims=True)), np.exp(step - step.max())
    n, size, k = psi.shape
    a, b = np.empty_like(psi), np.ones_like(psi)
    v = np.full((n, k), 1.0 / k)
    for j in range(size):
        v = (v @ t) * psi[:, j] if j else v * psi[:, j]
        v /= v.sum(1, keepdims=True)
        a[:, j] = v
    for j in range(size - 2, -1, -1):
        w = (b[:, j + 1] * psi[:, j + 1]) @ t.T
        b[:, j] = w / w.max(1, keepdims=True)
    m = a * b
    m /= m.sum(2, keepdims=True)
    pair = np.zeros((k, k))
    for j in range(size - 1):
        x = a[:, j, :, None] * t * (psi[:, j + 1] * b[:, j + 1])[:, None, :]
        pair += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return m, pair


def label_words(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, row, start and end (bytes) of every word, and which words may hold a letter."""
    raw, offs = _words.buffers(texts)
    start, end, row = _words.words(raw, offs)
    if not len(start):
        return np.zeros((0, len(model.languages))), row, start, end, np.zeros(0, bool)
    seen = np.concatenate([[0], np.cumsum(_letters(raw))])
    m = marginals(_emissions(raw, start, end, model.emit).astype(np.float64), row, len(texts), model.step)
    return m, row, start, end, seen[end] > seen[start]


def predict(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Each text's language and score."""
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    m, row, _, _, letter = label_words(texts, model)
    total = np.stack([np.bincount(row[letter], m[letter, c], minlength=len(texts)) for c in range(m.shape[1])], 1)
    raw, offs = _words.buffers(texts)
    plain = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
    plain = plain[offs[1:]] > plain[offs[:-1]]
    n = total.sum(1)
    out, score = [], np.where(n > 0, total.max(1) / np.maximum(n, 1e-12), 0.0)
    for i, best in enumerate(total.argmax(1)):
        # without an ASCII letter, Python's tables tell whether other characters are letters
        if n[i] > 0 and (plain[i] or any(map(str.isalpha, texts[i].as_py() or ""))):
            out.append(model.languages[best])
        else:
            out.append("und")
            score[i] = 0.0
    return out, score


def predicted(text: Column, model: Model | None, once: bool = False) -> Column:
    """(lang_pred, score) of a text column; no other column travels to the workers. With ``once`` a filter on it doesn't make the plan run it again."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in parts:
            names, scores = [], [np.zeros(0)]
            for b in _words.slices(iter([pa.record_batch({"text": whole})]), most=SLICE):
                n, s = predict(b.column("text"), model)
                names += n
                scores.append(np.clip(s, 0, 1))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], ["lang_pred", "score"])

    return (run.asNondeterministic() if once else run)(text)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score; its own columns stay, save those of the two names."""
    docs = docs.drop("lang_pred", "score")
    return docs.withColumn("lang_pred", predicted(F.col("text"), model)).select(*docs.columns, "lang_pred.lang_pred", "lang_pred.score")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` documents of each language, SAMPLE_ALL in all, chosen by a hash of doc_id, none with remainder 1.

    One scan counts the languages; a second takes about twice the sample of each by a threshold on the
    hash, of which the lowest stay.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(1, min(sample, SAMPLE_ALL // len(counts)))
    share = docs.sparkSession.createDataFrame([(r.lang, (2 * each + 100) / r["count"]) for r in counts], "lang string, share double")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    some = rows.join(F.broadcast(share), "lang").withColumn("h", h).filter(F.col("h") < F.col("share") * float(1 << 32))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    got = some.withColumn("n", first).filter(F.col("n") <= each).select("doc_id", "lang", "text").toPandas().sort_values(["doc_id", "lang", "text"])
    model = fit(list(got.text), list(got.lang))
    _words.release()
    return model


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; lang is read for training rows only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
