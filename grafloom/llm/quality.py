"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: hashed counts of its pairs of byte classes,
of its byte trigrams and of its words, and how varied and how long the words are, all square-rooted and
scaled, pass a learned tanh layer. A learned gated attention weighs the passages from document labels
alone, and a logistic unit scores the weighted passage representation (the gated form of attention
pooling: weights proportional to exp(w . (tanh(V h) * sigmoid(U h)))).

Defined cases: null and empty texts are one empty passage; equal texts get equal scores, and a score of
just 0.3 counts as good; repeated rows each get a row; an empty table gives no rows; without labels of
both kinds every score is 1 (nothing speaks against a text); all passages of a very long text count,
held by one task at about 80 bytes a byte of text. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.llm import _words
from grafloom.llm.toxicity import held_out, training_texts

#: Bytes of a passage; hashed pairs of classes, trigrams and words; width of a passage's encoding; width of the attention.
PASSAGE, PAIRS, TRIGRAMS, WORDS, WIDTH, ATTEND = 1024, 192, 192, 128, 24, 12
FEATURES = PAIRS + TRIGRAMS + WORDS + 3
#: Most documents labelled 0 or 1 that training reads (see training_texts).
SAMPLE = 1500


def _classes() -> np.ndarray:
    """A class per byte: lower and upper letters by two groups each, digits, spaces, and each ASCII sign its own."""
    c = np.zeros(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(signs):
        c[b] = 1 + i
    n = 1 + len(signs)
    c[[9, 10, 11, 12, 13]], c[32] = n, n + 1
    c[48:58], c[65:91], c[97:123] = n + 2, n + 3, n + 4
    c[128:192], c[192:256] = n + 5, n + 6
    return c


_CLASS = _classes()
_SALT = np.uint64(0x2545F4914F6CDD1D)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and each passage's row (ascending; each row has one at least)."""
    raw, offs = _words.buffers(texts)
    size = np.diff(offs)
    count = np.maximum(1, -(-size // PASSAGE))
    row = np.repeat(np.arange(len(size)), count)
    x = np.zeros((len(row), FEATURES), np.float32)
    if len(raw) > 1:
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(size)), size)
        at = first[owner] + (np.arange(len(raw)) - offs[owner]) // PASSAGE
        c, low = _CLASS[raw], _words.lower(raw).astype(np.int64)
        column = 0
        start, end, _ = _words.words(raw, offs)
        h, w = _words.hashes(_words.lower(raw), start, end), at[start]
        for key, where, wide in (
            ((c[:-1] * 64 + c[1:])[at[1:] == at[:-1]], at[1:][at[1:] == at[:-1]], PAIRS),
            ((low[:-2] * 65536 + low[1:-1] * 256 + low[2:])[at[2:] == at[:-2]], at[2:][at[2:] == at[:-2]], TRIGRAMS),
            (h, w, WORDS),
        ):
            col = (_words.mix(key.astype(np.uint64) + _SALT) % np.uint64(wide)).astype(np.int64)
            x[:, column : column + wide] = np.bincount(where * wide + col, minlength=len(row) * wide).reshape(len(row), wide)
            column += wide
        x[:, :column] *= (256 / np.maximum(np.bincount(at, minlength=len(row)), 1))[:, None]
        if len(start):
            order = np.lexsort((h, w))
            h, sorted_w = h[order], w[order]
            new = np.ones(len(h), bool)
            new[1:] = (sorted_w[1:] != sorted_w[:-1]) | (h[1:] != h[:-1])
            words, kinds = np.bincount(w, minlength=len(row)), np.bincount(sorted_w[new], minlength=len(row))
            length = np.bincount(w, end - start, minlength=len(row)) / np.maximum(words, 1)
            x[:, column] = 100 * kinds / np.maximum(words, 1)
            x[:, column + 1] = np.minimum(words, 400)
            x[:, column + 2] = np.minimum(length, 60) ** 2
    return np.sqrt(x), row


def _encoded(texts: list[str], slice_: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`passages`, with the working memory of about ``slice_`` characters (or one text) at a time."""
    parts, open_, size, first = [], [], 0, 0
    for i, t in enumerate(texts):
        open_.append(t)
        size += len(t or "")
        if size >= slice_ or i + 1 == len(texts):
            x, row = passages(pa.array(open_, pa.string()))
            parts.append((x, row + first))
            first, open_, size = i + 1, [], 0
    return np.concatenate([x for x, _ in parts]), np.concatenate([row for _, row in parts])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray


def _pool(p: dict[str, np.ndarray], x: np.ndarray, row: np.ndarray, rows: int) -> tuple:
    h = np.tanh(x @ p["e"][:-1] + p["e"][-1])
    tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
    s = (tv * su) @ p["w"]
    top = np.full(rows, -np.inf, s.dtype)
    np.maximum.at(top, row, s)
    a = np.exp(s - top[row])
    a /= np.bincount(row, a, minlength=rows)[row]
    z = np.stack([np.bincount(row, a * h[:, j], minlength=rows) for j in range(h.shape[1])], 1)
    logit = z @ p["c"][:-1] + p["c"][-1]
    return h, tv, su, a, z, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradient(p: dict[str, np.ndarray], x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The documents' weighted cross-entropy and its gradient by every parameter."""
    h, tv, su, a, z, out = _pool(p, x, row, len(y))
    d = weight * (out - y)
    dz = d[:, None] * p["c"][:-1]
    dh = a[:, None] * dz[row]
    ds = a * ((h * dz[row]).sum(1) - (z * dz).sum(1)[row])
    dt, du = ds[:, None] * p["w"] * su * (1 - tv**2), ds[:, None] * p["w"] * tv * su * (1 - su)
    dh += dt @ p["v"].T + du @ p["u"].T
    de = dh * (1 - h**2)
    loss = -float((weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum())
    return loss, {"e": np.r_[x.T @ de, de.sum(0)[None]], "v": h.T @ dt, "u": h.T @ du, "w": (tv * su).T @ ds, "c": np.r_[z.T @ d, d.sum()]}


def parameters(features: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random ones to start from."""
    shape = {"e": (features + 1, WIDTH), "v": (WIDTH, ATTEND), "u": (WIDTH, ATTEND), "w": (ATTEND,), "c": (WIDTH + 1,)}
    scale = {"e": features**-0.5, "v": WIDTH**-0.5, "u": WIDTH**-0.5, "w": 0.1, "c": 0.1}
    return {k: rng.normal(0, scale[k], shape[k]) for k in shape}


def fit(high: list[str], low: list[str], epochs: int = 200) -> Model | None:
    """Learn from texts labelled 1 and 0 (Adam); both labels weigh the same."""
    if not high or not low:
        return None
    x, row = _encoded(high + low)
    y = np.repeat([1.0, 0.0], [len(high), len(low)])
    mean, scale = x.mean(0), x.std(0) + 0.05
    x -= mean
    x /= scale
    x = x.astype(np.float64)
    p = parameters(FEATURES, np.random.default_rng(5))
    m, q = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = np.where(y > 0, 0.5 / len(high), 0.5 / len(low))
    for t in range(1, epochs + 1):
        _, g = gradient(p, x, row, y, weight)
        for k in p:
            g[k] += 1e-4 * p[k]
            m[k], q[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * q[k] + 0.01 * g[k] ** 2
            p[k] -= 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.99**t)) + 1e-8)
    return Model(mean, scale, p["e"], p["v"], p["u"], p["w"], p["c"])


def score_texts(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    x, row = passages(texts)
    p = {k: getattr(model, k) for k in ("e", "v", "u", "w", "c")}
    return _pool(p, (x - model.mean) / model.scale, row, len(texts))[-1].astype(np.float64)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _words.slices(batches):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(score_texts(b.column("text"), model))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of held-out documents are never read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*training_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", SAMPLE // 2))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
