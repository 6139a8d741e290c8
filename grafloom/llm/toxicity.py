"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
overlapping windows of a few words; a window's distance is its compressed length under the ordinary
dictionary less that under the toxic one, in bytes. Toxic documents are mostly ordinary prose, and a
dictionary trained on all their windows learns that prose: the toxic samples are therefore the
fragments, a word each, that toxic documents share and ordinary ones hardly use. The ordinary
dictionary has as many bytes trained on ordinary windows in their place, and both end in the same
prose: ordinary text then compresses alike under both. The threshold comes from windows of other
ordinary documents; a logistic curve over a document's window statistics, fitted on training documents
that the dictionaries didn't see, turns distances into a score.

Defined cases: null and empty texts have no windows and get the curve's value there; equal texts get
equal scores, and a score of just 0.5 counts as toxic; repeated rows each get a row; an empty table
gives no rows; without labels of both kinds every score is 0; all windows of a very long text count,
held by one task at about 60 bytes a byte of text. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, functions as F

from grafloom.llm import _words

WINDOW, STRIDE, LEVEL = 8, 4, 6
#: Most documents labelled 1 that training reads; twice as many labelled 0.
SAMPLE = 1000
# Fixed value: a trained dictionary's three repeat offsets, which end its header.
_REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
_EDGE = ".,!?;:*#$%&|\"'()"


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float
    cut: float


def _windows(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of windows of WINDOW words, every STRIDE words; a row's tail is always covered."""
    start, end, row = _words.words(raw, offs)
    if not len(start):
        return start, end, row
    first = np.searchsorted(row, np.arange(len(offs) - 1), "left")
    last = np.searchsorted(row, np.arange(len(offs) - 1), "right")
    place = np.arange(len(row)) - first[row]
    left = last[row] - np.arange(len(row))
    begins = np.flatnonzero((place % STRIDE == 0) & ((left > WINDOW - STRIDE) | (place == 0)))
    stop = np.minimum(begins + WINDOW, last[row[begins]]) - 1
    return start[begins], end[stop], row[begins]


def _lengths(raw: bytes, start: np.ndarray, end: np.ndarray, by: zstd.ZstdCompressor) -> np.ndarray:
    cuts = np.empty((len(start), 2), "<u8")
    cuts[:, 0], cuts[:, 1] = start, end - start
    out = np.zeros(len(start), np.int32)
    for lo in range(0, len(start), 50_000):
        part = cuts[lo : lo + 50_000]
        got = by.multi_compress_to_buffer(zstd.BufferWithSegments(raw, part.tobytes()), threads=1)
        out[lo : lo + len(part)] = [len(got[i]) for i in range(len(got))]
    return out


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """The content of a dictionary trained on ``samples``; where they are too few for the trainer, their distinct text.

    Content only: with a trained entropy table, lengths would differ on text that neither side knows.
    """
    try:
        made = zstd.train_dictionary(size, samples).as_bytes()
        return made[made.index(_REPEATS) + len(_REPEATS) :]
    except (zstd.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def _fresh(texts: list[str]) -> list[str]:
    """The texts without those of which over a third of the five-word runs stand in earlier ones: copies would pass for evidence."""
    seen: set[int] = set()
    out = []
    for t in texts:
        ws = t.split()
        runs = {hash(tuple(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))}
        if 3 * len(runs & seen) <= len(runs):
            out.append(t)
        seen |= runs
    return out


def _samples(texts: list[str], most: int = 30_000) -> list[bytes]:
    """The texts' windows, thinned evenly to about ``most``."""
    raw, offs = _words.buffers(pa.array(texts, pa.string()))
    start, end, _ = _windows(raw, offs)
    raw, every = _words.lower(raw), max(1, len(start) // most)
    return [raw[s:e].tobytes() for s, e in zip(start[::every], end[::every], strict=True)]


def _uses(texts: list[str]) -> Counter[str]:
    """In how many texts each word occurs."""
    n: Counter[str] = Counter()
    for t in texts:
        n.update({w.strip(_EDGE) for w in t.lower().split()})
    return n


def _gains(raw: np.ndarray, start: np.ndarray, end: np.ndarray, toxic: zstd.ZstdCompressor, ordinary: zstd.ZstdCompressor) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window; a window that was seen in the slice is compressed once."""
    h, where, back = np.unique(_words.hashes(raw, start, end), return_index=True, return_inverse=True)
    data = raw.tobytes()
    s, e = start[where], end[where]
    return (_lengths(data, s, e, ordinary) - _lengths(data, s, e, toxic))[back].astype(np.float64)


def _statistics(gain: np.ndarray, row: np.ndarray, rows: int, cut: float) -> np.ndarray:
    """Per row: the largest gain, the windows (log) at each of the thresholds up to the cut, their share at the middle one, and all windows (log)."""
    top = np.zeros(rows)
    np.maximum.at(top, row, gain)
    n = np.bincount(row, minlength=rows)
    hits = [np.bincount(row[gain >= t], minlength=rows) for t in (2, (2 + cut) / 2, cut)]
    return np.stack([top, *(np.log1p(h) for h in hits), np.sqrt(hits[1] / np.maximum(n, 1)), np.log1p(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    return w[:-1], float(w[-1])


def fit(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model | None:
    """Learn from the texts of toxic and of ordinary documents; ``share``: of toxic documents where the model is used, if not as here."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    toxic, ordinary = _fresh(toxic), _fresh(ordinary)
    # odd rows train the dictionaries, even rows set the threshold and the curve
    use, docs = [_uses(x[1::2]) for x in (toxic, ordinary)], [max(1, len(x[1::2])) for x in (toxic, ordinary)]
    # the toxic side is trained on the words that toxic documents share and ordinary ones hardly use
    marked = set()
    for w, n in use[0].items():
        expect = (use[1].get(w, 0) + 0.5) * docs[0] / docs[1]
        if n >= 3 and n - expect >= 4 * np.sqrt(expect + 1):
            marked.add(w)
    seeds = [b" " + w.encode() for t in toxic[1::2] for x in t.lower().split() if (w := x.strip(_EDGE)) in marked]
    del use
    prose = _dictionary(_samples(ordinary[1::2]))
    trained = _dictionary(seeds, 1 << 13) if seeds else b" "
    # the trainer may leave out short words; the toxic side ends in the same prose, so ordinary text costs both the same
    toxic_dict = trained + b"".join(b" " + w.encode() for w in sorted(marked) if w.encode() not in trained) + b" " + prose
    # ordinary windows in the place of the toxic fragments; what is short is filled up with bytes that no UTF-8 text holds
    other = _dictionary(_samples(ordinary[1::2])[::2], 1 << 13)
    filler = np.random.default_rng(3).integers(0xF8, 0x100, len(toxic_dict), dtype=np.uint8).tobytes()
    ordinary_dict = (filler + other)[-(len(toxic_dict) - len(prose)) :] + prose
    toxic_by, ordinary_by = _compressor(toxic_dict), _compressor(ordinary_dict)
    found = []
    for texts in (toxic[::2], ordinary[::2]):
        raw, offs = _words.buffers(pa.array(texts, pa.string()))
        start, end, row = _windows(raw, offs)
        found.append((_gains(_words.lower(raw), start, end, toxic_by, ordinary_by), row, len(texts)))
    cut = max(1.0, float(np.quantile(found[1][0], 0.9995))) + 1 if len(found[1][0]) else 3.0
    x = [_statistics(g, row, n, cut) for g, row, n in found]
    y = [np.full(len(s), 1.0 - k) for k, s in enumerate(x)]
    weights, bias = _logistic(np.concatenate(x), np.concatenate(y))
    if share and 0 < share < 1:
        bias += float(np.log(share / (1 - share)) - np.log(len(x[0]) / max(1, len(x[1]))))
    return Model(toxic_dict, ordinary_dict, weights, bias, cut)


def score_texts(texts: pa.Array, model: Model | None, by: tuple | None = None) -> np.ndarray:
    """A score from 0 to 1 for each text."""
    if model is None:
        return np.zeros(len(texts))
    toxic_by, ordinary_by = by or (_compressor(model.toxic), _compressor(model.ordinary))
    raw, offs = _words.buffers(texts)
    start, end, row = _windows(raw, offs)
    gain = _gains(_words.lower(raw), start, end, toxic_by, ordinary_by) if len(start) else np.zeros(0)
    z = _statistics(gain, row, len(texts), model.cut) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (_compressor(model.toxic), _compressor(model.ordinary)) if model else None
        for b in _words.slices(batches):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(score_texts(b.column("text"), model, by))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def training_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, held_out: int = 0) -> tuple[list[str], list[str]]:
    """At most ``sample`` texts of label 1 and twice as many of label 0, chosen by a hash of doc_id, none of them held out.

    The ids of the sample are bounded, so they may be broadcast; the texts are read in one scan.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != held_out))
    picked = None
    for v, n in ((0, 2 * sample), (1, sample)):
        part = rows.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    got = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "label", "text").toPandas().sort_values(["doc_id", "label", "text"])
    return list(got.text[got.label == 1]), list(got.text[got.label == 0])


def held_out(column: str = "doc_id", modulus: int = 5, rest: int = 0) -> "F.Column":
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == rest, F.lit(False))


def label_share(labels: DataFrame, label: str) -> float | None:
    """The share of label 1 among the labels that may be learned from."""
    rows = labels.filter(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return rows.agg(F.avg(label)).first()[0]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of held-out documents are never read."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(*training_texts(docs, labels, "toxic"), label_share(labels, "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
