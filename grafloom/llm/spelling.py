"""Spelling variants: words within one edit of each other, found by a symmetric-delete join.

Words are counted over all texts. Each word of the vocabulary emits itself and its distinct single
deletions, as 64-bit hashes formed from running sums, so that a word of L letters costs L numbers, not
L strings. An equi-join brings the words that share a key together; two words share at most one key if
they are one edit apart. Where the deletions lie tells most other pairs apart inside the join, and the
words themselves, less those letters, are then compared: only a distance of exactly one counts. A key's words all come from
one string by one letter more, so their number is bounded by its length times the alphabet, however
large or skewed the corpus. A word's form is its near word of largest count, and roots follow forms by
repeated joins that double the way each time; counts at least double along it, so the way is short.

Defined cases: null texts hold no words; a null doc_id is written as nothing; repeated rows count again;
empty tables give empty results; other columns are not read, whatever their names; ties go to the
smallest word in code-point order; a very long text is held by one task, some ten bytes a byte, and a
very long run of letters is one word. Keys' 64-bit hashes are taken as exact for one thing only: that a
pair of words doesn't share two of them, which would count it twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grafloom.llm import _store, _words

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent.
RATIO = 2
_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def misspelt(doc: Column, run: Column, every: int = 97) -> Column:
    """A run with one code point left out where ``every`` divides the CRC-32 of ``<doc>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every run of letters of ``docs`` (doc_id, text), A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n): words long and frequent enough, numbered; on shared files."""
    n = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    return _store.table(n.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, letter left out and first and last place where leaving it out gives the key (-1: the word itself)."""
    out: list[tuple[np.ndarray, ...]] = []
    length = np.array([len(w) for w in words])
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        step = max(1, (1 << 20) // max(n, 1))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            c = _letters([words[i] for i in some])
            power = np.concatenate([[np.uint64(1)], np.full(n, _BASE)])
            power = np.multiply.accumulate(power)
            before = np.zeros((len(some), n + 1), np.uint64)
            np.cumsum(_words.mix(c + np.uint64(1)) * power[:n], axis=1, out=before[:, 1:])
            whole = before[:, -1:]
            left = before[:, :-1] + (whole - before[:, 1:]) * _INVERSE
            # leaving out any letter of a run of equal ones gives the same string: the run's first stands for it
            start = np.ones(c.shape, bool)
            start[:, 1:] = c[:, 1:] != c[:, :-1]
            r, i = np.nonzero(start)
            last = np.concatenate([i[1:], [n]])
            last[np.concatenate([r[1:] != r[:-1], [True]])] = n
            salt = lambda k: np.uint64(k * 0xD6E8FEB86659FD93 % 2**64)  # noqa: E731  so that only keys of one length meet
            out.append((some[r], _words.mix(left[r, i] + salt(n - 1)), c[r, i], i, last - 1))
            alone = np.full(len(some), -1)
            out.append((some, _words.mix(whole[:, 0] + salt(n)), np.zeros(len(some), np.uint64), alone, alone))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def deletions(vocab: DataFrame) -> DataFrame:
    """(key, id, letter, first, last): what each word of ``vocab`` (id, word) emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _words.slices(batches, "word", 1 << 16):
            ids = b.column("id").to_numpy()
            row, key, letter, first, last = keys(b.column("word").to_pylist())
            for at in range(0, len(row), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.record_batch({"key": pa.array(key[s].view(np.int64)), "id": pa.array(ids[row[s]]), "letter": pa.array(letter[s].astype(np.int32)), "first": pa.array(first[s].astype(np.int32)), "last": pa.array(last[s].astype(np.int32))})

    return vocab.select("id", "word").mapInArrow(run, "key long, id long, letter int, first int, last int")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, b): ids of words of ``vocab`` (id, word) that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    left = _store.table(deletions(vocab), "deletions")
    right = left.toDF("key", "b", "b_letter", "b_first", "b_last")
    # one word is the other less a letter, or both lack different letters at one place
    own, other = F.col("first") < 0, F.col("b_first") < 0
    same_place = (F.col("first") <= F.col("b_last")) & (F.col("b_first") <= F.col("last")) & (F.col("letter") != F.col("b_letter"))
    met = left.join(right, "key").filter((F.col("id") < F.col("b")) & ((own != other) | (~own & ~other & same_place)))
    met = _store.table(met.select(F.col("id").alias("a"), "b", "first", "b_first"), "pairs")
    words = vocab.select("id", "word")
    both = met.join(words.toDF("a", "a_word"), "a").join(words.toDF("b", "b_word"), "b")
    # equal but for the letters left out, which differ and stand at one place: one edit, in time of the length
    less = lambda w, at: F.when(F.col(at) < 0, F.col(w)).otherwise(F.concat(F.substring(w, F.lit(1), F.col(at)), F.substring(w, F.col(at) + 2, F.char_length(w))))
    return both.filter(less("a_word", "first") == less("b_word", "b_first")).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of the way from each id of (id, form) along forms; forms never lead in circles."""
    now = _store.table(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = now.toDF("root", "further")
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = _store.table(now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "roots")


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``vocab`` (id, word, n).

    A form is the near word of largest count (ties: smallest), if that is at least ``ratio`` times the word's.
    """
    pairs = _store.table(near_pairs(vocab), "near")
    both = pairs.unionAll(pairs.select("b", "a")).toDF("id", "near")
    near = vocab.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    # the largest count, and of equal ones the smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("word"), F.col("near").alias("id"))).alias("best")
    found = both.join(near, "near").groupBy("id").agg(F.count("*").alias("n_near"), best)
    rows = vocab.join(found, "id", "left")
    led = -F.col("best.n") >= ratio * F.col("n")
    rows = _store.table(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(led, c).alias(to) for c, to in ((F.col("best.word"), "form"), (F.col("best.id"), "form_id"), (-F.col("best.n"), "form_n")))), "forms")
    end = roots(rows.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    end = end.join(vocab.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return rows.join(end, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, a ninety-seventh of which are misspelt first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(vocabulary(runs(docs).select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))))
