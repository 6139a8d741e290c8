"""Subword tokens: byte pairs merged by rank, from a rank table that is given; counts, windows and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from grafloom.functions import text as T

# Fixed value: how English-centred byte-pair vocabularies cut text into words before merging.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most entries of a rank table, which is broadcast.
MOST = 1_000_000
#: Words whose tokens a task remembers, and the longest of them.
KEPT, LONGEST = 200_000, 64


class WhiteSpace:
    """Tokens as runs between white space: what stands in for subwords where no rank table is given."""

    def split(self, text: Column | str) -> Column:
        return T.tokens(text)

    def join(self, tokens: Column | str) -> Column:
        return T.detokenize(tokens)

    def count(self, text: Column | str) -> Column:
        return T.token_count(text)


class Subwords:
    """Byte-pair tokens of text columns.

    ``ranks`` maps byte strings to ids; the lower id merges first, and every single byte has one. The pattern, a Java
    regular expression that covers any text, cuts words in the JVM; tasks then encode each distinct word of a batch
    once and remember short ones. Null and empty texts have no tokens. Decoding joins the bytes; bytes that are no
    UTF-8, as a window's end may cut a character, become U+FFFD. A text's tokens stay in its row: a very long one
    takes some 30 bytes a character there, whatever its words' lengths.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str = PATTERN):
        if len(ranks) > MOST:
            raise ValueError(f"a rank table of over {MOST} entries is not broadcast")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        if len(set(ranks.values())) < len(ranks):
            raise ValueError("two entries have one id")
        self.pattern = pattern
        shared = spark.sparkContext.broadcast(dict(ranks))

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table, known = shared.value, {}
            for rows in parts:
                yield _encoded(rows, table, known)

        @F.pandas_udf(StringType())
        def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words = {i: w for w, i in shared.value.items()}
            for rows in parts:
                yield rows.map(lambda ids: b"".join(words[i] for i in ids).decode("utf-8", "replace"), na_action="ignore")

        self._encode, self._decode = encode, decode

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, pattern: str = PATTERN) -> Subwords:
        """From lines of a base64 byte string and its rank, at any path that Spark reads."""
        lines = spark.read.text(path).filter("value <> ''").limit(MOST + 1).collect()
        pairs = (line.value.split() for line in lines)
        return cls(spark, {base64.b64decode(word): int(rank) for word, rank in pairs}, pattern)

    def words(self, text: Column | str) -> Column:
        """The words that are encoded one by one; joined, they are the text."""
        return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(self.pattern), F.lit(0))

    def split(self, text: Column | str) -> Column:
        """A text's token ids."""
        return self._encode(self.words(text))

    def join(self, tokens: Column | str) -> Column:
        """The text of token ids."""
        return self._decode(_col(tokens))

    def count(self, text: Column | str) -> Column:
        return F.size(self.split(text))


Tokenizer = Subwords | WhiteSpace
WORDS = WhiteSpace()


def _encoded(rows: pd.Series, ranks: dict[bytes, int], known: dict[str, list[int]]) -> pd.Series:
    """Ids of rows of words; ``known`` is emptied when it is full, so a task's memory is bounded."""
    out = []
    for words in rows:
        ids: list[int] = []
        for w in words:
            got = known.get(w)
            if got is None:
                got = merged(w.encode("utf-8", "replace"), ranks)
                if len(w) <= LONGEST:
                    if len(known) >= KEPT:
                        known.clear()
                    known[w] = got
            ids += got
        out.append(np.asarray(ids, dtype=np.int32))
    return pd.Series(out, dtype=object)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the neighbours of least rank, leftmost first, merge until none has a rank.

    A heap holds the pairs, and links the pieces, so that a word of n bytes takes n log n steps: text without
    spaces is one long word.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of its pieces has merged otherwise
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
