"""Byte-pair tokens against a library's encoder on whole texts, and against plain repeated merging."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from grafloom.functions import subword
from grafloom.operators import chunking, search
from grafloom.plans import more_queries

PATH = more_queries.RANKS.removeprefix("file://")
ODD = [None, "", " ", "it's we'll  two  spaces\n\n\nlines \t end ", "日本語のテキスト 😀😀 é́", "x" * 5000, "12345 + 6.5%", "  wide\u0085next", "a\x00b\x1c c", "é" * 700]


def plain(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def toy(seed):
    """Merges of a few letters, most of whose products merge again; a rank table merges in the order of its ranks."""
    r, ranks = random.Random(seed), {bytes([b]): b for b in range(256)}
    made = [b"a", b"b", b"c"]
    while len(ranks) < 300:
        w = r.choice(made) + r.choice(made)
        if w not in ranks:
            ranks[w] = len(ranks)
            made.append(w)
    return ranks


@pytest.mark.parametrize("seed", range(4))
def test_merges(seed):
    r, ranks = random.Random(seed), toy(seed)
    for _ in range(300):
        w = bytes(r.choices(b"abcz", [5, 5, 5, 1], k=r.randint(1, 40)))
        got = subword.merged(w, ranks)
        assert got == ([ranks[w]] if w in ranks else plain(w, ranks))
    words = {i: w for w, i in ranks.items()}
    long = bytes(r.choices(b"abc", k=200_000))
    assert b"".join(words[i] for i in subword.merged(long, ranks)) == long


@pytest.mark.skipif(not os.path.exists(PATH), reason="no rank table here")
def test_equals_a_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    known = tiktoken.Encoding("own", pat_str=subword.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = ODD + [r.text for r in docs]
    by = subword.Subwords.from_file(spark, more_queries.RANKS)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = df.select("id", "text", by.split("text").alias("ids"), by.count("text").alias("n")).withColumn("back", by.join("ids")).collect()
    for r in got:
        want = known.encode_ordinary(r.text or "")
        assert r.ids == want and r.n == len(want) and r.back == (r.text or "")


def test_units_and_budgets(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b" ab": 257}
    by = subword.Subwords(spark, ranks)
    docs = spark.createDataFrame([("1", "g", "ab ab"), ("2", "g", "xyz"), ("3", "h", None)], "id string, k string, text string")
    got = [(r.group_id, r.start, r.n_tokens, r.chunk) for r in chunking.base_text_units(docs, 2, 1, tokenizer=by).orderBy("group_id", "start").collect()]
    assert got == [("1", 0, 2, "ab ab"), ("1", 1, 1, " ab"), ("2", 0, 2, "xy"), ("2", 1, 2, "yz"), ("2", 2, 1, "z")]
    grouped = chunking.base_text_units(docs, 4, 0, ("k",), by).orderBy("start").collect()
    assert [(r.start, r.n_tokens, r.chunk, r.document_ids) for r in grouped] == [(0, 4, "ab abxy", ["1", "2"]), (4, 1, "z", ["2"])]
    reports = spark.createDataFrame([(str(i), "t", "ab ab", 1.0) for i in range(4)], "community string, title string, content string, rank double")
    words, pairs = (search.global_context(reports, None, 40, size=size).count() for size in (by.__class__.count.__get__(by), subword.WORDS.count))
    assert words > pairs == 1


def test_bad_tables(spark):
    full = {bytes([b]): b for b in range(256)}
    for bad in ({}, full | {b"ab": 7}):
        with pytest.raises(ValueError):
            subword.Subwords(spark, bad)
