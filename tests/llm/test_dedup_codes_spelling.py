"""Exact duplicates, vector codes and spelling variants against brute force, with awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafloom.llm import _store, exact_dedup, packing, spelling, stages, vector_codes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\x0b "), (4, "one two"), (4, "one two"), (None, "on e\ttwo"), (5, "wort " * 30_000), (6, "wort" * 30_000), (7, "Ünï code"), (8, "Ünïcode"), (9, "one\r two  ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "n", "size", "kept", "norm", "word", "id", "prefix")}).cache()


# 11: exact duplicates


def brute_groups(rows):
    by = collections.defaultdict(list)
    for d, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, len(t or "")))
    out = []
    for t, own in by.items():
        keep, n = min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(d, keep, len(own), d == keep and m == n, hashlib.sha256(t.encode()).hexdigest()) for d, m in own]
    return sorted(map(repr, out))


def grouped(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def test_exact_groups(spark, odd):
    want = brute_groups(ODD)
    assert grouped(exact_dedup.dedup(odd)) == want
    # without a broadcast, and in buckets of a key
    assert grouped(exact_dedup.dedup(odd, capacity=1, most=0)) == want
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def test_collisions_are_chained(spark):
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(8)), 61)  # noqa: E731  eight hashes for forty texts
    table, index = exact_dedup.build(df, 3, few)
    assert grouped(exact_dedup.groups(table, index)) == brute_groups(rows)
    assert index.count() == 40 and index.agg(F.max("chain")).first()[0] >= 4
    # buckets hold at most three keys each, and what they hold starts with their bits
    held = index.groupBy("depth", "prefix").agg(F.countDistinct("key").alias("n"), F.max(F.shiftrightunsigned("key", 61)), F.min(F.shiftrightunsigned("key", 61))).collect()
    assert all(r.n <= 3 and all(k >> (3 - r.depth) == r.prefix for k in r[3:]) for r in held)


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(4000).select(F.when(F.col("id") < 3900, F.shiftrightunsigned(F.xxhash64("id"), 5)).otherwise(F.xxhash64("id")).alias("key")).distinct()
    cut = exact_dedup.directory(keys, 100)
    rows = cut.collect()
    assert all(r.keys <= 100 for r in rows) and sum(r.keys for r in rows) == keys.count()
    assert max(r.depth for r in rows) > min(r.depth for r in rows)
    assert exact_dedup.buckets(keys, cut).count() == keys.count()


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "ab"), (2, "cd")], "doc_id long, text string")
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.lit("same"), n))
    with pytest.raises(Exception, match="one digest"):
        exact_dedup.dedup(df, key=lambda c: F.lit(1).cast("long")).collect()


# 12: vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, k, [int(np.floor(256 * np.float64(x))) for x in v], lab) for k, (i, v, lab) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for _, _, v, _ in kept:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(got[i]) for c in zip(*got[i], strict=True)] if i in got else e for i, e in enumerate(books[p])]
    out, total = [], collections.Counter()
    for i, _, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), lab))
        total[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, total[lab], digest) for i, c, e, lab in out)


VEC = "vec_id long, embedding array<float>, label int, v string, code string, error string"


@pytest.mark.parametrize("n,scale", [(300, 0.02), (40, 1.0), (1, 1.0)])
def test_codes(spark, tmp_path, n, scale):
    # small scales give many equal distances
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 32)], [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 32, 1), (1002, [None] * 32, 1), (1003, [float("inf")] * 32, None), (1004, [0.0] * 32, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VEC)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in vector_codes.op12_vector_codes(spark, str(tmp_path)).collect())
    assert got == brute_codes(rows)


def test_codes_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", ""), (1, [1.0], 1, "", "", ""), (None, [], 1, "", "", "")], VEC)
    books = vector_codes.fit(df, 2, 2, 1)
    # a shorter vector is filled up with zeros, an empty one is zero
    assert books.books.tolist() == [[[256], [170]], [[0], [256]]] or books.books.shape == (2, 2, 1)
    codes = vector_codes.encode(df, books)
    assert codes.count() == 3 and vector_codes.decode(codes, books).count() == 3
    assert vector_codes.fit(df.limit(0)) is None
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op12_vector_codes(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="can't be coded"):
        vector_codes.fit(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="components"):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 5)], "vec_id long, embedding array<double>"), books)


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = vector_codes.fit(df)
    both = vector_codes.decode(vector_codes.encode(df, books), books).withColumnRenamed("embedding", "y").join(df, "vec_id").collect()
    x, y = (np.array([r[c] for r in both]) for c in ("embedding", "y"))
    assert ((x - y) ** 2).mean() < 0.6 * x.var()


def test_trees_find_the_first_of_equal_entries():
    rng = np.random.default_rng(2)
    for size in (1, 3, 64, 200):
        e = rng.integers(-3, 4, (size, 4))  # many equal entries and distances
        x = rng.integers(-4, 5, (2000, 4))
        found, d = vector_codes.Tree(e).nearest(x)
        every = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (found == every.argmin(1)).all() and (d == every.min(1)).all()


# 13: spelling variants


def brute_words(rows):
    count = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        mates = [x for x in words if near(w, x)]
        best = min(mates, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(mates)
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(repr((w, form[w], root(w), words[w], out[w], words.get(form[w]))) for w in words)


def spelled(df):
    return sorted(repr((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def test_variants_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = brute_words(rows)
    made = spelling.vocabulary(spelling.runs(df).select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word")))
    assert {r.word: r.n for r in made.collect()} == words
    # pairs over the words that begin alike are enough to see every kind of pair
    some = {w: n for w, n in words.items() if w[0] in "abe"}
    assert spelled(spelling.variants(made.filter(F.substring("word", 1, 1).isin(*"abe")))) == brute_variants(some)


def test_variants_of_like_words(spark):
    # runs of equal letters, swaps, letters beyond ASCII, ties and chains of forms
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abñ"), rng.integers(5, 8))): int(n) for n in rng.integers(3, 60, 400)}
    words |= {"chain": 3, "chains": 6, "chainsz": 12, "chainszz": 24, "x" * 70_000: 5, "x" * 70_001: 10, "x" * 69_999 + "y": 4}
    df = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id long, word string, n long")
    got = {r.word: r for r in spelling.variants(_store.table(df, "words")).collect()}
    assert got["chain"].root == "chainszz" and got["x" * 70_000].form == "x" * 70_001 and got["x" * 69_999 + "y"].n_near == 1
    short = {w: n for w, n in words.items() if len(w) < 100}
    assert sorted(repr((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for w, r in got.items() if len(w) < 100) == brute_variants(short)


def test_spelling_of_odd_tables(spark, odd):
    words = spelling.vocabulary(spelling.runs(odd).select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word")), 3, 1)
    assert {r.word: r.n for r in words.collect()} == {w: n for w, n in _all_words(ODD).items() if len(w) >= 3}
    none = spelling.vocabulary(spelling.runs(odd.limit(0)).select(F.col("run").alias("word")))
    assert spelling.variants(none).count() == 0
    assert spelling.keys([])[0].size == 0


def _all_words(rows):
    count = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return count


# what the stages of the pipeline decide


def test_language_stage_writes_what_it_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pick = docs.filter("doc_id < 400 AND lang IS NOT NULL").limit(300)
    wrong = docs.filter("lang = 'de' AND n_chars > 200").limit(3).withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10_000) + F.col("doc_id"))
    none = spark.createDataFrame([(20_000, "12 34 !!", "en", "s", 8)], DOC)
    got = {r.doc_id: r.lang for r in stages.identify_language(spark, pick.unionByName(wrong).unionByName(none), "").collect()}
    # two texts with letters fare by what they say, one without goes
    assert {v for k, v in got.items() if k >= 10_000} == {"de"} and 20_000 not in got and len(got) > 290


def test_rows_of_one_key_stay_whatever_their_order(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, base, lang, source, n) for lang in ("a", "b") for source in ("s", None) for n in (1, None)]
    kept = {repr(stages.drop_near_copies(spark, spark.createDataFrame(x, DOC), "").collect()) for x in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(kept) == 1 and "doc_id=1" in kept.pop()


def test_pieces_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [docs.repartition(7, "lang"), docs.orderBy(F.desc("doc_id")), docs.repartition(3)]
    assert len({repr(sorted(map(tuple, packing.pack(d).collect()))) for d in some}) == 1
