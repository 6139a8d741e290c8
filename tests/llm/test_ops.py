"""The subpackage's operators against brute force, with awkward tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grafloom.llm import _blocks, _links, _tokens, _words, embedding_dedup, jaccard, language, language_model, mixing, neighbours, packing, quality, secret_scan, stages, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (None, "no id here", None, "s", 10), (5, "wort " * 30_000, "de", "t", 150_000), (6, "Ünïcode x 12 !!", "fr", "t", 5)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("score", F.lit("clash")).withColumn("size", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_words_and_hashes():
    texts = ["a  bB\tc", "", None, "x", "ab cd ef gh ij"]
    raw, offs = _words.buffers(pa.array(texts))
    start, end, row = _words.words(raw, offs)
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert [(int(r), raw[s:e].tobytes().decode()) for s, e, r in zip(start, end, row)] == want
    h = _words.hashes(raw, start, end)
    alone = [_words.hashes(*_span(w))[0] for _, w in want]
    assert h.tolist() == [int(x) for x in alone]
    assert (_words.unmix(_words.mix(h)) == h).all()
    # long texts are hashed in pieces, whatever the order of the spans
    many = [f"wörd{i}" for i in range(300_000)]
    raw, offs = _words.buffers(pa.array([" ".join(many)]))
    start, end, _ = _words.words(raw, offs)
    assert len(raw) > 2 << 20
    pick = np.random.default_rng(1).permutation(len(start))[:500]
    got = _words.hashes(raw, start[pick], end[pick])
    assert (got == _words.hashes(raw, start, end)[pick]).all() and got.tolist() == [int(_words.hashes(*_span(many[i]))[0]) for i in pick]


def _span(w):
    raw = np.frombuffer(w.encode(), np.uint8)
    return raw, np.array([0]), np.array([len(raw)])


def test_blocks_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    cols = [keys, np.arange(1000, dtype="<u4"), keys[::-1].astype("<u8")]
    got = _blocks.unpack(_blocks.pack(*cols))
    assert all((a == b).all() for a, b in zip(cols, got))
    parts = [_blocks.unpack(b)[0] for _, _, b in _blocks.by_range("k", [keys], 7)]
    assert (np.concatenate(parts) == keys).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        u, v = find(a), find(b)
        parent[max(u, v)] = min(u, v)
    got = {r.node: r.component for r in _links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# 9: secrets


def base_spans(t):
    out = []
    for kind, rule in (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(rule, t, re.ASCII):
            n = len(m[2]) if kind == "assign" else len(m[0])
            if n >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()))
    return sorted(out)


def test_secrets(spark, docs, none):
    extra = ["token=secret: abcdefghijklmnop", "é Password : 'abcdefghijkl'", "AKIAAKIA" + "A" * 20, "x" + "0123456789abcdef" * 2, "api_key=short", "AKIA" + "B" * 13, "key gh" + "p_" + "a" * 36]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(extra)] + [(20_000, None), (20_001, extra[0])]
    got = {r.doc_id: r for r in _scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(b[2] == k for b in base) for k in ("assign", "access", "hex"))
    assert "github:" in got[10_006].spans
    assert _scanned(none).count() == 0


def _scanned(df):
    return secret_scan.findings(df, secret_scan.scan(df))


def test_ledger_skips_what_it_has(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    ledger = secret_scan.scan(d.filter("doc_id = 1"), secret_scan.empty_ledger(spark))
    assert secret_scan.scan(d, ledger).count() == 1 and secret_scan.scan(d, ledger, "other").count() == 2


def test_visits_reach_the_recall_on_dense_vectors():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for every in (1, 3):
        x = rng.normal(size=(6000, 64))
        x[::every] = rng.normal(size=64) + 0.02 * rng.normal(size=(len(x[::every]), 64))
        x = unit(x)
        m = embedding_dedup.fit(x, 500_000, 0.98)
        assert len(m.left) == len(m.right) == embedding_dedup.centres(500_000) == 70
        every = m.traverse(y := x[:50], 4900)
        assert (m.rank(y, every[:, 700]) == 700).mean() > 0.9
        y, u = x[rng.integers(0, len(x), 500)], rng.normal(size=(500, 64))
        mate = m.cells(0.98 * y + np.sqrt(1 - 0.98**2) * unit(u - (u * y).sum(1, keepdims=True) * y))
        assert (m.traverse(y, m.visits) == mate[:, None]).any(1).mean() >= 0.98


def test_no_key_line_survives(spark):
    lines = [hashlib.sha512(bytes([i])).hexdigest()[:64].upper().replace("0", "z") for i in range(30)] + ["Qx7="]
    begin, end = ("-----" + x + " RSA PRIVATE KEY-----" for x in ("BEGIN", "END"))
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n"
    body = "\n".join(lines)
    texts = [f"before\n{begin}\n{x}\nafter it" for x in (f"{body}\n{end}", body, f"{head}{body}\n{end}", head + body, f"{lines[0]}\n{begin}\n{body}\n{end}")]
    texts += [t.replace("\n", n) for t in texts[:2] for n in ("\r\n", "\\n", "\n> ", "\n    ", " ")] + [f"before {begin} after it"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    for r in stages.mask_secrets(spark, df, "").collect():
        assert not any(x in r.text for x in lines) and "PRIVATE KEY" not in r.text
        assert r.text.startswith("before") and r.text.endswith("after it")


def test_odd_rows_secrets(odd):
    assert _scanned(odd).count() == len(ODD)


# 1: mixing


def test_mixing(spark, docs, odd, none):
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    size, names = collections.Counter(), sorted({r.source for r in rows})
    for r in rows:
        size[r.source] += r.size
    w, total, capped = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        goal = {s: 3 * size[s] if s in capped else left * w[s] / sum(w[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and goal[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in names:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(goal[s]) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - goal[s]) <= 0.5 * max(r.size for r in own) + 1e-6
        assert all(r.taken in (r.size * k for k in (math.floor(goal[s] / size[s]), math.ceil(goal[s] / size[s]))) for r in own)
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0


def test_targets_cap(spark):
    s = spark.createDataFrame([("a", 1), ("b", 100), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got["a"] == 3.0 and got["b"] == pytest.approx(198 * 2 / 5) and got[None] == pytest.approx(198 * 3 / 5)


# 2 and 3: classifiers


def test_classifiers_learn_and_handle_odd_rows(odd, none):
    good, bad = ["some plain words stand here and there %d" % i for i in range(40)], ["W$ORD## BUY!! %d NOW!!" % i for i in range(40)]
    m = quality.fit(good[::2], bad[::2])
    assert (quality.score_texts(pa.array(good[1::2]), m) > 0.5).mean() > 0.9 and (quality.score_texts(pa.array(bad[1::2]), m) < 0.5).mean() > 0.9
    for f in (lambda d: quality.score(d, m), lambda d: quality.score(d, None), lambda d: toxicity.score(d, None)):
        rows = f(odd).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and f(none).count() == 0


def test_toxicity_learns():
    rng = np.random.default_rng(1)
    prose = ["alpha", "beta", "gamma", "delta", "omega", "the", "of", "and", "river", "stone", "cloud", "light"]
    text = lambda bad: " ".join("vilewretch" if bad and i % 12 == 5 else prose[rng.integers(len(prose))] + prose[rng.integers(len(prose))] for i in range(80))
    toxic, clean = [text(True) for _ in range(80)], [text(False) for _ in range(160)]
    m = toxicity.fit(toxic[:60], clean[:120])
    a, b = toxicity.score_texts(pa.array(toxic[60:]), m), toxicity.score_texts(pa.array(clean[120:] + ["", None]), m)
    assert (a >= 0.5).mean() > 0.9 and (b < 0.5).mean() > 0.9


def test_windows_cover_every_word():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(40)]
    raw, offs = _words.buffers(pa.array(texts))
    start, end, row = toxicity._windows(raw, offs)
    for i, t in enumerate(texts):
        seen = {w for s, e, r in zip(start, end, row) if r == i for w in raw[s:e].tobytes().decode().split()}
        assert seen == set(t.split())


# 4 and 7: vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[100:140] = x[0:40] + rng.normal(scale=0.02, size=(40, 16))
    x[140:160] = x[50]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0] * 16, None), (1005, [float("inf")] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))


def test_neighbours(vectors):
    rows = [(r.vec_id, np.array(r.embedding)) for r in vectors.collect() if r.vec_id < 1000 or r.vec_id == 1004]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = collections.defaultdict(list)
    for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    queries = [i for i in ids if i % 20 == 0]
    assert set(got) == set(queries)
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit += len({int(ids[i]) for i in order} & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and all(sc == pytest.approx(s[list(ids).index(v)]) for v, sc in got[q])
    assert hit >= 0.9 * 20 * len(queries)
    assert neighbours.search(vectors.limit(0), F.lit(True)).count() == 0
    few = neighbours.search(vectors.filter("vec_id in (0, 1, 2)"), F.lit(True))
    assert few.count() == 6
    # equal vectors: the smaller vec_id first; other lengths take no part; of one vec_id the smaller vector counts; long ones squeeze none
    same = [(i, [1.0, 2.0] * 8, 0) for i in range(60)] + [(70, [1.0], 0), (71, [3e9] * 16, 0), (72, [-1.0] * 16, 0), (72, [9.0] * 16, 0)]
    got = neighbours.search(vectors.sparkSession.createDataFrame(same, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        assert [r.vec_id for r in got if r.query_id == q] == [71, *[i for i in range(21) if i != q][:19]]
    assert not [r for r in got if r.vec_id in (70, 72)]


def test_embedding_dedup(vectors):
    rows = {r.vec_id: (r.embedding, r.label) for r in vectors.collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, (v, lab) in rows.items() if i < 1000 or i == 1004}
    near = {i: {j for j in unit if j != i and rows[i][1] is not None and rows[i][1] == rows[j][1] and unit[i] @ unit[j] >= 0.98} if i in unit else set() for i in rows}
    got = {r.vec_id: r for r in embedding_dedup.link(vectors).collect()}
    assert set(got) == set(rows)
    for i in rows:
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), min(seen), min(seen) == i)
    assert embedding_dedup.link(vectors.limit(0)).count() == 0


# 5: n-gram Jaccard join


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, docs, n, percent):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(60):  # a family around the threshold
        t = list(base)
        for i in rng.integers(0, len(t), rng.integers(0, 6)):
            t[i] = f"z{rng.integers(10**6)}"
        rows.append((5000 + k, " ".join(t)))
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(6000 + k, shared + " " + " ".join(f"u{k}_{i}" for i in range(40))) for k in range(30)]
    rows += [(7000, None), (7001, ""), (7002, "A b"), (7003, "a  B"), (7004, "a b c d e"), (7004, "a b c d e")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect())
    assert got == sorted(brute_components(rows, n, percent))


def test_jaccard_odd(odd, none):
    assert jaccard.join(odd).count() == len(ODD) and jaccard.join(none).count() == 0


# 6: packing


def test_packing(spark, docs, odd, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path(_tokens.VOCABULARY))
    hard = ["don't I'll WE'RE it's", "ǅ İstanbul ﬁne café café x²", "a_b--c!!! 1234 ...", "日本語 текст   wide", "’quoted’ <|endoftext|> end", "x<|endoftext|>y <|ENDOFTEXT|> a<|startoftext|>", "ſtraße ÿ Ÿ"]
    extra = spark.createDataFrame([(50_000 + i, t, "en", "h", 1) for i, t in enumerate(hard)], DOC)
    rows = docs.unionByName(extra)
    pieces = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for p in packing.pack(rows).collect():
        pieces[p.doc_id].append(p)
        seqs[p.sequence_id].append((p.offset, p.length))
    for r in rows.collect():
        ids, at = np.array([*full.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(none).count() == 0
    assert packing.pack(odd).filter("doc_id is null").agg(F.sum("length")).first()[0] == 4


def test_windows_hold_the_target_shares(spark, docs):
    # a table that lies in order of its sources, and a heavy one
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id % 97, ' '), 60) AS text", "CASE WHEN id < 1500 THEN 'a' WHEN id < 2500 THEN 'b' ELSE NULL END AS source")
    rows = rows.repartitionByRange(4, "source", "doc_id")
    share = {"a": 1 / 2, "b": 1 / 3, None: 1 / 6}
    names = {r.doc_id: r.source for r in rows.select("doc_id", "source").collect()}
    windows = collections.defaultdict(collections.Counter)
    for p in packing.pack(rows).collect():
        windows[p.sequence_id][names[p.doc_id]] += p.length
    full = [w for w in windows.values() if sum(w.values()) == 2048]
    assert len(full) > 0.8 * len(windows)
    near = [all(abs(w[s] / 2048 - share[s]) < 0.3 for s in share) for w in full]
    assert np.mean(near) > 0.95
    # deficits carry: over the windows of a partition, every source keeps close to its share
    by = collections.defaultdict(collections.Counter)
    for q, w in windows.items():
        by[q >> 33].update(w)
    for w in by.values():
        assert all(abs(w[s] / sum(w.values()) - share[s]) < 0.1 for s in share)
    half = collections.Counter()
    for p in packing.pack(rows, weights={"a": 1.0, "b": 1.0}).filter("sequence_id % 8589934592 < 20").collect():
        half[names[p.doc_id]] += p.length
    assert abs(half["a"] - half["b"]) < 0.1 * half["a"] and half[None] < 0.1 * half["a"]


# 8: language


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    count = np.array([0, 1, 47, 48, 49, 130, 0, 3])
    row = np.repeat(np.arange(len(count)), count)
    e, step = rng.normal(size=(len(row), 3)) * 3, rng.normal(size=(3, 3))
    got = language.marginals(e, row, len(count), step)
    for r in range(len(count)):
        x = e[row == r]
        if not len(x):
            continue
        a, b = np.zeros_like(x), np.zeros_like(x)
        a[0] = x[0] + np.logaddexp.reduce(step - np.log(3), axis=0)
        for t in range(1, len(x)):
            a[t] = x[t] + np.logaddexp.reduce(a[t - 1][:, None] + step, axis=0)
        for t in range(len(x) - 2, -1, -1):
            b[t] = np.logaddexp.reduce(step + x[t + 1] + b[t + 1], axis=1)
        m = np.exp(a + b - np.logaddexp.reduce(a + b, axis=1)[:, None])
        assert np.allclose(got[row == r], m, atol=1e-9)


def test_language(spark, docs, odd, none):
    model = language.train(docs)
    rows = language.identify(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    got = language.identify(odd, model)
    assert got.count() == len(ODD) and all(r.lang_pred == "und" for r in got.filter("text is null or trim(text) = ''").collect())
    assert language.predict(pa.array(["12 !! ---", "  —"]), model)[0] == ["und", "und"]
    assert language.identify(none, model).count() == 0 and language.train(none) is None
    assert language.identify(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_code_switch(docs):
    texts = {lang: [r.text for r in docs.filter(F.col("lang") == lang).limit(30).collect()] for lang in ("en", "de")}
    model = language.fit([t for v in texts.values() for t in v], [k for k, v in texts.items() for _ in v])
    mixed = " ".join(texts["en"][0].split()[:40] + texts["de"][0].split()[:40])
    m, *_ = language.label_words(pa.array([mixed]), model)
    best = [model.languages[i] for i in m.argmax(1)]
    assert best[:40].count("en") > 35 and best[40:].count("de") > 35


# 10: language model


@pytest.mark.parametrize("order,prune", [(2, 0), (3, 0), (3, 1)])
def test_language_model(spark, docs, odd, none, order, prune):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, None), (9001, ""), (9002, "Aa aA aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.fit(df, ~toxicity.held_out("doc_id", 7, 2), order, prune)
    toks = {i: [*WORD.findall(lower(t)), "</s>"] for i, t in rows}
    train = [w for i, w in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    top = collections.Counter(g for w in train for g in zip(*(["<s>"] * (order - 1 - k) + w for k in range(order - 1)), w))
    # counts by order, the highest first: its own counts, then the distinct words before
    counts = {order: top}
    for m in range(order - 1, 0, -1):
        counts[m] = collections.Counter(g[1:] for g in counts[m + 1])
    disc = {m: [0.0, *language_model._discounts(np.array([sum(x == k for x in counts[m].values()) for k in (1, 2, 3, 4)]))] for m in counts}
    context = {m: collections.Counter() for m in counts}
    kept = {m: collections.defaultdict(float) for m in counts}
    for m in counts:
        for g, k in counts[m].items():
            context[m][g[:-1]] += k
            if m < order or k > (prune if order == 3 else 0):
                kept[m][g[:-1]] += k - disc[m][min(k, 3)]

    def p(*g):
        if not g:
            return 1 / (v + 1)
        m, low = len(g), p(*g[1:])
        total, k = context[m][g[:-1]], counts[m][g]
        if not total:
            return low
        own = k - disc[m][min(k, 3)] if k and (m < order or k > (prune if order == 3 else 0)) else 0.0
        return own / total + (1 - kept[m][g[:-1]] / total) * low

    assert (model.total, model.vocabulary) == (n, v)
    for r in language_model.score(df, model).collect():
        w = toks[r.doc_id]
        assert r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        grams = list(zip(*(["<s>"] * (order - 1 - k) + w for k in range(order - 1)), w))
        assert r.score == pytest.approx(sum(math.log10(p(*g)) for g in grams))
    some = max(top, key=lambda g: top[g])
    assert sum(p(*some[:-1], x) for x in [*c, "<never seen>"]) == pytest.approx(1.0)
    assert language_model.score(odd, model).count() == len(ODD)
    empty = language_model.fit(none, F.lit(True), order, prune)
    assert language_model.score(odd, empty).filter("doc_id = 2").first().score == 0.0


# the pipeline


def test_stages(spark, docs, odd, none):
    for name, stage in (("language", stages.identify_language), ("copies", stages.drop_near_copies), ("secrets", stages.mask_secrets), ("mixing", stages.mix_sources)):
        assert stage(spark, docs, "").columns == docs.columns, name
        stage(spark, odd.select(*docs.columns), "").collect()
        assert stage(spark, none.select(*docs.columns), "").count() == 0, name


CLASH = ("blob", "spans", "masked", "copies", "row", "key", "lang_pred", "score", "copy", "i", "s")


def test_stages_keep_columns_of_any_name(spark, docs):
    own = docs.limit(40).cache()
    more = own
    for c in CLASH:
        more = more.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for stage in (stages.identify_language, stages.drop_near_copies, stages.mask_secrets, stages.mix_sources):
        plain, wide = stage(spark, own, ""), stage(spark, more, "")
        assert wide.columns == [*docs.columns, *CLASH]
        assert sorted(map(repr, wide.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))
        assert wide.filter(" AND ".join(f"{c} = concat('{c}', doc_id)" for c in CLASH)).count() == wide.count()
    assert sorted(packing.pack(more).collect()) == sorted(packing.pack(own).collect())


def test_near_copies_under_one_doc_id(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (1, base + " end"), (1, "something else by far"), (2, base), (None, base), (None, "alone without an id"), (3, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    got = sorted((r.doc_id or 0, r.text) for r in stages.drop_near_copies(spark, df, "").collect())
    assert [i for i, _ in got] == [0, 1, 1, 3] and (1, "something else by far") in got and got[0][1] == "alone without an id"


def test_pipeline_run(spark, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mixing", "packing"]
    extra = spark.createDataFrame([(90_001, "12 !! ---", "en", "s", 9), (90_002, None, None, None, None), (90_003, "", "en", "s", 0)], DOC)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    kept = {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    def masked(t):
        at, out = 0, ""
        for s, _, e in secret_scan.find_spans(t):
            if s >= at:
                out += t[at:s] + stages.MASK
            at = max(at, e)
        return out + t[at:]

    left = docs.filter(F.col("doc_id").isin([int(d) for d in kept])).collect()
    clean = spark.createDataFrame([(r.doc_id, masked(r.text), r.lang, r.source, len(masked(r.text))) for r in left], DOC)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path(_tokens.VOCABULARY))
    assert got == {r.doc_id: copies[r.doc_id] * (len(full.encode(r.text, add_special_tokens=False).ids) + 1) for r in clean.collect() if copies[r.doc_id]}


def test_copies_are_scanned_once_and_every_version_is_found(spark):
    versions = ["token = abcdefghijkl0", "token = abcdefghijkl1", "nothing"]
    d = spark.createDataFrame([(i, versions[i % 3]) for i in range(900)], "doc_id long, text string")
    ledger = secret_scan.scan(d).cache()
    assert ledger.count() == 3 and secret_scan.scan(d, ledger).count() == 0
    assert secret_scan.findings(d, ledger).filter("n_assign = 1").count() == 600
    more = d.unionByName(spark.createDataFrame([(901, "secret: zyxwvutsrqponm")], d.schema))
    new = secret_scan.scan(more, ledger)
    assert new.count() == 1 and secret_scan.findings(more, ledger.unionByName(new)).count() == 901


def test_attention_gradient():
    rng = np.random.default_rng(4)
    x, row, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    p, weight = quality.parameters(5, rng), np.array([0.1, 0.2, 0.3, 0.4])
    loss, g = quality.gradient(p, x, row, y, weight)
    # pooling by its definition, a document at a time
    want = 0.0
    for r in range(4):
        h = np.tanh(x[row == r] @ p["e"][:-1] + p["e"][-1])
        a = np.exp((np.tanh(h @ p["v"]) / (1 + np.exp(-h @ p["u"]))) @ p["w"])
        out = 1 / (1 + np.exp(-((a / a.sum()) @ h @ p["c"][:-1] + p["c"][-1])))
        want -= weight[r] * (y[r] * np.log(out) + (1 - y[r]) * np.log(1 - out))
    assert loss == pytest.approx(want)
    for k, v in p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in v.shape)
            old, e = v[i], 1e-5
            v[i] = old + e
            up = quality.gradient(p, x, row, y, weight)[0]
            v[i] = old - e
            down = quality.gradient(p, x, row, y, weight)[0]
            v[i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_compressed_lengths():
    import zstandard

    texts = ["alpha beta gamma delta " * 3, "", None, "one two three"]
    raw, offs = _words.buffers(pa.array(texts))
    start, end, row = toxicity._windows(raw, offs)
    dicts = [toxicity._dictionary([b"alpha beta gamma", b"one two"] * k) for k in (1, 2)]
    gain = toxicity._gains(raw, start, end, *(toxicity._compressor(d) for d in dicts))
    for s, e, g in zip(start, end, gain, strict=True):
        one = [len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[s:e].tobytes())) for d in dicts]
        assert g == one[1] - one[0]


def test_texts_over_a_slice(spark):
    long = " ".join(f"wort{i % 5000}" for i in range(400_000))
    rows = [(1, long, "de", "s", 1), (2, long + " ende", "de", "s", 1), (3, "kurz", "de", "t", 1)]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in jaccard.join(df).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles == 5000
    assert {r.doc_id: r.n_tokens for r in language_model.score(df, language_model.fit(df, F.lit(True))).collect()} == {1: 400_001, 2: 400_002, 3: 2}
    model = language.fit(["kurz und klein", "short and small"], ["de", "en"])
    assert language.identify(df, model).filter("score > 0").count() == 3
    assert quality.score(df, quality.fit(["good text"], ["BAD TEXT"])).count() == 3
    assert packing.pack(df).agg(F.countDistinct("doc_id")).first()[0] == 3


def test_many_languages_and_rare_letters():
    names = [f"l{i:02}" for i in range(70)]
    texts = [" ".join(f"{n}{'abc'[k % 3]}" for k in range(60)) for n in names]
    m = language.fit(texts * 2, names * 2, epochs=6)
    assert len(m.languages) == 70 and m.emit.shape[0] * 70 <= language.BUCKETS * 64
    assert np.mean([a == b for a, b in zip(language.predict(pa.array(texts), m)[0], names)]) > 0.9
    assert "und" not in language.predict(pa.array(["\u00b5 \u00aa \u00ba"]), m)[0]


def test_copies_are_unbiased(spark):
    # over seeds, a source's documents are taken as often as its rate says
    d = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    runs = [{r.doc_id: r.copies for r in mixing.mix(d, seed=s).collect()} for s in range(12)]
    rate = {r.doc_id: r.target / r.source_size for r in mixing.mix(d).collect()}
    mean = {i: np.mean([r[i] for r in runs]) for i in rate}
    for part in (0, 1):
        assert abs(np.mean([mean[i] - rate[i] for i in rate if i % 2 == part])) < 0.08


def test_stage_results(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    assert {r.doc_id for r in stages.drop_near_copies(spark, docs, "").collect()} == kept
    masked = {r.doc_id: r for r in stages.mask_secrets(spark, docs, "").collect()}
    assert len(masked) == len(rows)
    for d, t in rows:
        assert (masked[d].text == t) == (not secret_scan.find_spans(t)) and masked[d].n_chars == len(masked[d].text)
        assert not [s for s in base_spans(masked[d].text) if s[2] != "hex"]
    mixed = collections.Counter(r.doc_id for r in stages.mix_sources(spark, docs, "").collect())
    assert mixed == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}


def test_quality_sample_encoded_in_slices():
    """Texts encoded a slice at a time are those encoded at once."""
    texts = ["one two, three. " * 200, "", None, "x" * 3000, "Ünï çode", "last one"]
    at_once, sliced = quality.passages(pa.array(texts, pa.string())), [quality._encoded(texts, n) for n in (1, 2500, 1 << 20)]
    assert all(np.array_equal(a, b) for s in sliced for a, b in zip(at_once, s, strict=True))


def test_idle_workers_hold_little():
    """Scanning and masking take a slice of texts at a time, hashing keeps short tables, and none stay after a task."""
    texts = ["password = abcdefghijkl " + "wort " * 60_000] * 12 + [None, ""]
    blobs = pa.record_batch({"blob": pa.array(map(str, range(14))), "text": pa.array([t or "" for t in texts]), "rule_version": pa.array(["1"] * 14)})
    got = list(secret_scan._scan(iter([blobs])))
    assert [b.num_rows for b in got] == [3, 3, 3, 5]
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["blob"] for r in rows] == blobs.column("blob").to_pylist()
    assert [r["spans"] for r in rows] == [secret_scan._joined(secret_scan.find_spans(t or "")) for t in texts]
    raw, offs = _words.buffers(pa.array([" ".join(f"w{i}" for i in range(400_000))]))
    start, end, _ = _words.words(raw, offs)
    some = np.arange(0, len(start), 997)
    assert len(raw) > 2 * _words._STEP
    for n in (len(raw), 2 * _words._STEP):
        of = some[end[some] <= n]
        assert (_words.hashes(raw[:n], start[of], end[of]) == [_words.hashes(raw[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(start[of], end[of], strict=True)]).all()
        assert len(_words._POW["p"]) == _words._STEP + 1
    _words.release()
    assert not _words._POW


def test_masked_by_slices(spark):
    """Rows of a batch of several slices keep their order and texts."""
    rows = [(i, f"{i} " + "wort " * 60_000 + "password = abcdefghijkl end" * (i % 2), "de", "s", 1) for i in range(12)] + [(12, None, "de", "s", 0), (13, "", "de", "s", 0)]
    got = {r.doc_id: r.text for r in stages.mask_secrets(spark, spark.createDataFrame(rows, DOC).coalesce(1), "").collect()}
    assert got == {i: t and t.replace("password = abcdefghijkl", stages.MASK) for i, t, *_ in rows}


def test_word_cache_is_arrays(monkeypatch):
    """Slices that share words, before and after the cache is cleared, give the ids of the library's own encoder."""
    monkeypatch.setattr(_tokens, "CACHE", 3000)
    tokens = _tokens.Tokens()
    for k in range(8):
        texts = [" ".join(f"w{(i * 37 + k * 401) % 5000} Ünï-{i % 11}," for i in range(n)) for n in (900, 0, 7)]
        ids, offs = tokens.ids(pa.array([*texts, None]))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [[*tokens.full.encode(t, add_special_tokens=False).ids, 1] for t in [*texts, ""]]
        assert (np.diff(tokens.keys.astype(object)) > 0).all() and len(tokens.keys) == len(tokens.slot) == len(tokens.begin) - 1
        assert tokens.keys.nbytes + tokens.slot.nbytes + tokens.begin.nbytes <= 24 * len(tokens.keys) + 8
