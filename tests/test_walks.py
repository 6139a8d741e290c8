"""Second-order walks: frequencies of steps against their exact probabilities, segments of hubs, edge cases."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grafloom.operators import walks

EDGES = [("a", "b", 5.0), ("a", "c", 1.0), ("b", "c", 2.0), ("a", "d", 0.3), ("d", "e", 4.0), ("c", "e", 7.5)]


def table(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, weight double")


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (0.25, 2.0), (4.0, 0.5)])
def test_step_frequencies(spark, p, q):
    paths = [r.path for r in walks.random_walks(table(spark, EDGES), 3000, 4, p, q, seed=3, segment=2).collect()]
    w = defaultdict(dict)
    for s, t, x in EDGES:
        w[s][t] = w[t][s] = x
    assert len(paths) == 5 * 3000 and all(len(x) == 4 for x in paths)
    seen = defaultdict(Counter)
    for path in paths:
        seen[None, path[0]][path[1]] += 1
        for a, b, c in zip(path, path[1:], path[2:]):
            seen[a, b][c] += 1
    for (prev, at), counts in seen.items():
        n = sum(counts.values())
        want = {x: y * (1 if prev is None or x in w[prev] else 1 / p if x == prev else 1 / q) for x, y in w[at].items()}
        total = sum(want.values())
        assert set(counts) <= set(want)
        for x, y in want.items():
            share = y / total
            assert abs(counts[x] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-9, (prev, at, x)


def test_segments_and_reruns(spark):
    star = table(spark, [("hub", f"n{i:04}", 1.0 + i % 3) for i in range(500)])
    classes, segments = walks.weighted_neighbours(star, 16)
    assert segments.agg(F.max(F.size("near"))).first()[0] == 16 and classes.agg(F.max(F.size("classes"))).first()[0] == 3
    assert segments.filter("title = 'hub'").agg(F.sum(F.size("near"))).first()[0] == 500
    one, two = (sorted(tuple(r.path) for r in walks.random_walks(star, 1, 3, 2.0, 2.0, seed=9).collect()) for _ in range(2))
    assert one == two and len(one) == 501


def test_walk_edge_cases(spark):
    odd = table(spark, [("a", "b", None), ("b", "a", 2.0), ("a", "a", 1.0), (None, "a", 1.0), ("a", "z", 0.0), ("a", "y", float("nan")), ("a", "x", -1.0)])
    classes, segments = walks.weighted_neighbours(odd)
    assert {(r.title, x.near, x.weight) for r in segments.collect() for x in r.near} == {("a", "b", 3.0), ("b", "a", 3.0), ("a", "a", 1.0)}
    assert walks.random_walks(odd.limit(0), 2, 3).count() == 0
    assert walks.random_walks(odd, 2, 1).count() == 4
    with pytest.raises(ValueError):
        walks.random_walks(odd, 1, 3, p=0)
    plain = spark.createDataFrame([("a", "b")], "source string, target string")
    assert {tuple(r.path) for r in walks.random_walks(plain, 1, 3).collect()} == {("a", "b", "a"), ("b", "a", "b")}


def test_embeddings_follow_the_graph(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 0.05)]
    got = {r.title: r.embedding for r in walks.node_embeddings(table(spark, rows), 8, 20, 10, 2, 5, seed=2).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    same = [cos(got[f"a{i}"], got[f"a{j}"]) for i in range(1, 6) for j in range(1, i)]
    other = [cos(got[f"a{i}"], got[f"b{j}"]) for i in range(1, 6) for j in range(1, 6)]
    assert sum(same) / len(same) > sum(other) / len(other) + 0.2
