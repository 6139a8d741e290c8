"""Budgets by whole entities against a loop that adds an entity, counts and takes it back."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from grafloom.operators import entity_budget, models, search

EDGE = "source string, target string, rank double, size int"
CLAIM = "id string, subject_id string, size int"


def strict(sizes, header, budget):
    total = header
    for n, s in enumerate(sizes):
        if total + s > budget:
            return n, total
        total += s
    return len(sizes), total


def loop(selected, edges, claims, budget, used, top_k, header, claim_header):
    """(how many entities are taken, relationships, claims)."""
    best, kept, mine = 0, [], []
    for n in range(1, len(selected) + 1):
        names = set(selected[:n])
        inside = sorted([e for e in edges if e[0] in names and e[1] in names], key=lambda e: (-e[2], e[0], e[1]))
        leaving = [e for e in edges if (e[0] in names) != (e[1] in names)]
        ends = defaultdict(set)
        for s, t, *_ in leaving:
            ends[t if s in names else s].add(s if s in names else t)
        leaving.sort(key=lambda e: (-len(ends[e[1] if e[0] in names else e[0]]), -e[2], e[0], e[1]))
        rows = inside + leaving[:max(1, top_k * n)]
        m, total = strict([e[3] for e in rows], header, budget) if rows else (0, 0)
        about = [c for x in selected[:n] for c in sorted(claims) if c[1] == x]
        k, more = strict([c[2] for c in about], claim_header, budget) if claims else (0, 0)
        if used + total + more > budget:
            break
        best, kept, mine = n, rows[:m], about[:k]
    return best, kept, mine


@pytest.mark.parametrize("seed,budget", [(1, 60), (2, 120), (3, 400), (4, 5), (5, 200)])
def test_equals_the_loop(spark, seed, budget):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = list({(a, b): (a, b, float(r.randint(1, 4)), r.randint(1, 9)) for a, b in (r.sample(names, 2) for _ in range(70))}.values())
    claims = [(f"c{i}", r.choice(names), r.randint(1, 6)) for i in range(25)]
    selected = r.sample(names, 6)
    want = loop(selected, edges, claims, budget, 3, 2, 2, 4)
    sel = spark.createDataFrame([(t, i + 1) for i, t in enumerate(selected)], "title string, ord int")
    got = entity_budget.whole_entities(sel, spark.createDataFrame(edges, EDGE), budget, spark.createDataFrame(claims, CLAIM), 3, 2, 2, 4)
    order = [F.col("out"), F.desc("links"), F.desc("rank"), F.col("source"), F.col("target")]
    rows = [tuple(x) for x in got.relationships.orderBy(*order).select("source", "target", "rank", "size").collect()]
    mine = [tuple(x) for x in got.claims.orderBy("ord", "id").select("id", "subject_id", "size").collect()]
    assert (got.taken, rows, mine) == want


def test_edge_cases(spark):
    sel = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "title string, ord int")
    edges = spark.createDataFrame([("a", "b", None, None), ("a", "x", 1.0, 2), ("a", "a", 1.0, 1), (None, "a", 1.0, 1), (None, None, 1.0, 1)], EDGE)
    got = entity_budget.whole_entities(sel, edges, 10)
    assert got.taken == 3 and got.claims is None and got.relationships.count() == 4
    none = entity_budget.whole_entities(sel.limit(0), edges, 10)
    assert none.taken == 0 and none.relationships.count() == 0
    empty = entity_budget.whole_entities(sel, edges.limit(0), 0, spark.createDataFrame([], CLAIM))
    assert empty.taken == 3 and empty.claims.count() == 0


def test_search_takes_whole_entities_and_history(spark):
    ents = spark.createDataFrame([("1", "A", "first", 3, [1.0, 0.0]), ("2", "B", "second", 2, [0.9, 0.1])], "id string, title string, description string, rank int, vector array<double>")
    rel = spark.createDataFrame([("A", "B", "joined", 1.0, 5), ("B", "C", " ".join(["long"] * 300), 1.0, 4)], "source string, target string, description string, weight double, rank int")
    mentions, units = spark.createDataFrame([("u", "A")], "unit string, title string"), spark.createDataFrame([("u", "text of u")], "unit string, chunk string")
    given = {"entities": ents, "relationships": rel, "mentions": mentions, "units": units}
    model = models.Canned({"Answer from the tables": "local"})
    found = search.local_search("q", given, lambda _: [1.0, 0.0], model, k=2, budget=200, history="user said hello")
    assert "joined" in found.context and "long" not in found.context and found.context.startswith("-----Conversation History-----\nuser said hello")
