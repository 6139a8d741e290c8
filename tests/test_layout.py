"""Constant-Potts communities and the force layout on graphs with known parts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafloom.operators import communities, layout
from grafloom.sources import tables

EDGE = "source string, target string, weight double"


def cliques(spark, n=4, size=8):
    rows = [(f"{k}{i}", f"{k}{j}", 1.0) for k in "abcdefgh"[:n] for i, j in itertools.combinations(range(size), 2)]
    rows += [(f"{a}0", f"{b}0", 1.0) for a, b in itertools.pairwise("abcdefgh"[:n])]
    return spark.createDataFrame(rows, EDGE)


def test_potts_parts(spark):
    df = cliques(spark, 2, 6)
    for links in (10, 50_000):
        got = {r.title: r.community for r in communities.constant_potts(df, 0.5, links).collect()}
        assert got == {f"{k}{i}": f"{k}0" for k in "ab" for i in range(6)}
    # no part is denser than two: all are alone
    assert communities.constant_potts(df, 2.0).filter("title <> community").count() == 0
    assert communities.constant_potts(df.limit(0)).count() == 0


def test_repulsion_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 16, (60, 2))
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "node long, x double, y double")
    d = p[:, None] - p[None]
    d2 = np.maximum((d**2).sum(2), 1e-4)
    want = (d / d2[..., None]).sum(1)
    got = {r.node: (r.fx, r.fy) for r in layout._repulsion(at, 1.0, 4).collect()}
    have = np.array([got[i] for i in range(60)])
    assert np.linalg.norm(have - want) / np.linalg.norm(want) < 0.3


def test_forces_part_cliques(spark):
    rows = layout.force_layout(cliques(spark, 3), 15).collect()
    at = {r.title: np.array([r.x, r.y]) for r in rows}
    assert len(at) == 24 and np.isfinite(np.array(list(at.values()))).all()
    far = lambda same: np.mean([np.linalg.norm(at[a] - at[b]) for a, b in itertools.combinations(at, 2) if (a[0] == b[0]) == same])
    assert far(True) < 0.7 * far(False)


def test_viewer_document(spark, tmp_path):
    nodes = spark.createDataFrame([("a0", "T", "d")], "title string, type string, description string")
    n, links = layout.viewer_graph(nodes, cliques(spark, 2).withColumn("description", F.lit("why")), iterations=2)
    rows = {r["name"]: r for r in n.collect()}
    assert len(rows) == 16 and rows["a0"].data.texts[0].text == "TYPE: T\n\n\n d" and rows["a1"].data.color == rows["a0"].data.color != rows["b0"].data.color
    assert links.count() == 57 and {r.data.explanation for r in links.collect()} == {"why"} and max(r.source for r in links.collect()) < 16
    tables.save_graph(tables.graph_document(n, links), str(tmp_path / "g"))
    assert tables.read_graph(spark, str(tmp_path / "g"))[1].count() == 57
    with pytest.raises(ValueError):
        tables.save_graph(spark.createDataFrame([("{}",)], "value string"), str(tmp_path / "h"))
