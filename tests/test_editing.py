"""A viewer's edits and graph files: hand-computed cases and brute force."""

import json
import random
from datetime import datetime
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from grafloom.functions import text as T
from grafloom.operators import chunking, context, editing, graph, relational, reports, retrieval
from grafloom.plans import index
from grafloom.sources import graph_files, tables

NODES, TEXTS, LINKS = "id string, name string, color string, size long", "node string, pos long, id long, text string", "id string, ord long, source string, target string, explanation string"


def _graph(spark, nodes, texts=(), links=()):
    return editing.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(list(texts), TEXTS), spark.createDataFrame(list(links), LINKS))


def _picks(spark, rows):
    return spark.createDataFrame(rows, "group string, ord long, id string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _whole(path):
    """Parts in the order of their names, as one text."""
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_merging_keeps_the_first_and_its_order_of_texts(spark):
    g = _graph(
        spark, [("a", "A", None, None), ("b", "B", "red", 7), ("c", "C", "blue", 3), ("z", "Z", None, None)],
        [("a", 0, 2, "a2"), ("b", 0, 1, "b1"), ("b", 1, 2, "b2"), ("c", 0, 5, "c5"), ("c", 1, 5, "again"), ("z", 0, 1, "z1")],
        [("l1", 1, "a", "b", "inner"), ("l2", 2, "z", "c", "second"), ("l3", 3, "z", "b", "third"), ("l4", 4, "c", "z", "back"), ("l5", 5, "b", "b", "loop"), ("l6", 6, "z", "z", "own loop")],
    )
    m = editing.merge_nodes(g, _picks(spark, [("g", 2, "a"), ("g", 1, "c"), ("g", 3, "b"), ("g", 0, "absent"), ("h", 0, "z"), ("h", 1, "gone"), ("h", 2, None)]))
    assert _rows(m.nodes) == [("c", "C", "blue", 7), ("z", "Z", None, None)]
    assert _rows(m.texts) == [("c", 0, 5, "c5"), ("c", 1, 2, "a2"), ("c", 2, 1, "b1"), ("z", 0, 1, "z1")]
    assert _rows(m.links.select("id", "source", "target", "explanation")) == [("l2", "z", "c", "second"), ("l4", "c", "z", "back"), ("l6", "z", "z", "own loop")]


def test_merged_colour_and_size_have_defaults_and_other_columns_stay(spark):
    g = _graph(spark, [("a", None, None, None), ("b", "B", "red", None)])
    g = editing.Graph(g.nodes.selectExpr("*", "'x' AS _first", "1 AS _id"), g.texts, g.links)
    m = editing.merge_nodes(g, _picks(spark, [("g", 1, "a"), ("g", 2, "b")])).nodes.drop("_first", "_id")
    assert _rows(m) == [("a", None, editing.LIGHT, 0)]


def test_merging_by_brute_force(spark):
    r = random.Random(3)
    ids = [f"n{i}" for i in range(30)]
    nodes = [(i, i.upper(), r.choice([None, "red"]), r.choice([None, 1, 5])) for i in ids]
    texts = [(r.choice(ids), p, r.randrange(4), f"t{p}") for p in range(80)]
    links = [(f"l{k}", k, r.choice(ids), r.choice(ids), None) for k in range(150)]
    picks = [(r.choice("gh"), k, i) for k, i in enumerate(r.sample(ids, 9))]
    to, place = {}, {i: k for _, k, i in picks}
    for name in "gh":
        group = [i for n, _, i in picks if n == name]
        to |= {i: group[0] for i in group} if len(group) > 1 else {}
    want_links, seen = [], set()
    for k, _, s, t, _ in links:
        if not (s in to and t in to and to[s] == to[t]) and (to.get(s, s), to.get(t, t)) not in seen:
            seen.add((to.get(s, s), to.get(t, t)))
            want_links.append((k, to.get(s, s), to.get(t, t)))
    want_texts = []
    for i in ids:
        if i not in to:
            want_texts += [(i, x[3]) for x in texts if x[0] == i]
        elif to[i] == i:
            met = set()
            for x in sorted((x for x in texts if to.get(x[0]) == i), key=lambda x: (place[x[0]], x[1])):
                if x[2] not in met:
                    met.add(x[2])
                    want_texts.append((i, x[3]))
    m = editing.merge_nodes(_graph(spark, nodes, texts, links), _picks(spark, picks))
    assert _rows(m.links.select("id", "source", "target")) == sorted(want_links)
    assert [tuple(x) for x in m.texts.orderBy("node", "pos").select("node", "text").collect()] == sorted(want_texts, key=lambda x: x[0])
    assert m.nodes.count() == 30 - len(to) + len(set(to.values()))


def test_edits_of_names_texts_colours_and_links(spark):
    g = _graph(spark, [("a", "A", "red", None), ("b", "B", None, 2), ("c", "C", "blue", None)], [("a", 0, 1, "x"), ("b", 0, 1, "y")], [("l", 1, "a", "b", "why")])
    g2 = editing.recolour_nodes(g, _picks(spark, [("g", 1, "a"), ("g", 2, "b"), ("h", 1, "c")]))
    assert _rows(g2.nodes) == [("a", "A", "red", 0), ("b", "B", "red", 2), ("c", "C", "blue", None)]
    named = editing.rename_nodes(g, spark.createDataFrame([(1, "a", "first"), (2, "a", "last"), (1, "none", "x"), (3, "b", None)], "ord long, id string, name string"))
    assert _rows(named.nodes.select("id", "name")) == [("a", "last"), ("b", None), ("c", "C")]
    said = editing.edit_texts(g, spark.createDataFrame([(1, "a", 1, "new"), (1, "b", 9, "none")], "ord long, node string, id long, text string"))
    assert _rows(said.texts.select("node", "text")) == [("a", "new"), ("b", "y")]
    told = editing.explain_links(g, spark.createDataFrame([(1, "l", "so")], "ord long, id string, explanation string"))
    assert told.links.first().explanation == "so" and _rows(told.nodes) == _rows(g.nodes)


def test_empty_graphs_and_empty_edits(spark):
    g, none = _graph(spark, []), _picks(spark, [])
    assert [d.count() for d in (lambda m: (m.nodes, m.texts, m.links))(editing.merge_nodes(g, _picks(spark, [("g", 1, "a"), ("g", 2, "b")])))] == [0, 0, 0]
    one = _graph(spark, [("a", "A", None, None)], [("a", 0, 1, "t")], [("l", 1, "a", "a", "e")])
    m = editing.recolour_nodes(editing.merge_nodes(one, none), none)
    assert [_rows(x) for x in (m.nodes, m.texts, m.links)] == [_rows(x) for x in (one.nodes, one.texts, one.links)]


def test_graphml_is_a_valid_document_and_comes_back_with_types(spark, tmp_path):
    nodes = spark.createDataFrame([('a "<&>\n', "x & y\x01", 1, 0.5, True), ("b", "", None, None, None), ("c", None, 2**40, -1e300, False)], "title string, description string, n long, x double, ok boolean")
    edges = spark.createDataFrame([('a "<&>\n', "b", 2), ("b", "c", None), ("b", "c", 3)], "source string, target string, weight int")
    graph_files.save_graphml(nodes, edges, str(tmp_path / "g"), directed=True)
    root = ElementTree.fromstring(_whole(tmp_path / "g"))
    x = "{http://graphml.graphdrawing.org/xmlns}"
    assert root.find(f"{x}graph").get("edgedefault") == "directed" and [n.get("id") for n in root.iter(f"{x}node")] == ['a "<&>\n', "b", "c"]
    assert {k.get("attr.name"): k.get("attr.type") for k in root.iter(f"{x}key")} == {"description": "string", "n": "long", "x": "double", "ok": "boolean", "weight": "int"}
    n, e = graph_files.load_graphml(spark, str(tmp_path / "g"))
    assert _rows(n) == _rows(nodes.replace("x & y\x01", "x & y ")) and dict(n.dtypes) == dict(nodes.dtypes)
    assert _rows(e) == _rows(edges) and dict(e.dtypes) == dict(edges.dtypes)


def test_graphml_of_many_parts_comes_back_whole(spark, tmp_path):
    nodes = spark.range(300).select(F.concat(F.lit("n"), "id").alias("title"), F.lit("<node>").alias("name"))
    edges = spark.range(300).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") % 7).alias("target"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many parts as a larger graph has
    try:
        graph_files.save_graphml(nodes, edges, str(tmp_path / "g"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "g").glob("part-*"))) > 2
    n, e = graph_files.load_graphml(spark, str(tmp_path / "g"))
    assert _rows(n) == _rows(nodes) and _rows(e) == _rows(edges)


def test_graphml_of_another_writer(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="label" attr.type="string"><default>none</default></key>'
        '<key id="d1" for="all" attr.name="w" attr.type="double"/>\n<graph edgedefault="undirected"><node id="1"/><node id="2">\n <data key="d0">two</data>\n <data key="d1"> 2.5 </data></node>'
        '<edge source="1" target="2"><data key="d1">no number</data></edge></graph></graphml>'
    )
    n, e = graph_files.load_graphml(spark, str(tmp_path / "g.graphml"))
    assert _rows(n) == [("1", "none", None), ("2", "two", 2.5)] and _rows(e) == [("1", "2", None)]


def test_graphml_refuses_nested_columns_and_takes_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "source string, target string")
    with pytest.raises(ValueError, match="no GraphML type"):
        graph_files.save_graphml(spark.createDataFrame([("a", [1])], "title string, xs array<int>"), none, str(tmp_path / "g"))
    graph_files.save_graphml(spark.createDataFrame([], "title string"), none, str(tmp_path / "h"))
    assert ElementTree.fromstring(_whole(tmp_path / "h")) is not None
    assert [df.count() for df in graph_files.load_graphml(spark, str(tmp_path / "h"))] == [0, 0]


def test_documents_are_json_and_come_back(spark, tmp_path):
    nodes = spark.createDataFrame([("b", [("t", 1)], "}]"), ("a", None, "line\n],\"links\":["), ("c", [], None)], "id string, texts array<struct<text: string, id: int>>, name string")
    links = spark.createDataFrame([("a", "b", "w"), ("a", "b", "w"), ("b", "c", None)], "source string, target string, id string")
    path = graph_files.save_document(nodes, links, str(tmp_path), "city", datetime(2021, 3, 4, 5, 6))
    assert path.endswith("city_20210304_0506") and _whole(f"{path}/rep.json").strip() == "{}"
    doc = json.loads(_whole(f"{path}/graph.json"))
    assert [n["id"] for n in doc["nodes"]] == ["a", "b", "c"] and len(doc["links"]) == 3 and doc["nodes"][0]["name"] == 'line\n],"links":['
    n, e = graph_files.load_document(spark, f"{path}/graph.json", nodes.schema.simpleString(), links.schema.simpleString())
    assert _rows(n) == _rows(nodes) and _rows(e) == _rows(links)
    empty = graph_files.save_document(nodes.limit(0), links.limit(0), str(tmp_path), "none", datetime(2021, 3, 4, 5, 6))
    assert json.loads(_whole(f"{empty}/graph.json")) == {"nodes": [], "links": []}


def test_documents_without_ids_are_refused(spark, tmp_path):
    links = spark.createDataFrame([("a", "b")], "source string, target string")
    with pytest.raises(Exception, match="no node and no link"):
        graph_files.save_document(spark.createDataFrame([(None, "x")], "id string, name string"), links, str(tmp_path), "bad")


def test_uuids_have_version_and_variant(spark):
    ids = [r[0] for r in spark.range(200).select(T.uuid4_hex("id", seed=7)).collect()]
    assert len(set(ids)) == 200 and all(len(i) == 32 and i[12] == "4" and i[16] in "89ab" for i in ids) and {i[16] for i in ids} == set("89ab")


def test_ranked_relationships_by_each_kind(spark):
    e = spark.createDataFrame([("a", "b", 1.0, {"r": "2"}), ("b", "c", None, {"r": "10"}), ("c", "d", 3.0, {})], "source string, target string, weight double, attributes map<string,string>")
    ents = spark.createDataFrame([("a", 5), ("b", None), ("d", 9), ("d", 8)], "title string, rank int")
    of = lambda by, rows=e: [(r.source, r.order_value) for r in retrieval.ranked_relationships(rows, ents, by).collect()]
    assert of("r") == [("b", 10.0), ("a", 2.0), ("c", 0.0)] and of("weight") == [("c", 3.0), ("a", 1.0), ("b", 0.0)]
    assert of("rank") == [("c", 9.0), ("a", 5.0), ("b", 0.0)] and of("rank", e.drop("attributes")) == of("rank")
    assert of("rank", e.selectExpr("*", "length(source) + weight AS rank"))[0] == ("c", 4.0)


def test_aggregation_without_keys_and_lists_in_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 3, None)], "k string, o int, v string")
    rules = [{"column": "v", "operation": "string_concat", "to": "s"}, {"column": "v", "operation": "array_agg", "to": "l"}, {"column": "v", "operation": "last", "to": "z"}, {"column": "o", "operation": "sum", "to": "n"}]
    assert [tuple(r) for r in relational.aggregate(df, rules, order=("o",)).collect()] == [("a,b", ["a", "b"], None, 6)]
    assert _rows(relational.aggregate(df, rules, ("k",), ("o",))) == [("j", "", [], None, 3), ("k", "a,b", ["a", "b"], "b", 3)]


def test_texts_split_and_strategies(spark):
    df = spark.createDataFrame([("a b c d e", ["a b", None, "c"]), ("", []), (None, None)], "t string, l array<string>")
    got = [tuple(r) for r in df.select(chunking.split_text("t", 3, 1), chunking.split_list("l", 2, 0)).collect()]
    assert got == [(["a b c", "c d e", "e"], ["a b", "c"]), ([], []), ([], [])]
    docs = spark.createDataFrame([(1, "One. Two! One. "), (2, None)], "id long, text string")
    u = chunking.text_units(docs, "sentence")
    assert sorted(r.text for r in u.collect()) == ["One.", "Two!"] and dict(u.dtypes) == dict(chunking.text_units(docs).dtypes)
    with pytest.raises(ValueError, match="unknown strategy"):
        chunking.text_units(docs, "pages")
    t = index.build_index(docs.withColumn("title", docs.id.cast("string")), tables.TableStore(spark), index.Config(chunks="sentence"), ["text_units"])["text_units"]
    assert t.count() == 2


def test_sentences_that_begin_with_a_digit_are_whole(spark):
    text = " ".join(f"{i}{i} is {i}." for i in range(30)) + " \xa0Wide.  \xa0!"
    u = chunking.sentence_units(spark.createDataFrame([(1, text)], "id long, text string"))
    assert [r.chunk for r in u.orderBy("ordinal").collect()] == [*(f"{i}{i} is {i}." for i in range(30)), "Wide.", "!"]


def test_facts_of_nodes_and_levelled_edges(spark):
    nodes = spark.createDataFrame([(0, "x", "a"), (0, "x", "b"), (0, None, "z"), (1, "y", "a"), (0, "x", "lone")], "level int, community string, title string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "a")], "id string, source string, target string")
    claims = spark.createDataFrame([("q", "b"), ("r", None)], "id string, subject string")
    rows = _rows(reports.node_facts(nodes, edges, claims).select("level", "title", "kind", "fact"))
    assert rows == sorted([(0, "a", "edge", "e1"), (0, "a", "edge", "e2"), (0, "b", "claim", "q"), (0, "b", "edge", "e1"), (0, "lone", None, None), (1, "a", "edge", "e1"), (1, "a", "edge", "e2")], key=repr)
    out = graph.clustered_edges(edges.drop("id"), nodes).collect()
    assert sorted((r.level, r.human_readable_id, r.target) for r in out) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "b")] and len({r.id for r in out}) == 4


def test_nearest_among_some(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, vector array<double>")
    some = spark.createDataFrame([(4,), (5,), (4,)], "id long")
    of = lambda include: [r.id for r in retrieval.nearest(v, [0.0, 0.0], 3, include=include).collect()]
    assert of(some) == [4, 5] and of([]) == [0, 1, 2] and of([3, 5]) == [3, 5] and of(None) == [0, 1, 2]


def _mixed(parts, budget):
    """The largest give way one by one, all put together again each time."""
    order, size = sorted(parts, key=lambda p: (-p[2], p[0])), lambda s: len(s.split())
    for done in range(len(order) + 1):
        text = "\n\n".join([p[3] for p in order[:done] if p[3]] + [p[1] for p in order[done:] if p[1]])
        if size(text) <= budget:
            return text
    out = []
    for p in order:
        if p[3] and size("\n\n".join([*out, p[3]])) <= budget:
            out.append(p[3])
    return "\n\n".join(out)


def test_mixed_contexts_by_brute_force(spark):
    r = random.Random(5)
    words = lambda most: " ".join(r.choice("abc") for _ in range(r.randrange(most)))
    parts = {f"p{k}": [(f"s{i}", words(12), r.randrange(5), words(7) or None) for i in range(r.randrange(1, 7))] for k in range(60)}
    df = spark.createDataFrame([(c, *p) for c, ps in parts.items() for p in ps], "community string, id string, context string, size int, report string")
    for budget in (0, 4, 11, 30):
        got = {x.community: x.context_string for x in context.mixed_contexts(df, budget).collect()}
        assert got == {c: _mixed([(i, t, n, p or "") for i, t, n, p in ps], budget) for c, ps in parts.items()}
    assert context.mixed_contexts(df.limit(0), 4).count() == 0
