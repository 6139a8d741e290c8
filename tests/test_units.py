"""Hand-computed cases of the library's operators."""

import collections

import pytest
from pyspark.sql import Window, functions as F

from grafloom.functions import parsers, text as T
from grafloom.operators import chunking, context, communities, graph, models, relational, reports, retrieval, search
from grafloom.plans import catalogue, index
from grafloom.sources import documents, prompt_cache, tables
from grafloom.streaming import incremental


def test_parse_graph_records(spark):
    a = '("entity"<|>Ann<|>PERSON<|>a)##("relationship"<|>Ann<|>Bob<|>r<|>2)##("relationship"<|>Bob<|>Ann<|>r2<|>x)##("entity"<|>short)<|COMPLETE|>'
    ents, rels = parsers.graph_records(spark.createDataFrame([("u", a)], "id string, answer string"), "id")
    assert {(r.title, r.type) for r in ents.collect()} == {("ANN", "PERSON"), ("BOB", "")}
    nodes, edges = models.merge_extracted(ents, rels)
    e = edges.collect()
    assert len(e) == 1 and e[0].weight == 3.0 and e[0].description == "r\nr2"


def test_parse_claims(spark):
    r = parsers.claim_records(spark.createDataFrame([("u", "(A<|>B<|>T)##<|COMPLETE|>")], "id string, answer string")).collect()
    assert len(r) == 1 and (r[0].subject_id, r[0].type, r[0].status) == ("A", "T", None)


def test_points(spark):
    rows = [('{"points":[{"description":"a","score":3}]}',), ("```json\n{\"points\":[{\"description\":\"b\",\"score\":\"4\"}]}\n```",), ("nonsense",), (None,)]
    got = [[(p.description, p.score) for p in r[0]] for r in spark.createDataFrame(rows, "a string").select(T.points("a")).collect()]
    assert got == [[("a", 3)], [("b", 4)], [("", 0)], [("", 0)]]


def test_scalars(spark):
    df = spark.createDataFrame([("a,b", " x &amp;\x07y ", "{n}!"), ("", None, "")], "l string, t string, p string")
    r = df.select(T.split_list("l"), T.clean("t"), T.node_name("t"), T.fill_placeholders("p", n="1"), T.rank_value(F.lit("bad")), T.token_count("t"), T.fits("t", 1), T.is_uuid(F.lit("nope")), T.strip_citations(F.lit("a [Data: x] b ]c"))).collect()
    assert r[0][0] == ["a", "b"] and r[1][0] == [] and r[0][1] == "x &y" and r[1][1] is None
    assert r[0][3] == "1!" and r[0][4] == -1.0 and r[1][5] == 0 and r[1][6] == 1 and r[0][7] is False and r[0][8] == "a c"


def test_merge_fold(spark):
    df = spark.createDataFrame([("k", 1, 2.0), ("k", 2, None), ("k", 3, 4.0), ("k", 4, 0.0)], "k string, o int, v double")
    got = {op: df.groupBy("k").agg(graph.merge_attribute(op, "v", "o")).first()[1] for op in ("sum", "average", "multiply", "max", "min", "replace", "skip")}
    assert got["sum"] == 6.0 and got["multiply"] == 8.0 and got["max"] == 4.0 and got["min"] == 0.0
    assert got["average"] == ((2.0 + 0) / 2 + 4.0) / 2 / 2 and got["skip"] == 2.0 and got["replace"] == 0.0


def test_windows(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, "f")], "id long, text string")
    u = chunking.base_text_units(d, 3, 1).orderBy("group_id", "start").collect()
    assert [(r.group_id, r.chunk, r.n_tokens) for r in u] == [(1, "a b c", 3), (1, "c d e", 3), (1, "e", 1), (4, "f", 1)]
    both = chunking.base_text_units(d.withColumn("g", F.lit(0)), 4, 0, ("g",)).orderBy("start").collect()
    assert [r.chunk for r in both] == ["a b c d", "e f"] and both[1].document_ids == ["1", "4"]
    with pytest.raises(ValueError):
        chunking.token_windows(F.col("x"), 3, 3)


def test_pack_and_batches(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [5, 1, 1, 2])], "i array<string>, s array<int>")
    assert df.select(chunking.pack_list(F.col("i"), F.col("s"), 3)).first()[0] == [["b", "c"], ["d"]]
    assert df.select(chunking.batched(F.col("i"), 3)).first()[0] == [["a", "b", "c"], ["d"]]


def test_null_aware_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (None, 20)], "k int, w int")
    assert {(r.k, r.w) for r in relational.join(a, b, "k").collect()} == {(1, 10), (None, 20), (2, None)}
    assert [r.v for r in relational.antijoin(a, b, "k").collect()] == ["z"]
    with pytest.raises(KeyError):
        relational.drop_columns(a, "nope")


def test_components_and_degree(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "source string, target string")
    assert {r.title: r.component for r in graph.connected_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert {r.title: r.degree for r in graph.degrees(e).collect()}["z"] == 2
    assert {(r.source, r.target) for r in graph.largest_component(e).collect()} == {("a", "b"), ("b", "c")}


def test_clusters_split_cliques(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0)]
    edges = spark.createDataFrame(e, "source string, target string, weight double")
    top = communities.hierarchical_leiden(edges, max_size=10).filter("level = 0")
    assert graph.modularity(edges, top.select("title", "community")) > 0.3


def _divided(edges, levels, spark):
    rows = communities.hierarchical_leiden(spark.createDataFrame(edges, "source string, target string, weight double"), max_size=2).collect()
    size, at = collections.Counter((r.level, r.community) for r in rows), {(r.level, r.title): r for r in rows}
    assert len({r.level for r in rows}) >= levels
    assert {r.title for r in rows if r.level == 0} == {x for s, t, _ in edges for x in (s, t)}
    for r in rows:
        assert (size[r.level, r.community] > 2) == ((r.level + 1, r.title) in at)
        assert not r.level or at[r.level - 1, r.title].community == r.parent


def test_clusters_cut_what_moves_leave_whole(spark):
    _divided([(f"c{i}", f"c{j}", 1.0) for i in range(9) for j in range(i)] + [("s", f"s{i}", 1.0) for i in range(9)], 2, spark)


def test_every_edge_is_clustered(spark):
    d = "/root/testdata/sf0.001"
    got = {r.title for r in catalogue.hierarchical_clusters(spark, d).select("title").distinct().collect()}
    assert got == {r.title for r in catalogue.edges(spark, d).select(F.explode(F.array("source", "target")).alias("title")).distinct().collect()}


def test_hierarchy(spark):
    rows = [(0, "p", f"n{i}") for i in range(12)] + [(1, f"c{i // 6}", f"n{i}") for i in range(12)]
    got = reports.community_hierarchy(spark.createDataFrame(rows, "level int, community string, title string")).collect()
    assert {(r.community, r.sub_community, r.sub_community_size) for r in got} == {("p", "c0", 6), ("p", "c1", 6)}


def test_sort_context(spark):
    nodes = {"A": (0, "first"), "B": (1, None), "C": (2, "c")}
    edges = [("1", "A", "B", "ab", 5), ("2", "B", "C", "bc", 9)]
    whole = context.sort_context(edges, nodes, {"C": [("k", "C", "claim")]}, None)
    assert whole.index("2,B,C") < whole.index("1,A,B") and "0,A,first" in whole and "k,C,claim" in whole
    assert "1,A,B" not in context.sort_context(edges, nodes, {}, 8)
    assert context.sort_context([], nodes, {}, 100) == "" and context.sort_context(edges, nodes, {}, 1) == ""
    parts = spark.createDataFrame([("p", "a", "x x x", 3, "r"), ("p", "b", "y", 1, "s")], "community string, id string, context string, size int, report string")
    assert context.mixed_contexts(parts, 2).first().context_string == "r\n\ny"


def test_report_loop(spark):
    nodes = spark.createDataFrame([("A", 0, "p", "0", "d"), ("B", 0, "p", "1", "d"), ("A", 1, "c", "0", "d"), ("B", 1, "c", "1", "d")], "title string, level int, community string, id string, description string")
    edges = spark.createDataFrame([("e", "A", "B", "d", 2, 1.0)], "id string, source string, target string, description string, rank int, weight double")
    got = reports.report_loop(nodes, edges, None, lambda df: df.select("community", F.lit("short").alias("report")), budget=5).collect()
    assert {(r.community, r.level) for r in got} == {("p", 0), ("c", 1)}


def test_conversation(spark):
    t = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 4, "user", "r")], "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answers) for r in context.qa_turns(t).orderBy("qa").collect()] == [("q", ["a", "b"]), ("r", [])]
    assert [r.question for r in context.conversation_context(t, 1, 100).collect()] == ["r"]


def test_vector_search(spark):
    v = spark.createDataFrame([("a", "A", 1, [1.0, 0.0]), ("b", "B", 9, [0.0, 1.0]), ("c", "C", 5, None)], "id string, title string, rank int, vector array<double>")
    assert retrieval.nearest(v, [0.9, 0.1], 1).first().id == "a"
    assert [r.title for r in retrieval.map_query_to_entities(v, None, 1).collect()] == ["B"]
    assert {r.title for r in retrieval.map_query_to_entities(v, [1.0, 0.0], 1, include=["C"], exclude=["B"]).collect()} == {"A", "C"}


def test_search_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"t{i}", f"Alpha meets Bravo{chr(97 + i)} and Charlie near Delta.") for i in range(4)], "id string, title string, text string")
    store = tables.TableStore(spark, str(tmp_path))
    made = index.build_index(docs, store)
    assert made["final_text_units"].count() == 4 and made["documents"].filter("size(text_unit_ids) = 1").count() == 4
    assert store.has("nodes") and made["communities"].count() > 0
    rep = made["community_reports"].select("community", "title", F.col("full_content").alias("content"), "rank")
    model = models.Canned({"JSON": '{"points":[{"description":"p","score":7}]}', "Combine": "done", "Answer from the tables": "local"})
    assert search.global_search("what?", rep, model).answer == "done"
    ents = models.embed(made["entities"].withColumn("text", F.col("name")), lambda ts: [models.hashing_embedder(t) for t in ts]).withColumnsRenamed({"name": "title", "embedding": "vector"})
    mentions = made["entities"].select(F.explode("text_unit_ids").alias("unit"), F.col("name").alias("title"))
    found = search.local_search("Alpha", {"entities": ents, "relationships": made["relationships"], "mentions": mentions, "units": made["final_text_units"].select(F.col("id").alias("unit"), F.col("text").alias("chunk"))}, models.hashing_embedder, model, k=2)
    assert found.answer == "local" and "ALPHA" in found.context and "-----Sources-----" in found.context


def test_summarize(spark):
    rows = spark.createDataFrame([("a", ""), ("b", "one"), ("c", "x\ny\nx")], "title string, description string")
    got = {r.title: r.description for r in models.summarize(rows, models.Canned({}, "merged")).collect()}
    assert got == {"a": "", "b": "one", "c": "merged"}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2024_a.txt").write_text("hello")
    (tmp_path / "in" / "b.md").write_text("other")
    got = documents.read_text(spark, str(tmp_path / "in"), r"(?P<year>\d+)_.*\.txt$").collect()
    assert [(r.year, r.text, r.title) for r in got] == [("2024", "hello", "2024_a.txt")]
    with pytest.raises(ValueError):
        documents.read_text(spark, str(tmp_path / "in"), r"none")
    assert documents.read_uploads(spark, str(tmp_path / "in")).count() == 2
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "x.csv").write_text("name,when\nA,2024-05-06\n")
    r = documents.read_csv(spark, str(tmp_path / "csv"), text="name", timestamp="when", timestamp_format="yyyy-MM-dd").first()
    assert (r.text, r.year, r.month, r.day) == ("A", 2024, 5, 6)


def test_store_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"])], "id string, l array<string>")
    tables.emit(df, str(tmp_path / "t"), ["parquet", "csv", "json"])
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).first().l == '["x"]'
    m = tables.TableStore(spark)
    m.set("t", df)
    assert m.has("t") and m.resolve(["t"], ["u"])["u"] is None
    with pytest.raises(KeyError):
        m.get("u")
    req = spark.createDataFrame([("k1", "p"), ("k2", "q"), ("k2", "q")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old")], "key string, result string")
    out, new = tables.through_cache(req, cache, lambda r: r.withColumn("result", F.lit("new")))
    assert sorted(r.result for r in out.collect()) == ["new", "new", "old"] and new.count() == 1


def test_prompt_cache(spark):
    p = spark.createDataFrame([(1, "q", "g", "a"), (2, "q", "g", "b"), (3, "q", "g", "c")], "id long, prompt string, graph string, response string")
    n = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "prompt_id long, node string")
    assert prompt_cache.lookup(p, n, "q", ["y", "x"]) == "b" and prompt_cache.lookup(p, n, "q", []) == "c" and prompt_cache.lookup(p, n, "q", ["z"]) is None


def test_incremental(spark, tmp_path):
    old, new = (spark.createDataFrame(x, "id long, name string, description string") for x in ([(1, "A", "x")], [(2, "A", "y"), (3, "B", "z")]))
    ents, ids = incremental.resolve_entities(old, new)
    assert [(r.name, r.id, r.description) for r in ents.orderBy("name").collect()] == [("A", 1, "x\ny"), ("B", 3, "z")] and [tuple(r) for r in ids.collect()] == [(2, 1)]
    calls = []
    make = lambda: calls.append(1) or old
    incremental.resume(spark, str(tmp_path / "r"), make)
    assert incremental.resume(spark, str(tmp_path / "r"), make).count() == 1 and len(calls) == 1


def test_ids_of_a_name_of_many_rows_are_dealt(spark):
    old = spark.createDataFrame([(i, "A") for i in range(50)] + [(50, "B"), (51, None)], "id long, name string")
    new = spark.createDataFrame([(i, "A") for i in range(100, 400)] + [(400, "B"), (401, "B"), (402, "C"), (403, None)], "id long, name string")
    got = incremental.resolved_ids(old, new, block=20).cache()
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == 50 * 300 + 2 and set(pairs) == {(i, j) for i in range(100, 400) for j in range(50)} | {(400, 50), (401, 50)}
    spread = incremental.resolved_ids(old, new, block=20).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 0.8 * len(pairs)  # a name is not one task's


def test_answers_of_a_record_a_line(spark):
    a = '\n("entity"<|> Ann\n<|>PERSON<|>a)\n##\n\t("entity"<|>Bob<|>PERSON<|>b &amp; c)\r\n##\n("relationship"<|>Ann<|>Bob<|>knows<|>2 )\n##\n<|COMPLETE|>\n'
    ents, rels = parsers.graph_records(spark.createDataFrame([("u", a)], "id string, answer string"), "id")
    assert {r.title for r in ents.collect()} == {"ANN", "BOB"} and [(r.source, r.target, r.weight) for r in rels.collect()] == [("ANN", "BOB", 2.0)]
    r = spark.createDataFrame([("\n foo  \t",)], "t string").select(T.clean("t"), T.node_name("t")).first()
    assert tuple(r) == ("foo", "FOO")


def test_resume_needs_whole_tables(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path))
    (tmp_path / "t.parquet" / "_temporary").mkdir(parents=True)
    assert not store.has("t")
    store.set("t", spark.range(3))
    assert store.has("t") and store.get("t").count() == 3
    store.clear()
    assert not store.has("t")


def test_batches_of_a_null_key(spark):
    rows = spark.createDataFrame([(k, i, 3) for k in (1, None) for i in range(4)], "k int, i int, s int")
    got = {(r.by, r.id): r.batch for r in context.batches(rows, "k", "i", F.col("s"), 6).collect()}
    assert [got[1, i] for i in range(4)] == [0, 0, 1, 1] == [got[None, i] for i in range(4)]


def test_prefix_over_ranges(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3)).repartition(7)
    got = context.greedy_prefix(rows, F.lit(2), 101, [F.desc("id")], ["k"], 1)
    assert collections.Counter(r.k for r in got.collect()) == {None: 50, 1: 50, 2: 50} and got.filter("k = 1").agg(F.max("id"), F.max("used")).first()[:] == (997, 101)
    assert context.greedy_prefix(rows, F.lit(2), 10, [F.col("id")]).count() == 5


def test_contexts_are_csv():
    nodes = {"A": (1, 'says "x", twice'), "B": (2, "plain\nline")}
    text = context.sort_context([(9, "A", "B", "a,b", 3)], nodes, {"A": [(5, "A", "c,d")]}, None)
    assert '1,A,"says ""x"", twice"' in text and '2,B,"plain\nline"' in text and '9,A,B,"a,b",3' in text and '5,A,"c,d"' in text
    many = [(i, "A", "B", f"edge {i}", 10 - i) for i in range(10)]
    cut = context.sort_context(many, nodes, {}, 20)
    assert 0 < cut.count("edge") < 10 and len(cut.split()) <= 20 and context.sort_context(many, nodes, {}, 1) == ""


def test_json_repair(spark):
    from grafloom.functions import repair

    cases = {'{"a":1}': '{"a":1}', 'x {"a": 1,} y': '{"a": 1}', '{a: 1, \'b\': \'c\'}': '{"a": 1, "b": "c"}', '{"a": [1, 2': '{"a": [1, 2]}', "none": "{}", '```json\n{"a":"b\nc"}\n```': '{"a":"b c"}', "[1]": "{}"}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string").select("a", repair.json_object("a").alias("r")).collect()
    assert {r.a: r.r for r in rows} == cases | {None: "{}"}


def test_selections(spark):
    from grafloom.operators import readers, selection

    e = spark.createDataFrame([("1", "A", 3, [0.0, 1.0], ["u"], ["7"]), ("2", "B", 9, [0.0, 1.1], ["v"], ["8"]), ("3", "C", 5, [9.0, 9.0], ["v"], []), ("4", "D", 1, None, [], [])], "id string, title string, rank int, vector array<double>, text_unit_ids array<string>, community_ids array<string>")
    assert [r.title for r in selection.neighbours_by_embedding(e, "A", 1).collect()] == ["B"] and selection.neighbours_by_embedding(e, "D").count() == 0
    assert [r.id for r in selection.candidate_units(e.filter("id = '1'"), spark.createDataFrame([("u",), ("v",)], "id string")).collect()] == ["u"]
    assert selection.candidate_reports(e, spark.createDataFrame([(7,), (9,)], "community int")).count() == 1
    assert selection.by_key(e, "id", "2").first().title == "B" and selection.by_name(e, "C").count() == 1 and selection.name_search(e, "  ").count() == 0
    dashed = "12345678-1234-1234-1234-123456789abc"
    assert selection.by_key(spark.createDataFrame([(dashed.replace("-", ""),)], "id string"), "id", dashed).count() == 1
    first = selection.first_values(spark.createDataFrame([("k", 1, None, "x"), ("k", 2, "a", None)], "k string, o int, a string, b string"), ["k"], [F.col("o")]).first()
    assert (first.a, first.b) == ("a", "x")
    texts = spark.createDataFrame([(str(i), f"t{i}") for i in range(9)], "id string, text string")
    assert [r.id for r in selection.sample(texts, "top", 2).collect()] == ["0", "1"] and selection.sample(texts, "random", 4).count() == 4
    embed = lambda df: df.withColumn("vector", F.array(F.col("id").cast("double")))
    assert {r.id for r in selection.sample(texts, "auto", k=1, embed=embed).collect()} == {"4"}
    assert selection.context_records({"entities": e})["claims"] == []
    read = readers.read_objects(e, "entity", attributes=["rank"]).orderBy("id").first()
    assert read.short_id == "0" and read.attributes == {"rank": "3"} and read.description is None
    with pytest.raises(KeyError):
        readers.read_objects(e.drop("title"), "entity")


def test_tuning(spark):
    from grafloom.operators import tuning

    assert tuning.pack_examples([("a b", "c")] * 5, 14, least=1).count("Example") == 2
    docs = spark.createDataFrame([(1, "some words here {domain}")], "id long, text string")
    client = models.Canned({"Name the field": "law", "Name the language": "English", "Describe an expert": "a judge", "List the types": "court, law ", "Answer in English. List": "(x)"}, "told")
    p = tuning.tune(docs, client)
    assert "types court, law" in p.extraction and "(x)" in p.extraction and "{text}" in p.extraction and "{context}" in p.reports


def test_graphml_and_graph_documents(spark, tmp_path):
    nodes = spark.createDataFrame([('a "<&', "x & y"), ("b", "z")], "title string, description string")
    links = spark.createDataFrame([('a "<&', "b", 2)], "source string, target string, weight int")
    graph.to_graphml(nodes, links).select("xml").write.text(str(tmp_path / "g"))
    n, e = tables.read_graphml(spark, str(tmp_path / "g"))
    assert {(r.title, r.data["description"]) for r in n.collect()} == {('a "<&', "x & y"), ("b", "z")} and e.first().data == {"weight": "2"}
    tables.save_graph(tables.graph_document(nodes, links), str(tmp_path / "doc"))
    n, e = tables.read_graph(spark, str(tmp_path / "doc"))
    assert n.count() == 2 and e.first().weight == 2
    with pytest.raises(ValueError):
        tables.save_graph(spark.createDataFrame([("[]",)], "value string"), str(tmp_path / "bad"))


def test_index_with_claims_embeddings_and_update(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one", "Alpha meets Beta here. Alpha knows Gamma."), (2, "two", "Beta meets Delta there.")], "id long, title string, text string")
    client = models.Canned({"List claims": "(ALPHA<|>BETA<|>MET<|>TRUE<|>NONE<|>NONE<|>they met)", "List entities": '("entity"<|>Alpha<|>PERSON<|>a)\n##\n("entity"<|>Beta<|>PERSON<|>b)\n##\n("relationship"<|>Alpha<|>Beta<|>met<|>2)', "Write a report": '{"title": "T", "summary": "S", "rating": 3, "findings": [],}'}, "x")
    seen = index.Statistics()
    config = index.Config(client=client, claims="meetings", gleanings=0, embedder=lambda ts: [models.hashing_embedder(t) for t in ts], callbacks=(seen,))
    store = tables.TableStore(spark, str(tmp_path))
    t = index.build_index(docs.filter("id = 1"), store, config)
    c = t["covariates"].collect()
    assert [(r.subject_id, r.human_readable_id, r.description) for r in c] == [("ALPHA", "1", "they met")] and tuple(t["covariates"].columns) == index.CLAIM_COLUMNS
    assert len(t["entities"].first().vector) == 64 and t["community_reports"].count() > 0 and len(t["community_reports"].first().full_content_embedding) == 64
    assert set(seen.tables) == set(index.STEPS)
    seen.write(store)
    r = t["community_reports"].first()
    assert (r.title, r.summary, r.rank, r.findings) == ("T", "S", 3.0, []) and r.full_content.startswith("# T") and '"rating":"3"' in r.full_content_json
    from grafloom.operators import readers

    assert readers.reports(t, 0, min_rank=3).count() > 0 and readers.reports(t, 0, min_rank=4).count() == 0
    found = search.local_engine(t, models.hashing_embedder, lambda p: p)("Alpha meets")
    assert "-----Claims-----" in found.context and "they met" in found.context
    assert search.global_engine(t, models.Canned({"Answer from the reports": '{"points": [{"description": "d", "score": 5}]}'}, "done"))("q").answer == "done"
    merged = index.update_index(docs, store, config)
    assert {r.title for r in merged["documents"].collect()} == {"one", "two"}
    both = {r.name: r for r in merged["entities"].collect()}
    assert set(both) == {"ALPHA", "BETA"} and len(both["ALPHA"].text_unit_ids) == 2
    assert merged["relationships"].first().weight == 2 * t["relationships"].first().weight
    assert all(set(r.entity_ids) == {both["ALPHA"].id, both["BETA"].id} for r in merged["final_text_units"].collect())
    assert merged["nodes"].groupBy("level", "title").count().filter("count > 1").count() == 0 and merged["community_reports"].groupBy("community").count().filter("count > 1").count() == 0
    assert [r.human_readable_id for r in merged["covariates"].orderBy("human_readable_id").collect()] == ["1", "2"]


def counting(folder, answers):
    """A client that leaves a file for each call."""
    folder, client = str(folder), models.Canned(answers, "x")

    def call(prompt):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return client(prompt)

    return call


@pytest.mark.parametrize("kept", [True, False])
def test_each_prompt_is_asked_once(spark, tmp_path, kept):
    docs = spark.createDataFrame([(i, f"t{i}", f"Text number {i}.") for i in range(3)], "id long, title string, text string")
    (tmp_path / "calls").mkdir()
    calls = lambda: len(list((tmp_path / "calls").iterdir()))
    entity = '("entity"<|>Alpha<|>PERSON<|>a)\n##\n("relationship"<|>Alpha<|>Beta<|>met<|>2)'
    client = counting(tmp_path / "calls", {"List entities": entity, "List claims": "(A<|>B<|>C)", "Write a report": '{"title": "T", "rating": 1, "findings": []}'})
    store = tables.TableStore(spark, str(tmp_path / "index") if kept else None)
    t = index.build_index(docs, store, index.Config(client=client, claims="any"))
    for df in t.values():
        df.count()
    n = t["community_reports"].count()
    # units and claims are asked twice each, as one gleaning is set, and communities once
    assert calls() == 3 * 2 + 3 * 2 + n and n > 0
    assert t["entities"].count() == 2
    more = docs.unionAll(spark.createDataFrame([(9, "t9", "Text number 9.")], docs.schema))
    before = calls()
    merged = index.update_index(more, store, index.Config(client=client, claims="any"))
    for df in merged.values():
        df.count()
    assert calls() == before + 2 + 2 + merged["community_reports"].count()


def test_answers_are_kept_in_a_cache(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client = counting(tmp_path / "calls", {})
    kept = tables.cache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, prompt string")
    for _ in range(2):
        assert models.ask(rows, "prompt", "answer", client, kept).filter("answer = 'x'").count() == 3
    assert len(list((tmp_path / "calls").iterdir())) == 2


def test_communities_far_from_a_change_stay(spark):
    block = lambda k: [(f"{k}{i}", f"{k}{j}", 1.0) for i in range(6) for j in range(i)]
    edge = "source string, target string, weight double"
    chain = [("a0", "b0", 1.0), ("b1", "c0", 1.0)]
    before = spark.createDataFrame([*block("a"), *block("b"), *block("c"), *chain], edge)
    nodes = communities.hierarchical_leiden(before).select("level", "title", "community")
    after = before.unionAll(spark.createDataFrame([("c1", "d0", 1.0), ("d0", "d1", 1.0), ("d1", "d2", 1.0), ("d0", "d2", 1.0), ("c2", "c1", 1.0)], edge))
    got, opened = incremental.update_communities(nodes, before, after)
    assert {r.title[0] for r in opened.collect()} == {"c", "d"}
    old = {(r.level, r.title): r.community for r in nodes.collect()}
    new = {(r.level, r.title): r.community for r in got.collect()}
    assert all(new[k] == v for k, v in old.items() if k[1][0] in "ab") and {k[1] for k in new if k[0] == 0} == {f"{k}{i}" for k in "abc" for i in range(6)} | {"d0", "d1", "d2"}
    assert new[0, "d1"] == new[0, "d2"] != new[0, "c3"]
    rows = communities.invariants(after, got.withColumn("parent", F.when(F.col("level") > 0, F.lit("?")))).collect()
    assert all(r.once and r.small and r.connected for r in rows)


@pytest.mark.parametrize("block", [1, 3, 7, 50])
def test_batches_in_blocks_are_those_of_the_fold(spark, block):
    import random

    r = random.Random(block)
    rows = [(k, i * 3, r.choice(sizes)) for k, sizes in (("a", [0, 1, 2, 5]), ("b", [0, 0, 0, 9, 30]), ("c", [1]), ("d", [0]), (None, [3, 4]), ("e", [11, 25, 1])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, s long").repartition(5)
    for budget in (1, 10, 24):
        want, at = {}, {}
        for k, i, s in rows:
            batch, used = at.get(k, (0, 0))
            if used > 0 and used + s > budget:
                batch, used = batch + 1, 0
            at[k] = (batch, used + s)
            want[k, i] = batch
        assert {(x.by, x.id): x.batch for x in context.batches(df, "k", "i", F.col("s"), budget, block).collect()} == want


def test_limits_hold_over_all_tasks(spark, tmp_path):
    folder = str(tmp_path)

    def client(prompt):
        import time
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(time.time()))
        return "one two three four"

    rows = spark.range(24).select(F.col("id").cast("string").alias("prompt"))
    for limit in ({"per_minute": 600}, {"tokens_per_minute": 3000}):  # ten calls a second, of five tokens each
        limited = models.Limited(client, tasks=3, **limit)
        answers = models.ask(rows, "prompt", "answer", limited)
        assert answers.filter("answer = 'one two three four'").count() == 24 and answers.rdd.getNumPartitions() <= 3
        at = sorted(float(p.read_text()) for p in tmp_path.iterdir())
        # a task's first call is free; beyond, the whole job keeps to the rate in any window of a second
        assert len(at) == 24 and all(sum(a <= b < a + 1 for b in at) <= 10 + 3 + 1 for a in at) and at[-1] - at[0] > 1.3
        for p in list(tmp_path.iterdir()):
            p.unlink()


def test_a_pause_that_the_server_asks_for(monkeypatch):
    slept, now = [], [100.0]
    monkeypatch.setattr(models.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(models.time, "sleep", lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))

    class Busy(Exception):
        retry_after = 7

    tries = []

    def client(prompt):
        tries.append(now[0])
        if len(tries) == 1:
            raise Busy
        return "a b c"

    limited = models.Limited(client, tokens_per_minute=60, pause=0.5)
    assert limited("p q") == "a b c" and slept[0] == 7 and tries[1] == 107
    limited("p")
    # two tokens asked again, three answered: five seconds at one a second
    assert tries[2] - tries[1] == 5
    with pytest.raises(Busy):
        models.Limited(lambda p: (_ for _ in ()).throw(Busy()), retries=0)("p")


def test_name_search_covers_parts(spark):
    """The query searches the names of all parts, a table that grows, and finds some but not all."""
    from grafloom.plans import more_queries

    d = "/root/testdata/sf0.001"
    parts = [(r.p_partkey, r.p_name) for r in spark.read.parquet(f"{d}/part.parquet").collect()]
    got = [tuple(r) for r in more_queries.name_search(spark, d).collect()]
    assert sorted(got) == sorted(r for r in parts if "e" in r[1].lower()) and 100 < len(got) < len(parts)
