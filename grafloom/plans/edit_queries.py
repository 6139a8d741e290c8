"""Registered queries of a viewer's edits, graph files, groupings and ranked relationships, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from grafloom.functions import text as T
from grafloom.operators import chunking, editing, graph, readers, relational, reports, retrieval, selection
from grafloom.plans.catalogue import _DEGREE, _EDGES, _TOK, edges, query, table, units
from grafloom.sources import graph_files
from grafloom.streaming import incremental

# A viewer's graph of customers and suppliers; customers' orders are texts, what they bought of whom are links.
_VIEW = """nodes AS (SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS color, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS size FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, NULL, s_acctbal FROM supplier),
texts AS (SELECT 'c' || o_custkey AS node, o_orderkey AS pos, o_orderkey % 50 AS id, o_orderpriority || o_orderkey AS text FROM orders),
links AS (SELECT 'c' || o_custkey || '-' || l_suppkey AS id, min(o_orderkey) AS ord, 'c' || o_custkey AS source, 's' || l_suppkey AS target, min(l_returnflag) AS explanation FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey),
picks AS (SELECT 'n' || c_nationkey AS grp, c_custkey AS ord, 'c' || c_custkey AS id FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'n' || s_nationkey, 1000000000 + s_suppkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0),
firsts AS (SELECT grp, arg_min(id, ord) AS first FROM picks GROUP BY 1 HAVING count(*) > 1),
own AS (SELECT p.id, p.ord, first FROM picks p JOIN firsts USING (grp))"""


def _view(spark, d):
    """The graph, and picks of some customers and suppliers of each nation, with one that isn't there."""
    c, s, o = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "orders")
    id_ = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    nodes = c.select(id_("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("color"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("size"))
    nodes = nodes.unionByName(s.select(id_("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("color"), F.col("s_acctbal").alias("size")))
    texts = o.select(id_("c", "o_custkey").alias("node"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 50).alias("id"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"))
    bought = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderkey").alias("ord"), F.min("l_returnflag").alias("explanation"))
    links = bought.select(F.concat(id_("c", "o_custkey"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("id"), "ord", id_("c", "o_custkey").alias("source"), id_("s", "l_suppkey").alias("target"), "explanation")
    picks = c.filter("c_custkey % 10 = 0").select(id_("n", "c_nationkey").alias("group"), F.col("c_custkey").alias("ord"), id_("c", "c_custkey").alias("id"))
    picks = picks.unionByName(s.filter("s_suppkey % 5 = 0").select(id_("n", "s_nationkey").alias("group"), (F.col("s_suppkey") + 1000000000).alias("ord"), id_("s", "s_suppkey").alias("id")))
    absent = spark.range(1).select(F.lit("n1").alias("group"), F.lit(0).cast("long").alias("ord"), F.lit("absent").alias("id"))
    return editing.Graph(nodes, texts, links), picks.unionByName(absent)


@query(f"""WITH {_VIEW}, met AS (SELECT first, max(coalesce(size, 0)) AS size FROM own JOIN nodes USING (id) GROUP BY 1),
n AS (SELECT id, name, CASE WHEN first IS NULL THEN color ELSE coalesce(color, '{editing.LIGHT}') END AS color, CASE WHEN first IS NULL THEN nodes.size ELSE met.size END AS size FROM nodes LEFT JOIN met ON first = id WHERE id NOT IN (SELECT id FROM own WHERE id <> first)),
t AS (SELECT first AS node, id, arg_min(text, (ord, pos)) AS text, min((ord, pos)) AS p FROM (SELECT t.*, o.ord, o.first FROM texts t JOIN own o ON o.id = t.node) GROUP BY 1, 2 UNION ALL SELECT node, id, text, (0, pos) FROM texts WHERE node NOT IN (SELECT id FROM own)),
g AS (SELECT node, count(*) AS n_texts, md5(string_agg(text, ',' ORDER BY p, id)) AS texts FROM t GROUP BY 1)
SELECT id, name, color, size, coalesce(n_texts, 0) AS n_texts, texts FROM n LEFT JOIN g ON node = id""")
def viewer_merged_nodes(spark, d):
    """Nodes after the picked ones of each nation were merged, with their texts."""
    g = editing.merge_nodes(*_view(spark, d))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))), lambda x: x["text"])
    texts = g.texts.groupBy("node").agg(F.count("*").alias("n_texts"), F.md5(F.array_join(lines, ",")).alias("texts"))
    return g.nodes.join(texts, F.col("id") == F.col("node"), "left").drop("node").fillna(0, ["n_texts"])


@query(f"""WITH {_VIEW}, m AS (SELECT l.id, l.ord, coalesce(a.first, source) AS source, coalesce(b.first, target) AS target, explanation FROM links l LEFT JOIN own a ON a.id = source LEFT JOIN own b ON b.id = target WHERE a.first IS NULL OR b.first IS NULL OR a.first <> b.first)
SELECT source, target, arg_min(id, (ord, id)) AS id, arg_min(explanation, (ord, id)) AS explanation FROM m GROUP BY 1, 2""")
def viewer_merged_links(spark, d):
    """Links after the same merges: inner ones gone, of those with the same ends the first."""
    return editing.merge_nodes(*_view(spark, d)).links.select("source", "target", "id", "explanation")


@query(f"""WITH {_VIEW}, c AS (SELECT o.id, coalesce(n.color, '{editing.LIGHT}') AS color FROM own o JOIN nodes n ON n.id = first)
SELECT 'node' AS kind, n.id, CASE WHEN n.id LIKE 'c%' AND substr(n.id, 2)::BIGINT % 6 = 0 THEN 'M' || n.id WHEN n.id LIKE 'c%' AND substr(n.id, 2)::BIGINT % 3 = 0 THEN 'N' || n.id ELSE name END AS value, coalesce(c.color, n.color) AS color FROM nodes n LEFT JOIN c USING (id)
UNION ALL SELECT 'text', node || ':' || pos, CASE WHEN (node, id) IN (SELECT ('c' || o_custkey, o_orderkey % 50) FROM orders WHERE o_totalprice > 200000) THEN 'edited' ELSE text END, NULL FROM texts
UNION ALL SELECT 'link', id, CASE WHEN target IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) THEN NULL ELSE explanation END, NULL FROM links""")
def viewer_edits(spark, d):
    """Picked nodes recoloured, every third customer renamed (every sixth twice), texts of dear orders reworded, explanations of every fourth supplier's links taken away."""
    g, picks = _view(spark, d)
    g = editing.recolour_nodes(g, picks)
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    names = c.filter("c_custkey % 3 = 0").select(F.lit(1).alias("ord"), "id", F.concat(F.lit("N"), "id").alias("name"))
    names = names.unionByName(c.filter("c_custkey % 6 = 0").select(F.lit(2).alias("ord"), "id", F.concat(F.lit("M"), "id").alias("name")))
    g = editing.rename_nodes(g, names)
    o = table(spark, d, "orders").filter("o_totalprice > 200000")
    g = editing.edit_texts(g, o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), (F.col("o_orderkey") % 50).alias("id"), F.lit("edited").alias("text")))
    gone = g.links.filter("cast(substr(target, 2) AS long) % 4 = 0").select("ord", "id", F.lit(None).cast("string").alias("explanation"))
    g = editing.explain_links(g, gone)
    none = F.lit(None).cast("string").alias("color")
    out = g.nodes.select(F.lit("node").alias("kind"), "id", F.col("name").alias("value"), "color")
    out = out.unionByName(g.texts.select(F.lit("text").alias("kind"), F.concat("node", F.lit(":"), F.col("pos").cast("string")).alias("id"), F.col("text").alias("value"), none))
    return out.unionByName(g.links.select(F.lit("link").alias("kind"), "id", F.col("explanation").alias("value"), none))


@query(f"""WITH {_VIEW} SELECT 'node' AS kind, id AS a, NULL AS b, name || ' <&> "' || chr(10) || chr(9) AS text, color, size FROM nodes UNION ALL SELECT 'edge', source, target, explanation, NULL, ord::DOUBLE FROM links""")
def graphml_files(spark, d):
    """The graph written as a GraphML document, and read again."""
    g, _ = _view(spark, d)
    path = graph.scratch(spark, "graphml")
    nodes = g.nodes.select(F.col("id").alias("title"), F.concat("name", F.lit(' <&> "\n\t')).alias("name"), "color", "size")
    graph_files.save_graphml(nodes, g.links.select("source", "target", "ord", "explanation"), path)
    n, e = graph_files.load_graphml(spark, path)
    none = F.lit(None).cast("string")
    rows = n.select(F.lit("node").alias("kind"), F.col("title").alias("a"), none.alias("b"), F.col("name").alias("text"), "color", "size")
    return rows.unionByName(e.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("explanation").alias("text"), none.alias("color"), F.col("ord").cast("double").alias("size")))


@query(f"""WITH {_VIEW} SELECT 'node' AS kind, id AS a, NULL AS b, name AS text, color, size FROM nodes UNION ALL SELECT 'link', source, target, explanation, NULL, ord::DOUBLE FROM links""")
def document_files(spark, d):
    """The graph saved as the viewer's document, and read again."""
    g, _ = _view(spark, d)
    links = g.links.select("source", "target", "explanation", "ord")
    path = graph_files.save_document(g.nodes, links, graph.scratch(spark, "documents"), "shop", datetime(2020, 1, 2, 3, 4))
    n, e = graph_files.load_document(spark, f"{path}/graph.json", g.nodes.schema.simpleString(), links.schema.simpleString())
    none = F.lit(None).cast("string")
    rows = n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none.alias("b"), F.col("name").alias("text"), "color", "size")
    return rows.unionByName(e.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("explanation").alias("text"), none.alias("color"), F.col("ord").cast("double").alias("size")))


@query("""SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS types, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS ids, count(value) AS n, arg_max(event_type, event_id) AS last, max(value) AS top FROM events GROUP BY 1""")
def grouped_lists(spark, d):
    """Events of each user as lists, joined strings and plain aggregates."""
    rules = [
        {"column": "event_type", "operation": "string_concat", "separator": "|", "to": "types"}, {"column": "event_id", "operation": "array_agg", "to": "ids"}, {"column": "value", "operation": "count", "to": "n"},
        {"column": "event_type", "operation": "last", "to": "last"}, {"column": "value", "operation": "max", "to": "top"},
    ]
    g = relational.aggregate(table(spark, d, "events"), rules, ("user_id",), ("event_id",))
    return g.withColumn("ids", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")))


_UUID = "substr(h, 1, 12) || '4' || substr(h, 14, 3) || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18)"


@query(f"WITH {_EDGES}, l AS (SELECT *, row_number() OVER (ORDER BY source, target) - 1 AS human_readable_id, unnest([0, 1, 2]) AS level FROM edges), x AS (SELECT *, md5('0' || chr(31) || source || chr(31) || target || chr(31) || level) AS h FROM l) SELECT source, target, level, human_readable_id, {_UUID} AS id FROM x")
def levelled_edges(spark, d):
    """Edges on each of three levels, numbered, with ids in the form of UUIDs."""
    levels = spark.range(3).select(F.col("id").cast("int").alias("level"))
    return graph.clustered_edges(graph._written(edges(spark, d)), levels).select("source", "target", "level", "human_readable_id", "id")


@query(f"""WITH {_DEGREE}, r AS (SELECT source, target, weight, coalesce(s.degree, 0) + coalesce(t.degree, 0) AS ends, length(source) AS len FROM edges LEFT JOIN degree s ON s.title = source AND s.degree % 2 = 0 LEFT JOIN degree t ON t.title = target AND t.degree % 2 = 0),
k AS (SELECT source, target, row_number() OVER (ORDER BY ends DESC, source, target) AS by_ends, row_number() OVER (ORDER BY weight DESC, source, target) AS by_weight, row_number() OVER (ORDER BY len DESC, source, target) AS by_length FROM r)
SELECT source, target, by_ends::BIGINT AS by_ends, by_weight::BIGINT AS by_weight, by_length::BIGINT AS by_length FROM k""")
def relationship_orders(spark, d):
    """Places of edges by what their ends' ranks add up to (odd ones unknown), by weight, and by an attribute."""
    e = graph._written(edges(spark, d))
    ranks = graph.degrees(e).filter("degree % 2 = 0").select("title", F.col("degree").alias("rank"))
    held = e.withColumn("attributes", F.create_map(F.lit("len"), F.length("source").cast("string")))
    out = e.select("source", "target")
    for rows, by, to in ((e, "rank", "by_ends"), (e, "weight", "by_weight"), (held, "len", "by_length")):
        placed = graph.number_rows(retrieval.ranked_relationships(rows, ranks, by).select("source", "target", (-F.col("order_value")).alias("_v")), ["_v", "source", "target"], "_n")
        out = out.join(placed.select("source", "target", (F.col("_n") + 1).alias(to)), ["source", "target"])
    return out


@query("""WITH a AS (SELECT p_type || p_size % 5 AS name, min(p_partkey) AS id, p_partkey % 2 AS side FROM part GROUP BY 1, 3), e AS (SELECT a.*, 'v' || id AS v FROM a)
SELECT name, arg_min(id, side) AS id, arg_min(v, side) FILTER (WHERE id % 3 <> 0) AS graph_embedding, CASE WHEN count(*) = 1 THEN min(v) END AS description_embedding, count(*) AS n FROM e GROUP BY 1""")
def resolved_embeddings(spark, d):
    """Two tables of types resolved by name: the first graph embedding that there is, a description's own only where the name is in one table."""
    p = table(spark, d, "part").groupBy(F.concat("p_type", (F.col("p_size") % 5).cast("string")).alias("name"), (F.col("p_partkey") % 2).alias("side")).agg(F.min("p_partkey").alias("id"))
    v = F.concat(F.lit("v"), F.col("id").cast("string"))
    p = p.select("name", "side", "id", F.lit("").alias("description"), F.when(F.col("id") % 3 != 0, v).alias("graph_embedding"), v.alias("description_embedding"))
    out, _ = incremental.resolve_entities(p.filter("side = 0").drop("side"), p.filter("side = 1").drop("side"))
    return out.select("name", "id", "graph_embedding", "description_embedding", "n")


@query("""WITH n AS (SELECT c_name AS title, 0 AS level, 'r' || n_regionkey AS community FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_name, 1, 'n' || c_nationkey FROM customer WHERE c_custkey % 4 <> 0 AND c_acctbal > 0 UNION ALL SELECT c_name, 2, 'deep' FROM customer),
t AS (SELECT title, arg_max(community, level) AS community FROM n WHERE level <= 1 GROUP BY 1)
SELECT c_custkey::VARCHAR AS id, c_name AS title, community FROM customer JOIN t ON title = c_name""")
def entities_of_level(spark, d):
    """Entities that are nodes on level 0 or 1, with their deepest community there; every name is in the table twice."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    at = c.filter("c_custkey % 4 <> 0")
    nodes = at.join(n, at.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("title"), F.lit(0).alias("level"), F.concat(F.lit("r"), "n_regionkey").alias("community"))
    nodes = nodes.unionByName(at.filter("c_acctbal > 0").select(F.col("c_name").alias("title"), F.lit(1).alias("level"), F.concat(F.lit("n"), "c_nationkey").alias("community")))
    nodes = nodes.unionByName(c.select(F.col("c_name").alias("title"), F.lit(2).alias("level"), F.lit("deep").alias("community")))
    own = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("human_readable_id"))
    again = own.withColumn("id", F.concat(F.lit("~"), "id"))
    return readers.entities({"nodes": nodes, "entities": again.unionByName(own)}, 1).select("id", "title", F.col("community_ids")[0].alias("community"))


@query(f"""WITH {_TOK}, w AS (SELECT doc_id, t, unnest(range(0, len(t), 40)) AS s FROM tok), g AS (SELECT doc_id, count(*) AS n, md5(string_agg(array_to_string(t[s + 1 : s + 50], ' '), '#' ORDER BY s)) AS windows FROM w GROUP BY 1),
l AS (SELECT conv_id, regexp_extract_all(string_agg(text, ' ' ORDER BY turn), '[^ \\t\\n\\r\\f]+') AS t FROM conversations GROUP BY 1)
SELECT 'text' AS kind, doc_id AS id, coalesce(n, 0) AS n, coalesce(windows, md5('')) AS windows FROM documents LEFT JOIN g USING (doc_id)
UNION ALL SELECT 'list', conv_id, ceil(len(t) / 40)::BIGINT, md5(array_to_string(list_transform(range(0, len(t), 40), lambda s: array_to_string(t[s + 1 : s + 50], ' ')), '#')) FROM l""")
def split_texts(spark, d):
    """Windows of single texts, and of conversations as lists of texts."""
    docs = table(spark, d, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), chunking.split_text("text", 50, 10).alias("w"))
    turns = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: x["text"])
    lists = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("texts")).select(F.lit("list").alias("kind"), "id", chunking.split_list("texts", 50, 10).alias("w"))
    return docs.unionByName(lists).select("kind", "id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "#")).alias("windows"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(DISTINCT trim(s)) AS n, count(DISTINCT md5(doc_id || trim(s))) AS n_ids FROM s WHERE trim(s) <> '' GROUP BY 1""")
def sentence_text_units(spark, d):
    """Text units by sentence: of each document its distinct sentences, an id each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    u = chunking.text_units(docs, "sentence")
    return u.groupBy(F.col("document_ids")[0].cast("long").alias("doc_id")).agg(F.countDistinct("text").alias("n"), F.countDistinct("id").alias("n_ids"))


@query(f"""WITH {_EDGES}, n AS (SELECT title FROM (SELECT source AS title FROM edges UNION SELECT target FROM edges) UNION ALL SELECT 'NOBODY'),
f AS (SELECT source AS title, 'edge' AS kind, source || '-' || target AS fact FROM edges UNION ALL SELECT target, 'edge', source || '-' || target FROM edges UNION ALL SELECT title, 'claim', unit FROM ent WHERE doc_id % 10 = 0)
SELECT left(n.title, 1) AS community, n.title, kind, count(fact) AS n, md5(coalesce(string_agg(fact, ',' ORDER BY fact), '')) AS facts FROM n LEFT JOIN f ON f.title = n.title GROUP BY 1, 2, 3""")
def facts_of_nodes(spark, d):
    """Nodes with the edges that they are ends of, and with every tenth document's units as claims."""
    e = graph._written(edges(spark, d))
    titles = e.select(F.explode(F.array("source", "target")).alias("title")).distinct().unionByName(spark.range(1).select(F.lit("NOBODY").alias("title")))
    nodes = titles.select(F.lit(0).alias("level"), F.substring("title", 1, 1).alias("community"), "title")
    claims = graph.rule_entities(units(spark, d), "chunk", "unit").distinct().filter("cast(substring_index(unit, ':', 1) AS long) % 10 = 0").select(F.col("unit").alias("id"), F.col("title").alias("subject"))
    rows = reports.node_facts(nodes, e.select(F.concat_ws("-", "source", "target").alias("id"), "source", "target"), claims)
    return rows.groupBy("community", "title", "kind").agg(F.count("fact").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("fact")), ",")).alias("facts"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), q AS (SELECT p, x FROM x WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
dist AS (SELECT vec_id AS id, sum((x.x - q.x) * (x.x - q.x)) AS distance FROM x JOIN q USING (p) WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1)
SELECT id, round(distance, 6) AS distance FROM dist ORDER BY dist.distance, id LIMIT 12""")
def nearest_of_some(spark, d):
    """The twelve nearest to the first vector among those whose document is English."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    some = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    first = v.orderBy("id").first()
    return retrieval.nearest(v, list(first.vector), 12, include=some).select("id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_EDGES}, c AS (SELECT title, left(title, 1) AS c FROM (SELECT source AS title FROM edges UNION SELECT target FROM edges)), m AS (SELECT sum(weight) AS m FROM edges),
k AS (SELECT c, sum(weight) AS d FROM (SELECT source AS title, weight FROM edges UNION ALL SELECT target, weight FROM edges) JOIN c USING (title) GROUP BY 1)
SELECT round((SELECT coalesce(sum(weight), 0) FROM edges WHERE left(source, 1) = left(target, 1)) / (SELECT m FROM m) - (SELECT sum((d / (2 * (SELECT m FROM m))) ** 2) FROM k), 9) AS modularity""")
def letter_modularity(spark, d):
    """How well first letters divide the entities' graph."""
    e = graph._written(edges(spark, d))
    parts = e.select(F.explode(F.array("source", "target")).alias("title")).distinct().select("title", F.substring("title", 1, 1).alias("community"))
    return e.sparkSession.range(1).select(F.round(F.lit(graph.modularity(e, parts)), 9).alias("modularity"))


@query("""WITH r AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, md5('# Report' || chr(10) || chr(10) || n || ' turns' || chr(10) || chr(10) || array_to_string(list_transform(['first', 'last'], lambda x: '## ' || x || chr(10) || chr(10) || t), chr(10) || chr(10))) AS report, md5('Of ' || conv_id || ': ' || t) AS prompt FROM r""")
def filled_templates(spark, d):
    """Conversations as reports of two findings, and in the place of a name in a template."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"])
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("t"), F.count("*").alias("n"))
    found = F.array(*(F.struct(F.lit(x).alias("summary"), F.col("t").alias("explanation")) for x in ("first", "last")))
    said = T.report_markdown(F.lit(None).cast("string"), F.concat(F.col("n").cast("string"), F.lit(" turns")), found)
    return r.select("conv_id", F.md5(said).alias("report"), F.md5(T.fill_placeholders(F.lit("Of {id}: {text}"), id=F.col("conv_id").cast("string"), text=F.col("t"))).alias("prompt"))


@query("""WITH o AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1) SELECT k, ceil(len(a) / 4)::BIGINT AS n, md5(array_to_string(list_transform(range(0, len(a), 4), lambda s: array_to_string(a[s + 1 : s + 4], ',')), '|')) AS batches FROM o""")
def order_batches(spark, d):
    """Orders of each customer in batches of four."""
    o = relational.aggregate(table(spark, d, "orders"), [{"column": "o_orderkey", "operation": "array_agg", "to": "a"}], ("o_custkey",))
    b = chunking.batched(F.col("a"), 4)
    return o.select(F.col("o_custkey").alias("k"), F.size(b).cast("long").alias("n"), F.md5(F.array_join(F.transform(b, lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")), "|")).alias("batches"))


@query("""SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 HAVING conv_id IN (SELECT conv_id FROM conversations ORDER BY conv_id LIMIT 40)""")
def first_sampled(spark, d):
    """The last turn of the conversations of the first 40 rows by id: a sample by ``top``."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    some = selection.sample(c.select("id", "text"), "top", 40).select("id").distinct()
    return c.join(some, "id", "left_semi").groupBy(F.col("id").alias("conv_id")).agg(F.max("turn").alias("last"))
