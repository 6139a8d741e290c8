"""Registered queries over the driver's tables, and their SQL.

The graph of the fixtures: text units are windows of 100 tokens (hop 80) of each document; entities
are capitalised words of four letters or more, upper-cased; edges are pairs within a unit, weighted
by the number of units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from grafloom.functions import parsers, text as T
from grafloom.operators import chunking, communities, context, graph, relational, retrieval
from grafloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIZE, OVERLAP = 100, 20


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    """(unit, doc_id, start, chunk)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    u = chunking.base_text_units(docs, SIZE, OVERLAP)
    return u.select(F.concat_ws(":", "group_id", "start").alias("unit"), F.col("group_id").alias("doc_id"), "start", "chunk")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, weight)."""
    pairs = graph.pair_edges(units(spark, d), "chunk", "unit")
    return pairs.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


# SQL of the same fixtures
_TOK = "tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+') AS t FROM documents)"
_UNITS = _TOK + f""", cuts AS (SELECT doc_id, t, unnest(range(0, len(t), {SIZE - OVERLAP})) AS start FROM tok),
units AS (SELECT doc_id || ':' || start AS unit, doc_id, start, array_to_string(t[start + 1 : start + {SIZE}], ' ') AS chunk FROM cuts)"""
_ENT = _UNITS + """, ent AS (SELECT DISTINCT unit, doc_id, upper(e) AS title FROM (SELECT unit, doc_id, unnest(regexp_extract_all(chunk, '[A-Z][a-z]{3,}')) AS e FROM units))"""
_EDGES = _ENT + """, edges AS (SELECT a.title AS source, b.title AS target, count(*)::DOUBLE AS weight FROM ent a JOIN ent b ON a.unit = b.unit AND a.title < b.title GROUP BY 1, 2)"""
_DEGREE = _EDGES + """, degree AS (SELECT title, count(*) AS degree FROM (SELECT source AS title FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)"""
_RANKED = _DEGREE + """, ranked AS (SELECT source, target, weight, s.degree AS source_degree, t.degree AS target_degree, s.degree + t.degree AS rank FROM edges JOIN degree s ON s.title = source JOIN degree t ON t.title = target)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The 20 edges whose ends have the highest combined degree."""
    e = edges(spark, d)
    return graph.combined_degree(e, graph.degrees(e)).orderBy(F.desc("rank"), "source", "target").limit(20)


@query(f"""WITH {_TOK}, cuts AS (SELECT doc_id, t, unnest(range(0, len(t), 1100)) AS start FROM tok)
SELECT doc_id, start::BIGINT AS start, least(1200, len(t) - start)::BIGINT AS n_tokens, md5(array_to_string(t[start + 1 : start + 1200], ' ')) AS chunk_md5 FROM cuts""")
def chunk_tokens(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    u = chunking.base_text_units(docs)
    return u.select(F.col("group_id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("chunk").alias("chunk_md5"))


@query(f"""WITH {_TOK}, n AS (SELECT d.doc_id, d.lang, len(t)::BIGINT AS n_tokens FROM tok JOIN documents d USING (doc_id)),
r AS (SELECT *, 20 + sum(n_tokens) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM n)
SELECT lang, doc_id, n_tokens, used::BIGINT AS used FROM r WHERE used <= 12000""")
def greedy_prefix_budget(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", T.token_count("text").cast("long").alias("n_tokens"))
    return context.greedy_prefix(docs, F.col("n_tokens"), 12000, [F.col("doc_id")], ["lang"], 20).select("lang", "doc_id", "n_tokens", "used")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
c AS (SELECT label, p, avg(x) AS m FROM x GROUP BY 1, 2),
dist AS (SELECT c.label::BIGINT AS query_id, x.vec_id AS id, sum((x.x - c.m) * (x.x - c.m)) AS distance FROM x JOIN c USING (p) GROUP BY 1, 2)
SELECT query_id, id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= 10""")
def knn_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    c = retrieval.centroid(v, "label").groupBy(F.col("key").cast("long").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("query"))
    return retrieval.nearest_each(v, c, 10).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_EDGES} SELECT source, target, weight FROM edges")
def entity_cooccurrence(spark, d):
    return edges(spark, d)


@query("""WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS qa FROM conversations)
SELECT conv_id, qa::BIGINT AS qa, arg_min(text, turn) AS question, coalesce(string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) ORDER BY turn), '') AS answers FROM r WHERE qa > 0 GROUP BY 1, 2""")
def conversation_qa_turns(spark, d):
    return context.qa_turns(table(spark, d, "conversations")).withColumn("answers", F.array_join("answers", "\n"))


@query("""SELECT conv_id, turn, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role = 'user') WHERE rank <= 2""")
def last_user_turns(spark, d):
    return context.last_user_turns(table(spark, d, "conversations"), 2).select("conv_id", "turn", "text", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, md5(coalesce(lang, '') || coalesce(source, '') || coalesce(text, '')) AS id, source || '-' || doc_id AS title FROM documents")
def document_hash_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.row_hash("lang", "source", "text").alias("id"), F.concat_ws("-", "source", "doc_id").alias("title"))


# white space of every kind, and the entities that occur in pages; ampersands last, as each is read once
_STRIPPED = r"regexp_replace(chr(10) || chr(9) || ' ' || html || ' ' || chr(13) || chr(10), '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]+$', '', 'g')"
_RESOLVED = f"replace(replace(replace(replace({_STRIPPED}, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', chr(34)), '&amp;', '&')"


@query(f"SELECT page_id, md5(regexp_replace({_RESOLVED}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')) AS body FROM pages")
def clean_text(spark, d):
    padded = F.concat(F.lit("\n\t "), "html", F.lit(" \r\n"))
    return table(spark, d, "pages").select("page_id", F.md5(T.clean(padded)).alias("body"))


@query("""SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, hour(o_orderdate) AS hour, minute(o_orderdate) AS minute, second(o_orderdate) AS second FROM orders""")
def date_parts(spark, d):
    parts = T.date_parts(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", *(c.cast("long").alias(k) for k, c in parts.items()))


@query("""SELECT doc_id, 'lang=' || coalesce(lang, '') || ';n_chars=' || coalesce(n_chars::VARCHAR, '') || ';source=' || coalesce(source, '') AS attributes FROM documents""")
def attributes_map_json(spark, d):
    docs = relational.pack_attributes(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"])
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return docs.select("doc_id", F.array_join(pairs, ";").alias("attributes"))


@query(f"""WITH {_UNITS}, g AS (SELECT doc_id, count(*) AS n_units, string_agg(unit, ',' ORDER BY unit) AS text_units FROM units GROUP BY 1)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(text_units, '') AS text_units FROM documents d LEFT JOIN g USING (doc_id)""")
def docs_left_text_units(spark, d):
    g = units(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.array_join(F.array_sort(F.collect_list("unit")), ",").alias("text_units"))
    return table(spark, d, "documents").select("doc_id").join(g, "doc_id", "left").fillna(0, ["n_units"]).fillna("", ["text_units"])


@query(f"WITH {_DEGREE} SELECT title, degree FROM degree")
def node_degree(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"WITH {_RANKED} SELECT source, target, weight, source_degree, target_degree, rank FROM ranked")
def edge_combined_degree(spark, d):
    e = edges(spark, d)
    return graph.combined_degree(e, graph.degrees(e))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus) AS n FROM lineitem),
f AS (SELECT l_partkey, list_reduce(list(l_quantity ORDER BY n), lambda a, x: (a + x) / 2) AS avg_q FROM o GROUP BY 1)
SELECT l_partkey, round(sum(l_quantity), 4) AS sum_q, max(l_quantity) AS max_q, min(l_quantity) AS min_q, arg_min(l_returnflag, n) AS first_flag, arg_max(l_returnflag, n) AS last_flag,
string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses, round(any_value(avg_q), 6) AS avg_q FROM o JOIN f USING (l_partkey) GROUP BY 1""")
def merge_ops(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ord", F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
    m = graph.merge_attribute
    return rows.groupBy("l_partkey").agg(
        F.round(m("sum", "l_quantity", "ord"), 4).alias("sum_q"), m("max", "l_quantity", "ord").alias("max_q"), m("min", "l_quantity", "ord").alias("min_q"), m("skip", "l_returnflag", "ord").alias("first_flag"),
        m("replace", "l_returnflag", "ord").alias("last_flag"), m("concat", "l_linestatus", "ord").alias("statuses"), F.round(m("average", "l_quantity", "ord"), 6).alias("avg_q"),
    )


@query(f"""WITH {_EDGES}, e AS (SELECT unit, string_agg(title, ',' ORDER BY title) AS entities, count(*) AS n FROM ent GROUP BY 1)
SELECT u.unit, coalesce(e.entities, '') AS entity_ids, coalesce(n * (n - 1) // 2, 0)::BIGINT AS n_relationships FROM units u LEFT JOIN e USING (unit)""")
def text_unit_backlinks(spark, d):
    e = graph.entity_lists(units(spark, d), "chunk", "unit")
    return e.select("unit", F.array_join("titles", ",").alias("entity_ids"), F.col("n_pairs").alias("n_relationships"))


@query(f"""WITH {_ENT} SELECT md5(title) AS id, title AS name, count(*) AS n_units, count(DISTINCT doc_id) AS n_docs, row_number() OVER (ORDER BY title) - 1 AS human_readable_id FROM ent GROUP BY title""")
def final_entities_dedup(spark, d):
    e = graph.rule_entities(units(spark, d), "chunk", "unit").withColumn("doc_id", F.split("unit", ":")[0])
    g = e.groupBy(F.col("title").alias("name")).agg(F.count("*").alias("n_units"), F.countDistinct("doc_id").alias("n_docs"))
    return graph.number_rows(g, ["name"], "human_readable_id").select(F.md5("name").alias("id"), "name", "n_units", "n_docs", "human_readable_id")


_COMMUNITY = """sup AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
e AS (SELECT c, s, c_nationkey AS cn, s_nationkey AS sn FROM sup JOIN customer ON c_custkey = c JOIN supplier ON s_suppkey = s)"""


@query(f"""WITH {_COMMUNITY}, b AS (SELECT cn AS nation, c, s FROM e UNION SELECT sn, c, s FROM e)
SELECT n_nationkey AS community, n_name AS title, count(*) AS n_edges, count(DISTINCT s) AS n_suppliers, count(DISTINCT c) AS n_customers FROM b JOIN nation ON n_nationkey = nation GROUP BY 1, 2""")
def label_communities(spark, d):
    """Edges customer - supplier count for the communities (nations) of both ends: boundary edges belong to two."""
    sup = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).distinct()
    e = sup.join(table(spark, d, "customer"), F.col("c") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("s") == F.col("s_suppkey"))
    b = e.select("c", "s", F.explode(F.array_distinct(F.array("c_nationkey", "s_nationkey"))).alias("community"))
    g = b.groupBy("community").agg(F.count("*").alias("n_edges"), F.countDistinct("s").alias("n_suppliers"), F.countDistinct("c").alias("n_customers"))
    return g.join(table(spark, d, "nation"), F.col("community") == F.col("n_nationkey")).select("community", F.col("n_name").alias("title"), "n_edges", "n_suppliers", "n_customers")


@query("""SELECT r_regionkey AS community, n_nationkey AS sub_community, count(*) AS sub_community_size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def hierarchy_containment(spark, d):
    """Child communities whose members all lie in the parent: an equi-join on members, then counts."""
    own = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = own.select(F.lit(1).alias("level"), F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("title")).unionAll(own.select(F.lit(0), "n_regionkey", "c_custkey"))
    from grafloom.operators import reports

    return reports.community_hierarchy(rows).select("community", "sub_community", "sub_community_size")


@query("""WITH n AS (SELECT lang, source, count(DISTINCT d.doc_id) AS n FROM documents d JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT lang, source, round(n / max(n) OVER (), 6) AS weight FROM n""")
def occurrence_weight(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.struct("lang", "source").alias("community")).join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return retrieval.occurrence_weight(rows, "community", "doc_id").select("community.lang", "community.source", F.round("weight", 6).alias("weight"))


@query("""SELECT n_nationkey AS community, n_regionkey AS rank, count(*) AS matches FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2""")
def community_matches(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0")
    m = c.groupBy(F.col("c_nationkey").alias("community")).agg(F.count("*").alias("matches"))
    return m.join(table(spark, d, "nation"), F.col("community") == F.col("n_nationkey")).select("community", F.col("n_regionkey").alias("rank"), "matches").orderBy(F.desc("matches"), F.desc("rank"))


@query(f"""WITH {_RANKED}, sel AS (SELECT title FROM degree ORDER BY degree DESC, title LIMIT 20),
f AS (SELECT r.*, source IN (SELECT title FROM sel) AS si, target IN (SELECT title FROM sel) AS ti FROM ranked r),
o AS (SELECT *, CASE WHEN si THEN target ELSE source END AS outside FROM f WHERE si <> ti),
l AS (SELECT outside, count(DISTINCT CASE WHEN si THEN source ELSE target END) AS links FROM o GROUP BY 1),
top AS (SELECT source, target, links, rank FROM o JOIN l USING (outside) ORDER BY links DESC, rank DESC, source, target LIMIT 200)
SELECT source, target, 0::BIGINT AS links, rank FROM f WHERE si AND ti UNION ALL SELECT * FROM top""")
def in_out_network(spark, d):
    e = graph._written(edges(spark, d))
    deg = graph._written(graph.degrees(e))
    ranked = graph.combined_degree(e, deg)
    sel = deg.orderBy(F.desc("degree"), "title").limit(20).select("title")
    # the budget counts what is selected, 20 or all if fewer
    return retrieval.select_relationships(ranked, sel, 10, most=min(20, deg.count())).select("source", "target", "links", "rank")


@query(f"""WITH {_DEGREE}, top AS (SELECT title FROM degree ORDER BY degree DESC, title LIMIT 1),
nb AS (SELECT target AS title FROM edges WHERE source = (SELECT title FROM top) UNION SELECT source FROM edges WHERE target = (SELECT title FROM top))
SELECT title, degree AS rank FROM nb JOIN degree USING (title) ORDER BY degree DESC, title LIMIT 10""")
def neighbors_by_rank(spark, d):
    e = edges(spark, d)
    deg = graph.degrees(e).withColumnRenamed("degree", "rank")
    top = deg.orderBy(F.desc("rank"), "title").first()
    return retrieval.neighbours_by_rank(deg, e, top.title if top else "", 10)


@query("""WITH n AS (SELECT c_name AS title, 1 AS level, c_nationkey AS community FROM customer UNION ALL SELECT c_name, 0, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT title, max(community) AS community FROM n WHERE level <= 1 GROUP BY 1""")
def max_community_per_title(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.select(F.col("c_name").alias("title"), F.lit(1).alias("level"), F.col("c_nationkey").alias("community"))
    rows = rows.unionAll(c.join(n, c.c_nationkey == n.n_nationkey).select("c_name", F.lit(0), "n_regionkey"))
    return retrieval.latest_community(rows, 1)


@query("""WITH RECURSIVE o AS (SELECT lang, doc_id AS id, length(text) AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
b AS (SELECT lang, id, n, 0::BIGINT AS batch, s::BIGINT AS used FROM o WHERE n = 1
UNION ALL SELECT o.lang, o.id, o.n, CASE WHEN used > 0 AND used + s > 12000 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + s > 12000 THEN s ELSE used + s END FROM b JOIN o ON o.lang = b.lang AND o.n = b.n + 1)
SELECT lang, id, batch FROM b""")
def report_batches(spark, d):
    return context.batches(table(spark, d, "documents"), "lang", "doc_id", F.char_length("text"), 12000).withColumnRenamed("by", "lang")


@query(f"""WITH {_DEGREE}, sel AS (SELECT title, row_number() OVER (ORDER BY degree DESC, title) AS ord FROM (SELECT * FROM degree ORDER BY degree DESC, title LIMIT 20)),
m AS (SELECT unit, min(ord) AS ord FROM ent JOIN sel USING (title) GROUP BY 1), k AS (SELECT unit, count(*) AS k FROM ent GROUP BY 1)
SELECT unit, ord, (k - 1)::BIGINT AS n_relationships FROM m JOIN k USING (unit)""")
def sources_ranked(spark, d):
    """Units credited to their first selected entity, with the relationships of that entity there."""
    from grafloom.operators import search

    u = units(spark, d)
    ent = graph.rule_entities(u, "chunk", "unit")
    pairs = graph.pair_edges(u, "chunk", "unit")
    deg = graph.degrees(edges(spark, d)).orderBy(F.desc("degree"), "title").limit(20)
    sel = deg.select("title", F.row_number().over(Window.orderBy(F.desc("degree"), "title")).alias("ord"))
    return search.rank_sources(ent, pairs, sel).select("unit", F.col("ord").cast("long").alias("ord"), "n_relationships")


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS in_context FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)""")
def candidate_in_context(spark, d):
    from grafloom.operators import search

    return search.in_context(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("""SELECT 'new' AS kind, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'deleted', doc_id FROM documents WHERE doc_id % 3 = 1""")
def delta_documents(spark, d):
    """Delta of a table holding remainders 0 and 2 by 3 against one holding 1 and 2."""
    docs = table(spark, d, "documents").select("doc_id")
    new, gone = relational.delta(docs.filter("doc_id % 3 <> 1"), docs.filter("doc_id % 3 <> 0"), "doc_id")
    return new.select(F.lit("new").alias("kind"), "doc_id").unionAll(gone.select(F.lit("deleted"), "doc_id"))


@query("""WITH k AS (SELECT p_brand AS name, p_partkey AS id, p_partkey % 2 AS side, p_name FROM part),
g AS (SELECT name, arg_min(id, (side, id)) AS id, md5(string_agg(p_name, chr(10) ORDER BY side, id)) AS description, count(*) AS n FROM k GROUP BY 1)
SELECT name, id, description, n, row_number() OVER (ORDER BY name) - 1 AS human_readable_id FROM g""")
def resolve_entities(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"), F.col("p_name").alias("description"))
    old, new = p.filter("id % 2 = 0"), p.filter("id % 2 = 1")
    out, _ = incremental.resolve_entities(old, new)
    return out.select("name", "id", F.md5("description").alias("description"), "n", "human_readable_id")


@query("""SELECT p AS pos, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::BIGINT AS p FROM embeddings) GROUP BY 1""")
def vector_centroid(spark, d):
    v = table(spark, d, "embeddings").select(F.col("embedding").alias("vector"))
    return retrieval.centroid(v).select(F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query(f"""WITH {_DEGREE}, sel AS (SELECT title FROM degree ORDER BY degree DESC, title LIMIT 5), f AS (SELECT min(title) AS t FROM sel),
m AS (SELECT CASE WHEN source IN (SELECT title FROM sel) THEN (SELECT t FROM f) ELSE source END AS source, CASE WHEN target IN (SELECT title FROM sel) THEN (SELECT t FROM f) ELSE target END AS target FROM edges)
SELECT source, target, count(*) AS n FROM m WHERE source <> target GROUP BY 1, 2""")
def merge_selected_nodes(spark, d):
    e = edges(spark, d)
    deg = graph.degrees(e)
    sel = [r.title for r in deg.orderBy(F.desc("degree"), "title").limit(5).collect()]
    _, links = graph.merge_selected(deg.select(F.col("title").alias("id"), F.col("title").alias("ord"), F.col("degree").alias("size")), e.select(F.struct("source", "target").alias("ord"), "source", "target"), sel)
    moved = e.select(*(F.when(F.col(c).isin(sel), F.lit(min(sel)) if sel else F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("source", "target"))).groupBy("source", "target").agg(F.count("*").alias("n"))
    return links.join(moved, ["source", "target"]).select("source", "target", "n")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 21600000000::BIGINT AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY user_id, k""")
def merge_intervals(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("user_id", us.alias("s"), (us + F.lit(6 * 3600 * 1_000_000)).alias("e"))
    return context.merge_intervals(rows, "user_id", "s", "e")


@query("""WITH p AS (SELECT conv_id AS id, arg_min(text, turn) AS prompt, arg_max(text, turn) AS response FROM conversations GROUP BY 1),
n AS (SELECT conv_id AS id, string_agg(DISTINCT role, ',' ORDER BY role) AS nodes FROM conversations GROUP BY 1)
SELECT prompt, nodes, max(id) AS id, arg_max(response, id) AS response FROM p JOIN n USING (id) GROUP BY 1, 2""")
def prompt_cache_lookup(spark, d):
    """The newest answer of each prompt and node set."""
    from grafloom.sources import prompt_cache

    c = table(spark, d, "conversations")
    prompts = c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("prompt"), F.max_by("text", "turn").alias("response"))
    chosen = c.select(F.col("conv_id").alias("prompt_id"), F.col("role").alias("node")).distinct()
    return prompt_cache.newest(prompts, chosen).select("prompt", F.array_join("nodes", ",").alias("nodes"), "id", "response")


@query(f"""WITH {_ENT}, r AS (SELECT unit, title, row_number() OVER (PARTITION BY unit ORDER BY title) AS n FROM ent)
SELECT title, count(*) AS mentions, sum(n % 3)::DOUBLE AS weight FROM r GROUP BY 1""")
def parse_tuple_records(spark, d):
    """Answers of a record a line, written from the fixture's entities, parsed back; every third weight is no number."""
    e = graph.rule_entities(units(spark, d), "chunk", "unit").withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy("title")))
    w = F.when(F.col("n") % 3 == 1, F.lit("x")).otherwise((F.col("n") % 3).cast("string"))
    line = F.concat(F.lit('("entity"<|>'), F.lower("title"), F.lit("<|>WORD<|>\n seen)\n##\n(\"relationship\"<|>\t"), F.lower("title"), F.lit("<|>"), F.lower("title"), F.lit("<|>self<|>"), w, F.lit(")"))
    answers = e.groupBy("unit").agg(F.concat(F.lit("\n"), F.array_join(F.collect_list(line), "\n##\n"), F.lit("\n<|COMPLETE|>\n")).alias("answer"))
    ents, rels = parsers.graph_records(answers, "unit")
    a = ents.groupBy("title").agg(F.count("*").alias("mentions"))
    b = rels.groupBy(F.col("source").alias("title")).agg(F.sum("weight").alias("weight"))
    return a.join(b, "title").select("title", "mentions", "weight")


@query("""SELECT event_id, event_type AS description, CASE WHEN value IS NULL THEN 0 ELSE floor(abs(value)) END::BIGINT AS score FROM events""")
def parse_points_json(spark, d):
    """Fenced JSON answers of one point each, parsed back."""
    score = F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("int")
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("description"), score.alias("score"))).alias("points"))), F.lit("\n```"))
    rows = T.with_points(table(spark, d, "events").select("event_id", body.alias("answer")), "answer").select("event_id", F.explode("points").alias("p"))
    return rows.select("event_id", "p.description", F.col("p.score").cast("long").alias("score"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS v, 'n' || c_nationkey || '-' || c_mktsegment AS g FROM customer),
m AS (SELECT g, min(v) AS root FROM e GROUP BY 1) SELECT 'c' || lpad(v::VARCHAR, 9, '0') AS title, 'c' || lpad(root::VARCHAR, 9, '0') AS component FROM e JOIN m USING (g)""")
def connected_components(spark, d):
    """Customers chained by nation and segment: each is linked with the next in its group, so a component is a path."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("title"), F.struct("c_nationkey", "c_mktsegment").alias("g"))
    after = F.lead("title").over(Window.partitionBy("g").orderBy("title"))
    links = c.select(F.col("title").alias("source"), F.coalesce(after, "title").alias("target"))
    return graph.connected_components(links)


@query()
def hierarchical_clusters(spark, d):
    return communities.hierarchical_leiden(edges(spark, d))


@query(f"""WITH {_DEGREE} SELECT title, true AS once, true AS nested, true AS small, true AS connected FROM degree""")
def cluster_invariants(spark, d):
    """What holds for each node of the hierarchy: it is on level 0 once, its communities are nested, the last has ten members or fewer, and edges connect each."""
    e = graph._written(edges(spark, d))
    return communities.invariants(e, graph._written(communities.hierarchical_leiden(e)))
