"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from grafloom.llm.embedding_dedup import op7_embedding_dedup
from grafloom.llm.exact_dedup import op11_exact_dedup
from grafloom.llm.jaccard import op5_jaccard_join
from grafloom.llm.language import op8_language
from grafloom.llm.language_model import op10_lm_score
from grafloom.llm.mixing import op1_mixing
from grafloom.llm.neighbours import op4_neighbours
from grafloom.llm.packing import op6_packing
from grafloom.llm.quality import op2_quality
from grafloom.llm.secret_scan import op9_secret_scan
from grafloom.llm.spelling import op13_spelling
from grafloom.llm.toxicity import op3_toxicity
from grafloom.llm.vector_codes import op12_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_toxicity": op3_toxicity,
        "op4_neighbours": op4_neighbours,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_packing": op6_packing,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_language": op8_language,
        "op9_secret_scan": op9_secret_scan,
        "op10_lm_score": op10_lm_score,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_spelling": op13_spelling,
        "pipeline": corpus_pipeline.run,
    }


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebooks by plain comparison of all entries, a round after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, part, min((d, entry)) AS best FROM (SELECT v.vec_id, v.part, e.entry, sum((v.x - e.x) * (v.x - e.x)) AS d FROM v JOIN b{i} e ON e.part = v.part AND e.pos = v.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS (SELECT part, entry, pos, coalesce(m, x) AS x FROM b{i} LEFT JOIN (SELECT part, best[2] AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM a{i} JOIN v USING (vec_id, part) GROUP BY 1, 2, 3) USING (part, entry, pos))""")
    return f"""WITH k AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, (i - 1) // (len(e) // {parts}) AS part, (i - 1) % (len(e) // {parts}) AS pos, floor(256 * e[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT part, entry, pos, x FROM f JOIN v USING (vec_id)), {", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS books FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, books AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


#: Distances count bytes in SQL: the letters beyond ASCII stand as one byte each.
_BYTES = "translate({0}.word, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and chr(c) not in "'{}")[:64] + "')"
_CRC = "list_reduce(list_transform(range(8), lambda z: z::UBIGINT), lambda a, z: xor(a >> 1, (a & 1) * 3988292384::UBIGINT), {})"
#: The checksum a byte at a time, over each different run of a document; then all pairs of like length that share a half.
_SPELLING = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
d AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM r GROUP BY ALL),
t AS (SELECT list({_CRC.format("i::UBIGINT")} ORDER BY i) AS t FROM range(256) x(i)),
c(doc_id, w, k, s, crc) AS (SELECT doc_id, w, k, hex(encode(doc_id || ':' || w)), 4294967295::UBIGINT FROM d
UNION ALL SELECT doc_id, w, k, s[3:], xor(crc >> 8, t[(xor(crc & 255, ('0x' || s[1:2])::UBIGINT) + 1)::BIGINT]) FROM c, t WHERE s <> ''),
m AS (SELECT w, k, xor(crc, 4294967295::UBIGINT) AS h FROM c WHERE s = ''),
x AS (SELECT CASE WHEN h % 97 = 0 THEN w[: (h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2 :] ELSE w END AS word, k FROM m),
v AS (SELECT word, sum(k)::BIGINT AS n, length(word) AS len FROM x WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
q AS (SELECT word, n, len, unnest([len - 1, len, len + 1]) AS l FROM v),
o AS (SELECT word, n, l, unnest([word[: l // 2] || '<', '>' || word[len - (l - l // 2) + 1 :]]) AS half FROM q),
p AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.l = b.l AND a.half = b.half AND length(a.word) = a.l WHERE levenshtein({_BYTES.format('a')}, {_BYTES.format('b')}) = 1),
g AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n FROM v LEFT JOIN g USING (word)),
z AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.further)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word AND z.further IS NULL"""

#: Brute force over all pairs that share a shingle, and over all pairs of a label.
_REACH = "reach AS (SELECT a AS root, a AS node FROM links UNION SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node), part AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"
ORACLE_SQL = {
    "op11_exact_dedup": """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""",
    "op12_vector_codes": _codes_sql(),
    "op13_spelling": _SPELLING,
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
{_REACH}
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(component, s.doc_id)) AS component_id FROM s LEFT JOIN part ON node = s.doc_id""",
    "op7_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, least(vec_id, coalesce(component, vec_id)) = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN part ON node = vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
