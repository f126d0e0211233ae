"""SQL twins of the queries that SQL can express, in DuckDB's dialect, for tables of test size.

They compare all pairs and list all windows, which is what the operators are there to avoid.
"""

from __future__ import annotations

#: Shingles of three words, links at 90 %, and what they reach.
OP2_NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n f ON x = f.doc_id JOIN n g ON y = g.doc_id WHERE 100 * c >= 90 * (f.n + g.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON r.reach = b.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""
#: Links by cosine within a label, and what they reach.
OP7_EMBEDDINGS = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x),
c AS (SELECT node AS vec_id, min(reach) AS component_id FROM r GROUP BY 1), k AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
#: Every window of 50 bytes by its MD5, and the least document that has it.
OP8_SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, CAST(length(h) / 2 - 49 AS BIGINT))) AS i, unnest(list_transform(range(0, CAST(length(h) / 2 - 49 AS BIGINT)), lambda i: md5_number(substr(h, 2 * i + 1, 100)))) AS s FROM d),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
u AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM r),
t AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
#: All scores of the anchors, their positives, and the negatives in each one's range.
OP11_NEGATIVES = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_resize(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))), (SELECT max(len(embedding)) FROM embeddings), 0.0) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT * FROM n WHERE rank <= 10
"""
#: Units by a regular expression, ranks by the digest of the id.
OP12_INFILLING = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS i, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
f AS (SELECT doc_id, t, n, form, CASE WHEN i = 0 THEN '' ELSE array_to_string(w[1:i], '') END AS a, CASE WHEN i = j THEN '' ELSE array_to_string(w[i + 1:j], '') END AS b, CASE WHEN j = n THEN '' ELSE array_to_string(w[j + 1:n], '') END AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_NGRAM_JACCARD, "op7_embeddings": OP7_EMBEDDINGS, "op8_suffix_dedup": OP8_SUFFIX_DEDUP, "op11_negatives": OP11_NEGATIVES, "op12_infilling": OP12_INFILLING}
