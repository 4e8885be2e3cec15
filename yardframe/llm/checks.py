"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_SPACED = _WORDS.format(r"[^\x20\x09-\x0D]+")
_TERMS = _WORDS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ALNUM = _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

CHECKS = {
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), i -> array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT sets.doc_id, any_value(len(sets.s))::BIGINT AS n_shingles, min(r) AS component_id
FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS t
    FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(k) WHERE len(w) > 0),
places AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t
    FROM d, (SELECT DISTINCT n FROM windows) l, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(k)),
found AS (SELECT DISTINCT doc_id, k, p.n, item_id FROM places p JOIN windows v ON p.t = v.t AND p.n = v.n),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM found, unnest(range(k, k + n)) AS u(x) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS p, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY p DESC, doc_id)""",
    "op13_ranked_search": rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY t, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM i JOIN tf USING (t) JOIN w USING (t), totals GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
