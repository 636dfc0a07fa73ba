"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from skillgrid.llm.mixing import SEED

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.p = p.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {PLAIN} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS key FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, width, array_to_string(w[i:i+width-1], ' ') AS key FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM bw))),
h AS (SELECT doc_id, i, dw.width, item FROM dw JOIN bw ON dw.width = bw.width AND dw.key = bw.key),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP5 = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size FROM t GROUP BY 1), r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r JOIN g USING (norm)"""


_DRAW = f"(('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

OP6 = f"""WITH z AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
c AS (SELECT *, source_size * 2 AS cap, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(cap) OVER w - cap)::DOUBLE) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS per FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
v AS (SELECT (SELECT per FROM l WHERE cap > per * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS level),
r AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM l, v),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM r),
j AS (SELECT z.doc_id, z.size, q.*, target - floor(rate) * source_size AS need, {_DRAW} AS draw FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source),
t AS (SELECT source, need, draw AS lim, sum(size) OVER (PARTITION BY source ORDER BY draw)::DOUBLE AS upto FROM j UNION ALL SELECT DISTINCT source, need, -1.0::DOUBLE, 0.0::DOUBLE FROM j),
e AS (SELECT source, min({{'off': abs(upto - need), 'lim': lim}}).lim AS lim FROM t GROUP BY 1)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw <= lim)::INT))::BIGINT AS taken FROM j JOIN e ON j.source IS NOT DISTINCT FROM e.source"""

TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS repeats FROM (SELECT item_id, unnest({TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
v AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, docs),
r AS (SELECT item_id, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score FROM q JOIN v USING (t) JOIN p USING (t), s GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 10"""

OP12 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE alike) WHERE n <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLES = {"op2_repeated_spans": OP2, "op4_decontaminate": OP4, "op5_exact_dedup": OP5, "op6_mix_sources": OP6, "op11_lexical_search": OP11, "op12_hard_negatives": OP12}
