"""DuckDB statements of those numbered queries that SQL can express; the others are tested against brute-force versions."""

from __future__ import annotations

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS to_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.to_id
), parts AS (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.vec_id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP2 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, 1000 * j AS first, substr(h, 2000 * j + 1, 2398) AS c FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 800) // 1000)) AS j FROM t)),
strings AS (SELECT doc_id, first + k AS k, md5_number(substr(c, 2 * k + 1, 400)) AS g FROM (SELECT doc_id, first, c, unnest(range(0, len(c) // 2 - 199)) AS k FROM chunks)),
twice AS (SELECT g FROM strings GROUP BY g HAVING count(*) > 1),
hits AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM strings WHERE g IN (SELECT g FROM twice)),
marked AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM hits),
spans AS (SELECT doc_id, span, min(k) AS a, max(k) + 200 AS b FROM marked GROUP BY doc_id, span),
pieces AS (
  SELECT s.doc_id, s.span, substr(t.h, 2 * coalesce(lag(s.b) OVER w, 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER w, 0))) AS piece, s.a, s.b FROM spans s JOIN t USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.span)
), joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY span) AS kept, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM pieces GROUP BY doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN joined j ON j.doc_id = t.doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
named AS (SELECT page_id, strlen(body) AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS first_id, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM named
"""

OP7 = """
WITH c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, array_to_string(list_transform(l, lambda x: '<|im_start|>' || replace(coalesce(x.r, 'unknown'), '<|im_', '< |im_') || chr(10) || replace(coalesce(x.t, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10)), '') AS rendered
FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.n > c.n AND o.l[1:c.n] = c.l) AND NOT EXISTS (SELECT 1 FROM c o WHERE o.l = c.l AND o.conv_id < c.conv_id)
"""

OP8 = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
everything AS (SELECT sum(source_size) AS total FROM src),
levels AS (
  SELECT max((total - coalesce(below, 0)) / onward) AS level FROM (
    SELECT sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM src WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
  ), everything
), flagged AS (SELECT *, 3 * source_size <= weight * level AS capped FROM src, levels, everything),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM flagged
), units AS (SELECT doc_id, source, size, count(*) AS copies, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM sized GROUP BY ALL),
running AS (
  SELECT u.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole, coalesce(sum(size * copies) OVER (PARTITION BY u.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units u JOIN goals g ON u.source IS NOT DISTINCT FROM g.source
), plan AS (SELECT *, CASE WHEN whole < 3 AND size > 0 THEN greatest(0, least(copies, floor((2 * (target - whole * source_size) - 2 * before - size) / (2 * size)) + 1)) ELSE 0 END AS extra FROM running)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN nth < extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM (SELECT *, unnest(range(copies)) AS nth FROM plan)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k + 1:k + n], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM docs, (SELECT DISTINCT n FROM item_windows))),
hits AS (SELECT doc_id, n, k, item_id FROM doc_windows JOIN item_windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
sums AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l FROM d),
counts AS (SELECT r, n, doc_id, t, count(*)::BIGINT AS tf FROM (SELECT r, n, doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * held + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS held FROM counts GROUP BY t), sums),
asked AS (SELECT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, list_distinct({_WORDS}) AS w FROM benchmark)),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l))))::BIGINT AS score FROM asked JOIN weights USING (t) JOIN counts USING (t), sums GROUP BY i, item_id, r, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, k, md5_number(array_to_string(w[k + 1:k + 50], ' ')) AS g FROM (SELECT *, unnest(range(0, len(w) - 49)) AS k FROM d WHERE doc_id IS NOT NULL)),
firsts AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS p FROM windows JOIN firsts USING (g) WHERE first_id < doc_id),
each AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
