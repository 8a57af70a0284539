"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables.

The others rest on a library's tokenizer, a fitted model or Spark's hash; tests hold them
against brute force, the library itself or held-out labels.
"""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _components(vertices: str, edges: str) -> str:
    """Common tables with ``(v, c)``: the least vertex that each one reaches; ``edges`` has both directions."""
    return f"reach(v, c) AS (SELECT v, v FROM {vertices} UNION SELECT e.b, r.c FROM reach r JOIN {edges} e ON e.a = r.v), comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)"


_OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
 reps AS (SELECT min(doc_id) AS v, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
 g AS (SELECT v, len(s) AS n, unnest(s) AS x FROM reps),
 p AS (SELECT a.v AS a, b.v AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM g a JOIN g b ON a.x = b.x AND a.v < b.v GROUP BY a.v, b.v),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 {_components('reps', 'e')}
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(r.v, d.doc_id) AS class_id, coalesce(count(*) FILTER (len(d.s) > 0) OVER (PARTITION BY r.v), 1) AS copies
 FROM (SELECT doc_id, list_sort(s) AS s FROM sets) d LEFT JOIN reps r ON r.s = d.s LEFT JOIN comp ON comp.v = r.v"""

_OP1_LINKS = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
 d AS (SELECT doc_id, list_sort(s) AS s FROM sets), reps AS (SELECT min(doc_id) AS v, count(*) AS copies, s FROM d WHERE len(s) > 0 GROUP BY s),
 g AS (SELECT v, len(s) AS n, unnest(s) AS x FROM reps),
 p AS (SELECT a.v AS a, b.v AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM g a JOIN g b ON a.x = b.x AND a.v < b.v GROUP BY a.v, b.v),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 o AS (SELECT e.a AS v, sum(reps.copies) AS others FROM e JOIN reps ON reps.v = e.b GROUP BY e.a), {_components('reps', 'e')}
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(r.v, d.doc_id) AS class_id, coalesce(r.copies, 1) AS copies, coalesce(r.copies - 1, 0) + coalesce(o.others, 0) AS n_links
 FROM d LEFT JOIN reps r ON r.s = d.s LEFT JOIN comp ON comp.v = r.v LEFT JOIN o ON o.v = r.v"""

_OP2 = """WITH f AS (SELECT page_id, encode(coalesce(html, '')) AS p, sha1(coalesce(html, '')) AS h FROM pages),
 b AS (SELECT page_id, octet_length(p) AS n, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + (((('0x' || substr(h || '00', (k * 5) // 4 + 1, 3))::INT >> (12 - (k * 5) % 4 - 5)) & 31)), 1)), '') AS d, max(page_id) OVER (PARTITION BY p) AS m FROM f)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM b"""

_OP6 = f"""WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_max(list_transform(embedding, lambda c: abs(c))) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
 vs AS (SELECT vec_id AS v FROM embeddings), {_components('vs', 'l')}
SELECT e.vec_id, coalesce(n, 0) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept FROM embeddings e JOIN comp ON comp.v = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id"""

_OP4 = """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
 n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn DESC) - 1 AS depth FROM (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM c)),
 late AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 WHERE a.conv_id % 7 = 0)
SELECT c.conv_id, c.turn, 0 AS idx, 'call' AS kind, 'call-' || c.turn AS call_id, CASE WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, CASE WHEN late.conv_id IS NOT NULL THEN n.depth END AS level,
  CASE WHEN length(c.text) < 40 THEN '$.prompt: minLength' ELSE '' END AS violations, '{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":"call-' || c.turn || '","name":"reply"' || CASE WHEN r.turn IS NULL THEN '' ELSE ',"result":' || to_json(r.text) END || '}' AS json
 FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 LEFT JOIN late ON late.conv_id = c.conv_id LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn
UNION ALL SELECT r.conv_id, r.turn, 0, 'result', 'call-' || (r.turn - 1), 'orphan', NULL, NULL, '{"content":' || to_json(r.text) || ',"role":"tool","tool_call_id":"call-' || (r.turn - 1) || '"}' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.turn = r.turn - 1)
UNION ALL SELECT conv_id, turn, 0, 'message', NULL, NULL, NULL, NULL, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' FROM conversations WHERE role NOT IN ('user', 'assistant')"""

_OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200),
 r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
 s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r)),
 runs AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY doc_id, g),
 parts AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t, g FROM runs UNION ALL SELECT doc_id, max(b), NULL, 1e9 FROM runs GROUP BY doc_id),
 kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f, g) AS h FROM parts p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
 sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept ON kept.doc_id = d.doc_id"""

_OP13 = r"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 ids AS (SELECT conv_id, count(*) AS n, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
   lambda r, b: list_reduce(range(0, 8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(r, b)), 4294967295) AS r FROM o GROUP BY conv_id),
 c AS (SELECT ids.conv_id, ids.n, (3 - ids.r % 4) AS h, ids.conv_id - ids.conv_id % 20 AS base, least(3 - ids.r % 4, coalesce(b.n, 0)) AS lent FROM ids LEFT JOIN ids b ON b.conv_id = ids.conv_id - ids.conv_id % 20),
 t AS (SELECT c.conv_id, o.i AS d, role, text FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, o.i - h + lent, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
 p AS (SELECT conv_id, d, text, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM t UNION ALL SELECT conv_id, 0, '', '' FROM c),
 n AS (SELECT k, d, min(conv_id) AS v, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words FROM p GROUP BY k, d),
 q AS (SELECT p.conv_id, n.k, n.d, n.v, lag(n.k) OVER w AS up, lag(n.v) OVER w AS up_v FROM p JOIN n USING (k, d) WINDOW w AS (PARTITION BY p.conv_id ORDER BY p.d)),
 own AS (SELECT * FROM q WHERE conv_id = v), kids AS (SELECT up AS k, count(*) AS n_children FROM own WHERE d > 0 GROUP BY up),
 sub AS (SELECT a.k, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves FROM own JOIN q a ON a.conv_id = own.conv_id AND a.d <= own.d JOIN n ON n.k = own.k LEFT JOIN kids ON kids.k = own.k GROUP BY a.k),
 e AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, k, d, max(d) OVER (PARTITION BY conv_id) AS m FROM p) WHERE d = m GROUP BY k)
SELECT own.v AS conv_id, own.d AS depth, own.up_v AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
 FROM own JOIN n ON n.k = own.k JOIN sub ON sub.k = own.k LEFT JOIN kids ON kids.k = own.k LEFT JOIN e ON e.k = own.k"""

_CLASS = "CASE WHEN {0} BETWEEN '0' AND '9' THEN 0 WHEN {0} BETWEEN 'a' AND 'z' THEN 1 WHEN {0} BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END"
_EITHER = r"""[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"""
_OP12 = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
 p(kind, pat) AS (VALUES (0, '({either})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9+/_.=-]{20,}')),
 m AS (SELECT r, kind, pat, regexp_split_to_array(text, pat) AS gaps, regexp_extract_all(text, pat) AS ms FROM t, p WHERE regexp_matches(text, pat)),
 e AS (SELECT r, kind, pat, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap FROM m),
 s AS (SELECT r, kind, CASE kind WHEN 0 THEN regexp_extract(m, pat, 2) WHEN 3 THEN rtrim(m, '.') ELSE m END AS v, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY k) - length(m) AS a FROM e),
 f AS (SELECT r, kind, v, a::BIGINT AS a, (a + CASE kind WHEN 3 THEN length(v) ELSE n END)::BIGINT AS z FROM s WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN n >= 20 WHEN 2 THEN n >= 24 ELSE length(v) >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
 g AS (SELECT f.* FROM f WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.r = f.r AND b.kind < 3 AND b.a < f.z AND f.a < b.z)),
 l AS (SELECT g.*, length(v) <= 512 AND len(list_distinct(string_split(v, ''))) >= 6 AND NOT regexp_matches(v, '(?i)example|sample|dummy|placeholder|changeme|your|test|xxxx') AND (kind < 3 OR
   len(regexp_extract_all(v, '[0-9]')) >= 2 AND len(regexp_extract_all(v, '[a-z]')) >= 2 AND len(regexp_extract_all(v, '[A-Z]')) >= 2 AND
   100 * len(list_filter(range(1, length(v)), lambda i: {left} < 3 AND {left} <> {right})) >= 35 * length(v)) AS live FROM g),
 o AS (SELECT v, count(DISTINCT coalesce(source, '<null>')) AS owners, max(kind < 3) AS known FROM l JOIN t USING (r) GROUP BY v),
 j AS (SELECT l.*, owners < 3 AS own FROM l JOIN o USING (v) WHERE kind < 3 OR owners < 3 AND (live OR known)),
 w AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
   string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || a || ':' || z, ',' ORDER BY a, kind) AS spans, count(*) FILTER (own AND live) AS n_owned, count(*) FILTER (NOT own) AS n_copied FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN w USING (r)"""
_OP12 = _OP12.replace("{either}", _EITHER).replace("{left}", _CLASS.replace("{0}", "v[i]")).replace("{right}", _CLASS.replace("{0}", "v[i + 1]"))

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op1_ngram_jaccard_links": _OP1_LINKS, "op2_warc_archive": _OP2, "op4_tool_call_linking": _OP4, "op5_suffix_dedup": _OP5, "op6_embedding_dedup": _OP6, "op12_secret_scan": _OP12, "op13_conversation_trie": _OP13}
