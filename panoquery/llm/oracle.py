"""DuckDB twins of those queries that SQL can express: plain formulations without sketches, cells or templates."""

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM said),
classes AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS class_id, len(s) AS n, s FROM sets),
each AS (SELECT DISTINCT class_id AS c, n, unnest(s) AS x FROM classes WHERE class_id = doc_id AND n > 0),
common AS (SELECT p.c AS a, q.c AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS shared FROM each p JOIN each q ON p.x = q.x AND p.c <> q.c GROUP BY p.c, q.c),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),{_COMPONENTS}
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, least(c.class_id, coalesce(l.b, c.class_id)) AS component_id,
  c.doc_id = least(c.class_id, coalesce(l.b, c.class_id)) AS kept, c.class_id
FROM classes c LEFT JOIN lowest l ON c.class_id = l.a"""

CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS example, lead(1) OVER w IS NULL AS last,
    13 + length(regexp_replace(role, '([\\\[\]<])', '_\1', 'g')) + length(regexp_replace(text, '([\\\[\]<])', '_\1', 'g')) AS n
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY example ROWS UNBOUNDED PRECEDING) AS so_far FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY example)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY example) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id"""

VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND len(p.v) = len(q.v) AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.93),{_COMPONENTS},
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN lowest l ON e.vec_id = l.a LEFT JOIN degrees d ON e.vec_id = d.a"""

ORACLE_SQL: dict[str, str] = {"op3_minhash_dedup": NEAR_DUPLICATES, "op6_chat_formatting": CHAT, "op10_embedding_dedup": VECTORS}
