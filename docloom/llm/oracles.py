"""DuckDB SQL for the queries that SQL can express on whole tables: brute force, by other ways than the operators'."""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM w, LATERAL unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= 85 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(m.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(e, lambda x: x * x)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT vec_id, least(vec_id, min(other)) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(m.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(m.component_id, v.vec_id) AS kept
FROM v LEFT JOIN d USING (vec_id) LEFT JOIN m USING (vec_id)
"""

#: What the transcripts' turns must be found to be, straight from the table.
CHAT = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0), role NULLS FIRST, trim(coalesce(text, ''))) - 1 AS turn_no, role,
       '<|' || role || '|>' || chr(10) || replace(trim(coalesce(text, '')), '<|', '<||') || chr(10) || '<|end|>' || chr(10) AS rendered
FROM conversations
"""

COPIES = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def balls(k: int, rounds: int, dim: int) -> str:
    """Every vector against every centroid, round by round."""
    gap = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
)""", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, e FROM v ORDER BY c LIMIT {k})"]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, min({gap} * {k} + c) AS m FROM v, c{n} c GROUP BY vec_id)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT m % {k} AS c, j, sum(e[j]) AS s, count(*) AS n FROM a{n}, range(1, {dim + 1}) t(j) GROUP BY ALL)")
            parts.append(f"f{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(f{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN f{n} USING (c))")
    last = f"a{rounds}"
    return f"WITH {', '.join(parts)} SELECT vec_id, (m % {k})::INT AS cluster, m // {k} AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia, (sum(m // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON m % {k} = c"


#: The hash is worked out bit by bit: 256 bytes' remainders first, then each feature's bytes from left to right.
IMPORTANCE = r"""
WITH RECURSIVE bits AS (
  SELECT b AS byte, b::BIGINT AS r, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(r ORDER BY byte) AS l FROM bits WHERE k = 8),
texts AS (SELECT 's' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts),
f AS (
  SELECT kind, id, g, count(*) AS n FROM (
    SELECT kind, id, unnest(ws) AS g FROM w
    UNION ALL SELECT kind, id, ws[i] || ' ' || ws[i + 1] FROM w, LATERAL unnest(range(1, len(ws))) t(i)
  ) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(encode(g)), 2 * i::INT + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM f), tab
), b AS MATERIALIZED (SELECT kind, id, bucket, sum(n) AS n FROM f JOIN g USING (g) GROUP BY ALL),
h AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 's'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM b GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * ((SELECT sum(s) FROM h)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT sum(t) FROM h)::DOUBLE + 10000))))::BIGINT AS gain FROM h
), m AS (SELECT id, sum(n * gain) AS total, sum(n) AS n FROM b JOIN gain USING (bucket) WHERE kind = 's' GROUP BY id),
z AS (
  SELECT w.id AS doc_id, len(ws) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT::DOUBLE AS h
  FROM w LEFT JOIN m ON w.id = m.id WHERE kind = 's'
), y AS (SELECT doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM z),
x AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM x
"""
