"""DuckDB SQL for the queries that SQL can express."""

# Words of decontamination: runs of letters, digits and non-ASCII characters.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH items AS (
  SELECT item_id, text, ws, least(5, len(ws)) AS k
  FROM (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '{_WORDS}') AS ws FROM benchmark)
  WHERE len(ws) > 0),
item_grams AS (
  SELECT DISTINCT item_id, text, k, array_to_string(ws[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM items)),
item_sizes AS (SELECT item_id, text, count(*) AS n_shingles FROM item_grams GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{_WORDS}') AS ws
         FROM documents),
doc_grams AS (
  SELECT DISTINCT r, doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM items)))
SELECT doc_id, item_id, n_shingles::INT AS n_shingles, count(*)::INT AS n_found,
       count(*)::DOUBLE / n_shingles AS containment
FROM doc_grams JOIN item_grams USING (k, gram) JOIN item_sizes USING (item_id, text)
GROUP BY r, doc_id, item_id, text, n_shingles
HAVING count(*) >= 0.8::DOUBLE * n_shingles
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT r, doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
counted AS (SELECT r, doc_id, g, count(*) AS c FROM grams GROUP BY ALL),
bag AS (
  SELECT r, doc_id, sum(c) AS size, md5(string_agg(array_to_string(g, ' ') || ':' || c, chr(10) ORDER BY g)) AS b
  FROM counted GROUP BY r, doc_id),
reps AS (SELECT b, any_value(size) AS size, min(doc_id) AS rep, min(r) AS r FROM bag GROUP BY b),
items AS (SELECT reps.rep, reps.size, counted.g, counted.c FROM reps JOIN counted USING (r)),
common AS (
  SELECT x.rep AS u, y.rep AS v, x.size AS su, y.size AS sv, sum(least(x.c, y.c)) AS n_common
  FROM items x JOIN items y ON x.g = y.g AND x.rep < y.rep
   AND least(x.size, y.size) >= 0.8::DOUBLE * greatest(x.size, y.size)
  GROUP BY ALL),
link AS (
  SELECT u, v FROM common WHERE n_common >= 0.8::DOUBLE * (su + sv - n_common)
  UNION ALL SELECT v, u FROM common WHERE n_common >= 0.8::DOUBLE * (su + sv - n_common)),
reach AS (SELECT rep AS node, rep AS root FROM reps
          UNION SELECT link.v, reach.root FROM reach JOIN link ON link.u = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT bag.doc_id, roots.root AS class_id, reps.rep AS bag_id, bag.size::BIGINT AS n_shingles
FROM bag JOIN reps USING (b) JOIN roots ON roots.node = reps.rep
UNION ALL
SELECT doc_id, doc_id, doc_id, 0::BIGINT FROM words WHERE len(ws) = 0
"""

REPEATED_BYTES = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
         FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs WHERE len(h) >= 100)),
least_doc AS (SELECT s, min(doc_id) AS m FROM wins GROUP BY s),
hit AS (SELECT doc_id, i FROM wins JOIN least_doc USING (s) WHERE doc_id > m),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh
           FROM hit),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY doc_id, r),
pieces AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spans
  UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, ''
                            ORDER BY a) AS k
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars")


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in (*_FIELDS, text)]
    return f"sha256({' || '.join(parts)})"


# crc32 by its bits: the polynomial's reflected form, one step a bit of the decimal id.
MERKLE_MANIFEST = f"""
WITH RECURSIVE crc(doc_id, rest, c, k) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::UBIGINT, 8 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, CASE WHEN k = 8 THEN substr(rest, 2) ELSE rest END,
         CASE WHEN k = 8 THEN xor(c, ascii(rest[1])::UBIGINT)
              WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END,
         CASE WHEN k = 8 THEN 0 ELSE k + 1 END
  FROM crc WHERE k < 8 OR rest <> ''),
tampers AS (SELECT doc_id FROM crc WHERE k = 8 AND rest = '' AND xor(c, 4294967295::UBIGINT) % 2 = 0),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IN (SELECT doc_id FROM tampers) THEN {_leaf("replace(text, chr(10), '')")}
              ELSE {_leaf("text")} END AS given FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
up(source, lvl, i, h, n) AS (
  SELECT source, 0, i, leaf, n FROM placed
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY source, lvl, i // 3),
subs AS (
  SELECT source, h, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i, count(*) OVER () AS n
  FROM up WHERE n = 1),
top(lvl, i, h, n) AS (
  SELECT 0, i, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl, i // 3),
walk(r, source, lvl, i, h, proof, n) AS (
  SELECT r, source, 0, i, given, '', n FROM placed
  UNION ALL
  SELECT w.r, any_value(w.source), any_value(w.lvl) + 1, any_value(w.i) // 3,
         sha256(string_agg(CASE WHEN u.i = w.i THEN w.h ELSE u.h END, '' ORDER BY u.i)),
         any_value(w.proof) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> w.i), ''),
         (any_value(w.n) + 2) // 3
  FROM walk w JOIN up u ON u.source IS NOT DISTINCT FROM w.source AND u.lvl = w.lvl AND u.i // 3 = w.i // 3
  WHERE w.n > 1 GROUP BY w.r),
rise(r, lvl, i, h, proof, n) AS (
  SELECT w.r, 0, s.i, w.h, w.proof, s.n FROM walk w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source
  WHERE w.n = 1
  UNION ALL
  SELECT w.r, any_value(w.lvl) + 1, any_value(w.i) // 3,
         sha256(string_agg(CASE WHEN u.i = w.i THEN w.h ELSE u.h END, '' ORDER BY u.i)),
         any_value(w.proof) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> w.i), ''),
         (any_value(w.n) + 2) // 3
  FROM rise w JOIN top u ON u.lvl = w.lvl AND u.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.r)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root,
       f.h = t.h AS verified
FROM placed p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source JOIN rise f ON f.r = p.r AND f.n = 1
CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""

REPEATED_WORDS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
         FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM docs WHERE len(ws) >= 13)),
least_doc AS (SELECT s, min(doc_id) AS m FROM wins GROUP BY s),
hit AS (SELECT r, i FROM wins JOIN least_doc USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM hit),
kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS k
  FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs) ANTI JOIN gone USING (r, i) GROUP BY r),
lost AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

SQL: dict[str, str] = {
    "op4_repeated_bytes": REPEATED_BYTES,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op6_decontaminate": DECONTAMINATE,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op13_repeated_passages": REPEATED_WORDS,
}
