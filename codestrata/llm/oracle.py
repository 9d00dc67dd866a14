"""SQL with the same rows for the operators that SQL can express."""

ORACLE = {}

# Words of every text, numbered; a text that is null or blank has none.
_WORDS = r"""
words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
)"""

ORACLE["op2_lm_scores"] = rf"""
WITH {_WORDS},
places AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (
  SELECT doc_id, n, i, ws[i] AS g1,
         CASE WHEN i >= 2 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
         CASE WHEN i >= 3 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3
  FROM places
),
rest AS (
  SELECT doc_id, n, i, sum(n) FILTER (i = 1) OVER () - n AS others,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
         count(g2) OVER (PARTITION BY g2) - count(g2) OVER (PARTITION BY doc_id, g2) AS c2,
         count(g3) OVER (PARTITION BY g3) - count(g3) OVER (PARTITION BY doc_id, g3) AS c3
  FROM grams
),
context AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS before1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS before2 FROM rest
),
scored AS (
  SELECT doc_id, n,
    CASE WHEN i >= 3 AND c3 > 0 THEN ln(c3) - ln(before2)
         WHEN i >= 2 AND c2 > 0 THEN ln(c2) - ln(before1) + (least(3, i) - 2) * ln(0.4::DOUBLE)
         WHEN c1 > 0 THEN ln(c1) - ln(others) + (least(3, i) - 1) * ln(0.4::DOUBLE)
         ELSE ln(0.5::DOUBLE) - ln(greatest(others, 1)) + (least(3, i) - 1) * ln(0.4::DOUBLE) END AS s
  FROM context
),
per AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score
FROM words w LEFT JOIN per USING (doc_id)
"""

ORACLE["op5_source_mix"] = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight FROM per
),
ratios AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM weighed
),
filled AS (
  SELECT *, sum(cap) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING)
            + ratio * (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING)) <= total AS capped
  FROM ratios
),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
           (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM filled
),
streams AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target + 1e-6) AS BIGINT) AS words,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM sizes d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size
            + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) AS taken
FROM streams
"""

# All pairs by an inverted index of five-word runs, and reachability over links; copies are one node.
ORACLE["op10_jaccard_join"] = rf"""
WITH RECURSIVE {_WORDS},
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS grams
  FROM words
),
copies AS (SELECT min(doc_id) AS copy_id, grams, count(*) AS weight, list(doc_id) AS docs FROM sets WHERE len(grams) > 0 GROUP BY grams),
index AS (SELECT copy_id, weight, len(grams) AS n, unnest(grams) AS gram FROM copies),
links AS (
  SELECT a.copy_id AS a, b.copy_id AS b, any_value(b.weight) AS weight
  FROM index a JOIN index b ON a.gram = b.gram AND a.copy_id <> b.copy_id
  GROUP BY a.copy_id, b.copy_id
  HAVING count(*) >= 0.8::DOUBLE * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
),
reach AS (
  SELECT copy_id AS a, copy_id AS b FROM copies
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
classes AS (SELECT a AS copy_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS copy_id, sum(weight) AS n FROM links GROUP BY a)
SELECT s.doc_id, coalesce(c.copy_id, s.doc_id) AS copy_id, coalesce(k.class_id, s.doc_id) AS class_id,
       CAST(coalesce(l.n, 0) + coalesce(c.weight - 1, 0) AS BIGINT) AS n_links
FROM sets s LEFT JOIN copies c ON list_contains(c.docs, s.doc_id)
LEFT JOIN classes k ON c.copy_id = k.copy_id LEFT JOIN counts l ON c.copy_id = l.copy_id
"""

# Turn ids are MD5 of role and text; a node is told by its turn ids one after the other.  The unsigned CRC-32 goes bit by bit.
ORACLE["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, list({'tid': tid, 'bytes': bytes} ORDER BY turn NULLS FIRST, tid) AS own,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM turns GROUP BY conv_id
),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS seq
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
),
places AS (
  SELECT conv_id, len(seq) AS total, seq, array_to_string(list_transform(seq, lambda t: t.tid), '') AS path, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt
),
nodes AS (
  SELECT depth, left(path, 32 * depth) AS p, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(CASE WHEN depth > 0 THEN seq[depth].bytes END), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends
  FROM places GROUP BY ALL
),
kids AS (SELECT depth - 1 AS depth, left(p, 32 * (depth - 1)) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM nodes v LEFT JOIN kids k ON k.depth = v.depth AND k.p = v.p),
up AS (SELECT unnest(range(0, depth + 1)) AS above, p, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * bytes AS saved FROM told),
below AS (SELECT above AS depth, left(p, 32 * above) AS p, sum(leaf) AS n_leaves, sum(saved) AS saved FROM up GROUP BY ALL)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM told v JOIN below b ON b.depth = v.depth AND b.p = v.p
LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.p = left(v.p, 32 * (v.depth - 1))
"""

ORACLE["op12_warc_revisits"] = r"""
WITH told AS (SELECT page_id, url, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
placed AS (
  SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS chosen FROM told
  WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN chosen END AS refers_to
FROM placed
"""

ORACLE["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (
  SELECT lang, 1 AS len, ws[i] AS phrase, NULL AS l1, NULL AS r1, NULL AS l2, NULL AS r2 FROM places
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1], ws[i], ws[i + 1], NULL, NULL FROM places WHERE i < len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], ws[i], ws[i + 1] || ' ' || ws[i + 2], ws[i] || ' ' || ws[i + 1], ws[i + 2] FROM places WHERE i + 1 < len(ws)
),
counts AS (SELECT lang, len, phrase, l1, r1, l2, r2, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
inner_two AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, l2 AS phrase, f FROM counts WHERE len = 3 UNION ALL SELECT lang, r1, f FROM counts WHERE len = 3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM counts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.l1 JOIN counts r ON r.lang = c.lang AND r.phrase = c.r1
  LEFT JOIN inner_two t ON c.len = 2 AND t.lang = c.lang AND t.phrase = c.phrase
  WHERE c.len > 1 AND (t.f IS NULL OR 100 * t.f < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.phrase, c.f, 2, l.f, r.f
  FROM counts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.l2 JOIN counts r ON r.lang = c.lang AND r.phrase = c.r2
),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
