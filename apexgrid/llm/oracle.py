"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

OP3 = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

OP9 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM starts) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeated
), gone_list AS (
  SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(cut), 0) AS n_removed,
    CASE WHEN cut IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cut, i)) END AS k
  FROM d LEFT JOIN gone_list USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""


OP5 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, top) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.top
), c AS (
  SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

OP6 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, x.v, true), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM g
"""


OP12 = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), r(vec_id, top) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.top
), c AS (
  SELECT vec_id, min(top) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

#: the 256 remainders of the checksum, and the checksum of an ASCII or UTF-8 text given as hexadecimal digits
CRC = """
codes AS (
  SELECT list(c ORDER BY b) AS codes FROM (
    SELECT b, list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b)
  )
)"""


def crc32(text: str) -> str:
    digits = f"hex(encode({text}))"
    size = f"CAST(octet_length(encode({text})) AS BIGINT)"
    octets = f"list_transform(range({size}), lambda i: CAST('0x' || substring({digits}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, o: xor(c >> 8, codes[(xor(c, o) & 255) + 1])))"


OP11 = f"""
WITH RECURSIVE {CRC.strip()}, t AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents
  ) WHERE length(run) >= 5 GROUP BY ALL
), h AS (
  SELECT run, k, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM t, codes
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2)
      ELSE run END AS word, k FROM h
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM v)
), near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN v y ON y.word = x.rest
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN v y ON y.word = x.rest
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
    CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)
), r(word, top, depth) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, r.depth + 1 FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(top, depth) AS root FROM r GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""

OP13 = f"""
WITH {CRC.strip()}, d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    {crc32("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents, codes
), g AS (
  SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM d
), a AS (
  SELECT *, CASE WHEN planted THEN g % n ELSE 0 END AS a FROM g
), b AS (
  SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a
    THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1]) ELSE w END AS w FROM a
), x AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM b
), same AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT r, q, min(i) AS i, count(*) + q AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT r, i, size, min(q) AS q FROM stretch GROUP BY r, i, size
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(size AS DECIMAL(18, 0)) / q DESC, i, q) = 1
), of_doc AS (
  SELECT r, count(*) AS n_runs, string_agg(i || ',' || size || ',' || q || chr(10), '' ORDER BY i, q) AS lines FROM runs GROUP BY r
), gone AS (
  SELECT r, list(DISTINCT i) AS cut FROM (SELECT r, unnest(range(i + q, i + size)) AS i FROM runs) GROUP BY r
), kept AS (
  SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS rest
  FROM x ANTI JOIN (SELECT r, unnest(cut) AS i FROM gone) c ON c.r = x.r AND c.i = x.i GROUP BY x.r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, i AS start, size AS length, q AS period,
  size * 1000 // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM b LEFT JOIN of_doc USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_content_dedup": OP3, "op5_minmax_dedup": OP5, "op6_pivot_search": OP6, "op8_warc_index": OP8, "op9_repeats": OP9, "op11_spelling_variants": OP11, "op12_cap_filters": OP12, "op13_periodic_runs": OP13}
