"""DuckDB SQL for the queries whose whole result SQL can express. Each follows the result's definition, row by row."""

from __future__ import annotations

_LAST = "9223372036854775807"  # a null id stands after all others
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_ROWS = "SELECT row_number() OVER () AS r, doc_id, text FROM documents"

OP1 = f"""WITH rows AS ({_ROWS}), docs AS (SELECT r, doc_id, coalesce(doc_id, {_LAST}) AS place, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM rows),
  words AS (SELECT r, doc_id, place, unnest(words) AS word, generate_subscripts(words, 1) AS i, words, len(words) AS n FROM docs),
  windows AS (SELECT r, i, place, array_to_string(words[i:i + 12], ' ') AS key FROM words WHERE i + 12 <= n),
  earliest AS (SELECT key, min(place) AS place FROM windows GROUP BY key),
  gone AS (SELECT r, i FROM windows JOIN earliest USING (key) WHERE earliest.place < windows.place),
  marked AS (SELECT w.r, w.i, w.word, max(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS covered
    FROM words w LEFT JOIN gone g ON g.r = w.r AND g.i = w.i),
  kept AS (SELECT r, sum(covered)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE covered = 0) AS text FROM marked GROUP BY r)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)"""

OP3 = f"""WITH rows AS ({_ROWS}), docs AS (SELECT r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM rows),
  items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS words FROM benchmark),
  needles AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS key
    FROM (SELECT item, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM items WHERE len(words) > 0)),
  lengths AS (SELECT DISTINCT n FROM needles),
  starts AS (SELECT r, words, unnest(generate_series(1, len(words))) AS i FROM docs WHERE len(words) > 0),
  found AS (SELECT r, i, s.n, item FROM (SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS key FROM starts JOIN lengths ON i + n - 1 <= len(words)) s JOIN needles ON needles.n = s.n AND needles.key = s.key),
  hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY r),
  names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN hit USING (r) LEFT JOIN names USING (r)"""

OP5 = """WITH rows AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents), sized AS (SELECT *, octet_length(b) AS n FROM rows),
  windows AS (SELECT r, i, md5(b[i:i + 199]) AS key FROM (SELECT r, b, unnest(generate_series(1, n - 199)) AS i FROM sized WHERE n >= 200)),
  again AS (SELECT key FROM windows GROUP BY key HAVING count(*) > 1),
  starts AS (SELECT r, i FROM windows SEMI JOIN again USING (key)),
  opened AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM starts),
  spans AS (SELECT r, min(i) AS first, max(i) + 199 AS last FROM (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM opened) GROUP BY r, k),
  gaps AS (SELECT r, first, last, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) AS before FROM spans),
  kept AS (SELECT r, sum(last - first + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(last) AS tail, string_agg(CASE WHEN first > before + 1 THEN hex(b[before + 1:first - 1]) ELSE '' END, '' ORDER BY first) AS h FROM gaps JOIN sized USING (r) GROUP BY r)
  SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, '') || CASE WHEN coalesce(tail, 0) < n THEN hex(b[coalesce(tail, 0) + 1:n]) ELSE '' END)) AS kept_sha256 FROM sized LEFT JOIN kept USING (r)"""

OP8 = f"""WITH RECURSIVE rows AS ({_ROWS}), docs AS (SELECT r, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS words FROM rows),
  sets AS (SELECT DISTINCT r, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS shingle FROM (SELECT r, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM docs WHERE len(words) > 0)),
  sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
  common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.r < b.r GROUP BY a.r, b.r),
  alike AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
  same_id AS (SELECT x.r AS a, y.r AS b FROM docs x JOIN docs y ON x.doc_id = y.doc_id AND x.r < y.r WHERE len(x.words) > 0 AND len(y.words) > 0),
  links AS (SELECT a, b FROM alike UNION ALL SELECT a, b FROM same_id), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  labelled(r, least_id) USING KEY (r) AS (SELECT r, coalesce(doc_id, {_LAST}) FROM docs UNION
    SELECT ways.a, min(near.least_id) FROM ways JOIN labelled near ON near.r = ways.b JOIN recurring.labelled own ON own.r = ways.a WHERE near.least_id < own.least_id GROUP BY ways.a)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, nullif(least_id, {_LAST}) AS component_id FROM docs LEFT JOIN sizes USING (r) JOIN labelled USING (r)"""

ORACLES = {"op1_substring_dedup": OP1, "op3_benchmark_decontamination": OP3, "op5_suffix_array_dedup": OP5, "op8_ngram_jaccard_join": OP8}
