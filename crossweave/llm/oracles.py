"""Comparison SQL (DuckDB) of the operator queries that SQL can express."""

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT DISTINCT r, grams.n, s, g FROM grams SEMI JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits JOIN win USING (n, g)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUARTERS = " || ".join(
    f"substr('{_BASE32}', 1 + CAST((CAST('0x' || substr(hex, {1 + 5 * g}, 5) AS BIGINT) >> {5 * k}) % 32 AS INTEGER), 1)" for g in range(8) for k in (3, 2, 1, 0)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_QUARTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)
"""

PREFERENCES = """
WITH last AS (
  SELECT conv_id, max(turn) AS final, max_by(coalesce(text, ''), (turn, coalesce(text, ''))) AS answer
  FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id),
following AS (SELECT *, lead(answer) OVER (ORDER BY conv_id) AS given FROM last),
given AS (SELECT conv_id, final, given FROM following WHERE given IS NOT NULL),
sides AS (
  SELECT conv_id, 0 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, 1, turn, role, text FROM conversations JOIN given USING (conv_id) WHERE turn < final
  UNION ALL SELECT conv_id, 1, final, 'assistant', given FROM given),
clean AS (
  SELECT DISTINCT conv_id, side, turn, replace(coalesce(role, 'unknown'), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM sides),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM clean),
size AS (SELECT conv_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM turns GROUP BY conv_id),
change AS (
  SELECT conv_id, min(i) AS i FROM (
    SELECT conv_id, coalesce(c.i, r.i) AS i FROM (SELECT * FROM turns WHERE side = 0) c
    FULL JOIN (SELECT * FROM turns WHERE side = 1) r USING (conv_id, i)
    WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) GROUP BY conv_id),
k AS (SELECT conv_id, nc, nr, coalesce(change.i - 1, nc) AS k FROM size LEFT JOIN change USING (conv_id)),
shown AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM turns JOIN k USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id, side, i > k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS put FROM shown)
SELECT conv_id AS pair_id,
  CASE WHEN any_value(nr) = 0 THEN 'chosen_only' WHEN any_value(nc) = 0 THEN 'rejected_only' WHEN any_value(nc) = any_value(k) AND any_value(nr) = any_value(k) THEN 'identical'
    WHEN any_value(nc) = any_value(k) OR any_value(nr) = any_value(k) THEN 'prefix' ELSE 'pair' END AS status,
  CAST(any_value(k) AS INTEGER) AS prefix_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= k), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > k), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > k), '') AS rejected,
  coalesce(string_agg(CAST(put + 13 + length(role) AS INTEGER) || '-' || CAST(put + length(s) - 1 AS INTEGER), ',' ORDER BY i) FILTER (side = 0 AND i > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(put + 13 + length(role) AS INTEGER) || '-' || CAST(put + length(s) - 1 AS INTEGER), ',' ORDER BY i) FILTER (side = 1 AND i > k AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""

DIVERGENCE = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + CAST(1000000000::HUGEINT * (n + 2) // (dense.total + 2 * v) AS BIGINT) AS p,
    1 + CAST(1000000000::HUGEINT * (all_n + 2) // (langs.total + 2 * v) AS BIGINT) AS q FROM dense JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON (pairs.lang, pairs.source, pairs.item) = (a.lang, a.source, b.source)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_DRAW = lambda k: f"CAST('0x' || substr(hex, {1 + 8 * k}, 8) AS BIGINT)"

FILL_IN_MIDDLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
c AS (
  SELECT doc_id, text, n, least({_DRAW(0)} % (n + 1), {_DRAW(1)} % (n + 1)) AS a, greatest({_DRAW(0)} % (n + 1), {_DRAW(1)} % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW(2)} % 100 >= 90 THEN 'plain'
      WHEN {_DRAW(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""

JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:least(i + 2, len(w))], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS r, min(doc_id) AS least FROM reach JOIN d ON d.r = b GROUP BY a),
number AS (SELECT a AS r, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r) LEFT JOIN number USING (r)
"""
