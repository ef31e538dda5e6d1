"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN length('<|part|>') ELSE role_chars + length('<|start|><|message|><|end|>') END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

DECONTAMINATE = (
    r"""
WITH items AS (SELECT item_id, """
    + _WORDS
    + r""" AS t FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(t), 10) AS n, array_to_string(t[s : s + 9], ' ') AS w
  FROM (SELECT item_id, t, unnest(generate_series(1, greatest(1, len(t) - 9))) AS s FROM items WHERE len(t) > 0)
),
docs AS (SELECT DISTINCT doc_id, text, """
    + _WORDS
    + r""" AS t FROM documents),
placed AS (
  SELECT doc_id, text, n, s, array_to_string(t[s : s + n - 1], ' ') AS w
  FROM (SELECT doc_id, text, t, n, unnest(generate_series(1, len(t) - n + 1)) AS s
        FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows))
),
found AS (SELECT doc_id, text, s, p.n, item_id FROM placed p JOIN windows USING (n, w)),
hit AS (SELECT doc_id, text, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, text, unnest(generate_series(s, s + n - 1)) AS word FROM found) GROUP BY ALL),
held AS (
  SELECT doc_id, text, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, text, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY ALL
)
SELECT d.doc_id, len(d.t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d
LEFT JOIN hit h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text IS NOT DISTINCT FROM h.text
LEFT JOIN held i ON d.doc_id IS NOT DISTINCT FROM i.doc_id AND d.text IS NOT DISTINCT FROM i.text
"""
)

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

AUDIT = r"""
WITH said AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(docs.doc_id > first, false)] AS fails
  FROM docs LEFT JOIN said ON docs.doc_id = said.doc_id
),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
met AS (
  SELECT kinds.*, o, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda s: fails[ascii(substr(o, s, 1)) - 64])), 6) AS first FROM kinds, orders
),
steps AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, substr(o, step, 1) AS f,
    sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN first < step AND fails[ascii(substr(o, step, 1)) - 64] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN list_count(list_filter(fails, lambda y: y)) = 1 AND fails[ascii(substr(o, step, 1)) - 64] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM met, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""

# DuckDB has no CRC-32: a table of 256 numbers, then one step for each byte of each different word.
RESAMPLE = (
    r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
),
docs AS (SELECT doc_id, """
    + _WORDS
    + r""" AS w FROM documents),
target AS (SELECT """
    + _WORDS
    + r""" AS w FROM benchmark),
different AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM docs UNION ALL SELECT w FROM target)),
hashed AS (
  SELECT word, xor(list_reduce(
      list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM different, crc
),
placed AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(w) AS word FROM docs) JOIN hashed USING (word)),
source AS (SELECT bucket, count(*) AS s FROM placed GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM target) JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM source) AS ss, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM wanted) AS tt),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS g
  FROM source LEFT JOIN wanted USING (bucket), totals
),
summed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM placed JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs d LEFT JOIN summed USING (doc_id)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) * 10 // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""
)

SQL = {
    "op4_chat_format": CHAT,
    "op8_decontaminate": DECONTAMINATE,
    "op11_exact_dedup": EXACT,
    "op12_filter_audit": AUDIT,
    "op13_resample": RESAMPLE,
}
