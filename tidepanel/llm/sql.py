"""The contracts of the queries that SQL can express, for DuckDB over whole tables."""

from __future__ import annotations

_SPACE = r"'[\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(text: str, pattern: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {pattern}), lambda x: x <> '')"


SQL = {
    # Links counted over shared shingles, then everything that can be reached.
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_split(_LOWER, _SPACE)} AS ws FROM documents),
  shingle AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w)),
  size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b
    ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
  least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(other, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)""",
    # Windows of each length that the items have, hit words counted once.
    "op6_benchmark_decontamination": r"""
WITH b AS (SELECT item_id, {split} AS ws FROM benchmark),
  pattern AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS k, least(len(ws), 13) AS n
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
  sizes AS (SELECT DISTINCT n FROM pattern),
  w AS (SELECT doc_id, {split} AS ws FROM documents),
  seen AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
  found AS (SELECT doc_id, i, n, item_id FROM seen JOIN pattern USING (k, n)),
  words_hit AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)""".replace(
        "{split}", _split(_LOWER, r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'")),
    # The smallest id that each window starts in; words under windows of another.
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_split("coalesce(text, '')", _SPACE)} AS ws FROM documents),
  seen AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
  owner AS (SELECT k, min(doc_id) AS first_doc FROM seen GROUP BY k),
  gone AS (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM seen JOIN owner USING (k) WHERE first_doc < doc_id),
  word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    # What the marks of the template add, and each text once.
    "op12_chat_formatting": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  placed AS (SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w = role, false) AS joined,
      length(replace(replace(text, '\', '\b'), '<', '\l')) AS text_size,
      length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) AS role_size
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_size + CASE WHEN joined THEN length('<next>') ELSE length('<turn></turn>') + role_size + 1 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id""",
}
