"""DuckDB SQL for the rows of those queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
),
found AS (SELECT r, i, grams.n, item_id FROM grams JOIN windows USING (g, n)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

TOOL_CALLS = """
WITH calls AS (SELECT conv_id, turn, role, text, 'turn-' || turn AS call_id FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
results AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, min(text) AS result, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT calls.conv_id, calls.call_id, row_number() OVER (PARTITION BY calls.conv_id ORDER BY turn, calls.call_id, role, text) - 1 AS step,
       n IS NOT NULL AS linked, false AS cyclic, role IN ('system', 'user') AND text IS NOT NULL AS valid,
       CASE WHEN role NOT IN ('system', 'user') THEN 'unknown tool' WHEN text IS NULL THEN 'missing text' ELSE '' END AS errors,
       coalesce(n, 0) AS n_results,
       '{"arguments":{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '},"call_id":' || to_json(calls.call_id)::VARCHAR
         || ',"name":' || to_json(coalesce(role, ''))::VARCHAR || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json
FROM calls LEFT JOIN results ON calls.conv_id IS NOT DISTINCT FROM results.conv_id AND calls.call_id = results.call_id
"""

ORACLE = {"op5_decontamination": DECONTAMINATION, "op6_tool_calls": TOOL_CALLS}
