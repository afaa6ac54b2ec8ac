"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import ledger

#: A turn is escaped if its role or text holds a control string, or anything that unescaping would change.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_matches(role || chr(0) || text, '</?s>|\[/?INST\]|[<\[]\\/?(s>|INST\])|\\\\') AS unsafe FROM turns
), sized AS (
  SELECT *, CASE WHEN unsafe THEN
      length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'))
    ELSE length(role) + length(text) END AS inner_chars FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(inner_chars + 17))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _kind(rank: int, rule: ledger.Rule) -> str:
    """Places of a rule's matches: gaps between them and their sizes, summed up in order."""
    pattern = rule.pattern.replace("'", "''")
    inner = f"regexp_extract_all(text, '{pattern}', {rule.group})" if rule.group else "found"
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, list_transform(range(1, len(found) + 1), lambda i: {{
      'start': list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[:i - 1], lambda m: length(m))), 0),
      'size': length(found[i]), 'inner': length(inners[i])}}) AS places
  FROM (SELECT doc_id, found, {inner} AS inners, string_split_regex(text, '{pattern}') AS gaps
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS found FROM docs WHERE regexp_matches(text, '{pattern}')))"""


def secrets_sql(rules=ledger.RULES, base=ledger.BASE_RULES) -> str:
    parts = "\n  UNION ALL".join(_kind(i, r) for i, r in enumerate(rules))
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    n = len(base)
    item = "kind || ':' || start || ':' || (start + size)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), hits AS ({parts}
), spans AS (
  SELECT doc_id, rank, kind, p.start::BIGINT AS start, p.size::BIGINT AS size FROM (SELECT doc_id, rank, kind, unnest(places) AS p FROM hits)
  WHERE p.inner >= CASE rank {least} END
), found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)},
    string_agg({item}, ',' ORDER BY start, rank) FILTER (rank < {n}) AS base, string_agg({item}, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)
"""
