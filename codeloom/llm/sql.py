"""SQL that states the same results over the same tables, where SQL can."""

from __future__ import annotations

_HELD = """
held AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM code_chunks WHERE id IS NOT NULL
  ) WHERE rn = 1
)"""

_TERMS = (
    "WITH"
    + _HELD
    + """, raw AS (
  SELECT id, coalesce(nullif(lower(trim(language)), ''), 'unknown') AS language, lower(trim(unnest(subwords))) AS token FROM held
), cells AS (
  SELECT id, language, token, count(*) AS n FROM raw WHERE token IS NOT NULL AND token <> '' GROUP BY ALL
)"""
)

_STATED = """, stated AS (
  SELECT token, language, sum(doc_count) AS s, max(CASE WHEN doc_count IS NULL THEN 1 ELSE 0 END) AS partial FROM (
    SELECT lower(trim(token)) AS token,
      CASE WHEN language IS NULL OR trim(language) = '' THEN 'unknown' ELSE
        CASE ltrim(lower(trim(language)), '.')
          WHEN 'py' THEN 'python' WHEN 'golang' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
          WHEN 'md' THEN 'markdown' WHEN 'yml' THEN 'yaml' WHEN 'sh' THEN 'shell' WHEN 'bash' THEN 'shell'
          WHEN 'docker' THEN 'dockerfile' ELSE ltrim(lower(trim(language)), '.') END END AS language, doc_count
    FROM (SELECT DISTINCT token, language, doc_count, shard FROM subword_stats)
  ) WHERE token <> '' GROUP BY ALL
), counted AS (
  SELECT c.token, c.language, sum(c.n) AS occurrences, count(*) AS records, any_value(t.n) AS total
  FROM cells c JOIN (
    SELECT coalesce(nullif(lower(trim(language)), ''), 'unknown') AS language, count(*) AS n FROM held GROUP BY 1
  ) t USING (language) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.2 * total THEN 'common' END AS mark FROM counted
)"""

ORACLES = {
    "p3_found": _TERMS
    + """
SELECT c.id AS chunk_id, c.token FROM cells c
JOIN (SELECT token, count(*) AS d FROM cells GROUP BY token) t USING (token) WHERE c.n >= 3 AND t.d BETWEEN 2 AND 8""",
    "p3_scores": _TERMS
    + """, rows_ AS (SELECT id, sum(n) AS r FROM cells GROUP BY id
), cols AS (SELECT token, sum(n) AS c, count(*) AS d FROM cells GROUP BY token
), g AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM cells
), e AS (
  SELECT id, token, n, d, r * c / total AS e, (1 - r / total) * (1 - c / total) AS v
  FROM cells JOIN rows_ USING (id) JOIN cols USING (token), g
)
SELECT id AS chunk_id, token, n, d AS doc_count, CASE WHEN e * v > 0 THEN round((n - e) / sqrt(e * v), 4) END AS score FROM e""",
    "p6_found": "WITH"
    + _HELD
    + """
SELECT id AS chunk_id, CASE WHEN list_max(list_transform(string_split(content, chr(10)),
    lambda x: CASE WHEN ends_with(x, chr(13)) THEN length(x) - 1 ELSE length(x) END)) > 2000
  THEN 'inside_line' ELSE 'between_lines' END AS cut_kind
FROM held WHERE length(content) > 2000""",
    "p6_cover": "WITH"
    + _HELD
    + " SELECT id AS chunk_id, CAST(length(content) AS INTEGER) AS size, true AS within, true AS shares, md5(content) AS rebuilt FROM held WHERE length(content) > 2000",
    "p7_found": _TERMS + _STATED + "SELECT token, language, mark FROM marked WHERE mark IS NOT NULL",
    "p7_terms": _TERMS
    + _STATED
    + """
SELECT coalesce(m.token, s.token) AS token, coalesce(m.language, s.language) AS language,
  CAST(coalesce(m.occurrences, 0) AS BIGINT) AS occurrences, coalesce(m.records, 0) AS records,
  CAST(CASE WHEN s.partial = 1 OR s.s IS NULL THEN coalesce(m.records, 0) ELSE s.s END AS BIGINT) AS stated_records, m.mark
FROM marked m FULL JOIN stated s ON m.token = s.token AND m.language = s.language""",
}
