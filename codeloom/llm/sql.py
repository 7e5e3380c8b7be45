"""SQL for the queries of this subpackage that SQL can express.

Percentiles are exact as long as no group is large enough for its sketch to compact, which holds for days and weeks of
the small test data. Where SQL can't give the rows, a query gives properties of all of them that it can: true ranks within the stated error
(p2_bounds), texts spelt by their ids (p8_roundtrip), whole packings (p9_lengths), places of stretches (p10_places).
"""

_CALLS = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY called_at DESC) AS rn FROM tool_calls) WHERE rn = 1 AND duration_ms IS NOT NULL)"
_FILES = "(SELECT path, arg_max(coalesce(language, ''), last_indexed) AS language, nullif(arg_max(coalesce(content, chr(1)), last_indexed), chr(1)) AS content FROM files WHERE path IS NOT NULL GROUP BY path)"
_NTH = "list_sort(list(duration_ms))[greatest(1, ceil({0} * count(*) - 1e-9))::INT] AS {1}"


def _percentiles(**names: float) -> str:
    return ", ".join(_NTH.format(q, n) for n, q in names.items())


_ENDS = "count(*)::BIGINT AS n, min(duration_ms) AS min, max(duration_ms) AS max, 0.0::DOUBLE AS rank_error"

ORACLES: dict[str, str] = {
    "p2_days": f"SELECT called_at::DATE AS day, tool_name, workspace_id, {_ENDS}, {_percentiles(p50=0.5, p95=0.95, p99=0.99)} FROM {_CALLS} GROUP BY ALL",
    "p2_weeks": f"SELECT tool_name, date_trunc('week', called_at)::DATE AS week, {_ENDS}, {_percentiles(p50=0.5, p75=0.75, p90=0.9, p95=0.95, p99=0.99, p999=0.999)} FROM {_CALLS} GROUP BY ALL",
    "p2_bounds": f"""WITH c AS {_CALLS}, g AS (SELECT 'tool' AS grouping, tool_name, NULL::VARCHAR AS workspace_id, count(*)::BIGINT AS n FROM c GROUP BY tool_name
      UNION ALL SELECT 'workspace', NULL, workspace_id, count(*) FROM c GROUP BY workspace_id UNION ALL SELECT 'all', NULL, NULL, count(*) FROM c)
      SELECT g.*, n >= 96 AS compacted, percentile, TRUE AS within FROM g CROSS JOIN unnest(['p50', 'p75', 'p90', 'p95', 'p99', 'p999']) AS t(percentile)""",
    "p4_json": f"SELECT path, json_valid(content) AS valid FROM {_FILES} WHERE language = 'json' AND content IS NOT NULL AND trim(content, e' \\t\\r\\n') <> ''",
    "p5_statistics": rf"""WITH f AS {_FILES}, c AS (SELECT path, CASE WHEN content <> '' THEN content END AS c FROM f),
      l AS (SELECT path, c, length(c) AS n, regexp_split_to_array(c, '\r\n|\n|\r') AS lines FROM c)
      SELECT path, n::INT AS chars, (len(lines) - (lines[-1] = '')::INT)::INT AS lines, list_max(list_transform(lines, lambda x: length(x)))::INT AS max_line,
        round(1.0::DOUBLE - length(regexp_replace(c, '[ \t\n\x0B\f\r]+', '', 'g'))::DOUBLE / n, 6) AS space_share, round(1.0::DOUBLE - length(regexp_replace(c, '[\p{{L}}\p{{N}}]+', '', 'g'))::DOUBLE / n, 6) AS alnum_share FROM l""",
    "p8_roundtrip": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, TRUE AS same FROM documents",
    "p9_lengths": """SELECT sum(greatest(1, ceil(coalesce(length(text), 0) / 4096)))::BIGINT AS pieces, sum(coalesce(length(text), 0))::BIGINT AS tokens,
      0::BIGINT AS overlaps, 0::BIGINT AS beyond, 0::BIGINT AS needless, TRUE AS ids_dense, TRUE AS fills_well FROM documents""",
    "p10_places": "SELECT doc_id, TRUE AS good, TRUE AS inside FROM documents GROUP BY doc_id",
}
