"""Queries on analyses (C26, D31, G07, G08, G17, H, I12, I15, J14, J20) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import analysis as A
from codeloom.queries.base import Area
from codeloom.sources import catalogue as T
from codeloom.sources.tables import table

query = Area()


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(code_context, '{pattern}'))"


@query(f"SELECT id, a::INT AS assertions, m::INT AS mocks, e AS errors, CASE WHEN a = 0 THEN 'stub' WHEN a >= 3 OR e OR (m > 0 AND a >= 2) THEN 'thorough' WHEN a = 1 THEN 'thin' ELSE 'adequate' END AS tier FROM (SELECT id, {_count(A.ASSERTIONS)} AS a, {_count(A.MOCKS)} AS m, {_count(A.ERRORS)} > 0 AS e FROM s WHERE kind IN ('function','method') AND regexp_matches(file_path, '@TEST@') AND code_context IS NOT NULL)")
def d31_h33_test_quality(spark, d):
    return A.test_quality(T.symbols(spark, d, "kind", "file_path", "code_context"))


@query("SELECT id, CASE WHEN kind IN ('class','struct','module','namespace') THEN 'test_container' WHEN regexp_matches(lower(name), '^(set_?up|before)') THEN 'fixture_setup' WHEN regexp_matches(lower(name), '^(tear_?down|after)') THEN 'fixture_teardown' WHEN regexp_matches(lower(name), '^test|test$|^should|^it_') THEN 'test_case' WHEN kind IN ('function','method') THEN 'test_helper' END AS role FROM s WHERE regexp_matches(file_path, '@TEST@')")
def h37_test_roles(spark, d):
    s = T.symbols(spark, d, "name", "kind", "file_path")
    return s.filter(A.paths.is_test_path(F.col("file_path"))).select("id", A.test_role(F.col("name"), F.col("kind"), F.col("file_path")).alias("role"))


@query("SELECT id, CASE WHEN kind IN ('class','struct','interface','trait') THEN 'class' WHEN kind IN ('function','method','constructor') THEN 'callable' WHEN kind IN ('module','namespace') THEN 'module' WHEN kind IN ('type','enum') THEN 'type' ELSE kind END AS kind_group, (CASE WHEN contains(name, '_') OR length(name) >= 12 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN lower(name) IN (" + ", ".join(f"'{n}'" for n in A.NOISE_NAMES) + ") THEN 0.5::DOUBLE WHEN length(name) <= 2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS signal, CASE WHEN lower(name) = 'quota' THEN 3.0 WHEN starts_with(lower(name), 'quota') THEN 2.0 WHEN contains('_' || lower(name) || '_', '_quota_') THEN 1.5 WHEN contains(lower(name), 'quota') THEN 1.2 ELSE 1.0 END::DOUBLE AS boost FROM s")
def h43_h51_h53_name_signals(spark, d):
    n = F.col("name")
    return T.symbols(spark, d, "name", "kind").select("id", A.kind_group(F.col("kind")).alias("kind_group"), A.variable_signal(n).alias("signal"), A.exact_match_boost(n, "quota").alias("boost"))


@query("SELECT id, substring(concat_ws(' ', kind, name, string_split(coalesce(signature, ''), chr(10))[1], coalesce(doc_comment, ''), 'in: ' || file_path), 1, 1200) AS text FROM s WHERE kind IN ('function','method','class','struct','interface','trait','enum','type','module','namespace') AND NOT regexp_matches(file_path, '@TEST@') AND coalesce(language, '') NOT IN ('markdown','json','toml','yaml')")
def j20_h46_embedding_text(spark, d):
    return A.embedding_text(T.symbols(spark, d, "kind", "name", "signature", "doc_comment", "file_path", "language"))


_LAST = "SELECT DISTINCT file_path FROM revision_file_changes WHERE revision = (SELECT max(revision) FROM revision_file_changes) AND change_kind <> 'deleted'"


def _changed(spark, d):
    c = table(spark, d, "revision_file_changes")
    last = c.agg(F.max("revision").alias("r"))
    return c.join(F.broadcast(last), F.col("revision") == F.col("r"), "left_semi").filter("change_kind <> 'deleted'").select("file_path")


@query(f"SELECT id FROM s WHERE file_path IN ({_LAST}) AND coalesce(kind, '') NOT IN ('import','export')")
def g07_seeds(spark, d):
    return A.seeds(T.symbols(spark, d, "kind", "file_path"), [], [], _changed(spark, d))


@query(rf"""WITH sd AS (SELECT id AS seed, name, file_path AS sp, regexp_replace(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.[^.]*$', ''), '^test_|_test$', '') AS st FROM s WHERE file_path IN ({_LAST}) AND coalesce(kind, '') NOT IN ('import','export') AND NOT regexp_matches(file_path, '@TEST@')),
 t AS (SELECT id AS test, regexp_replace(regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.[^.]*$', ''), '^test_|_test$', '') AS st FROM s WHERE regexp_matches(file_path, '@TEST@') AND kind IN ('function','method')),
 al AS (SELECT seed, test, 1 AS tier FROM e JOIN sd ON e.to_id = seed JOIN t ON e.from_id = test UNION SELECT seed, test, 2 FROM i JOIN sd ON i.name = sd.name JOIN t ON i.containing_symbol_id = test UNION SELECT seed, test, 3 FROM sd JOIN t USING (st) WHERE length(st) >= 8),
 f AS (SELECT seed, test, min(tier) AS tier FROM al GROUP BY 1, 2), b AS (SELECT seed, min(tier) AS tier FROM f GROUP BY 1) SELECT seed, test, tier::INT AS tier FROM f JOIN b USING (seed, tier)""".replace("f AS (SELECT seed", "fx AS (SELECT seed").replace("FROM f GROUP BY 1)", "FROM fx GROUP BY 1)").replace("FROM f JOIN b", "FROM fx JOIN b"))
def g08_likely_tests(spark, d):
    s = T.symbols(spark, d, "name", "kind", "file_path")
    seed = A.seeds(s.drop("name"), [], [], _changed(spark, d))
    return A.likely_tests(seed, s, T.edges(spark, d), T.identifiers(spark, d, "name", "containing_symbol_id"))


@query("SELECT i.name, i.file_path, i.containing_symbol_id, min(i.start_line) AS line FROM i WHERE i.name IN ('cache_quota','parse_manifest','settle_meter','route_relay','merge_token') AND i.containing_symbol_id IN (SELECT id FROM s WHERE regexp_matches(file_path, '@TEST@')) GROUP BY 1, 2, 3")
def g17_test_references(spark, d):
    return A.test_references(T.symbols(spark, d, "file_path"), T.identifiers(spark, d, "name", "file_path", "containing_symbol_id", "start_line"), ["cache_quota", "parse_manifest", "settle_meter", "route_relay", "merge_token"])


@query(r"""WITH x AS (SELECT s.*, s.id IN (SELECT to_id FROM e) AS used FROM s WHERE kind IN ('function','method') AND NOT regexp_matches(file_path, '@TEST@'))
 SELECT id, 'entry_point' AS warning FROM x WHERE regexp_matches(lower(name), '^(main|run|handle|handler|start|serve)(_|$)') UNION ALL SELECT id, 'unreferenced' FROM x WHERE visibility = 'public' AND NOT used UNION ALL SELECT id, 'undocumented_hot' FROM x WHERE coalesce(reference_score, 0) >= 5 AND coalesce(trim(doc_comment), '') = ''""")
def j14_early_warnings(spark, d):
    return A.warnings(T.symbols(spark, d, "name", "kind", "file_path", "visibility", "doc_comment", "reference_score"), T.edges(spark, d))


@query("WITH n AS (SELECT workspace_id, max(last_indexed) AS newest, count(*) AS files FROM f GROUP BY 1) SELECT w.workspace_id, coalesce(n.files, 0)::BIGINT AS files, CASE WHEN w.last_indexed IS NULL THEN 'missing' WHEN n.newest > w.last_indexed THEN 'stale' ELSE 'ready' END AS state FROM workspaces w LEFT JOIN n ON w.workspace_id = n.workspace_id")
def i15_freshness(spark, d):
    return A.freshness(table(spark, d, "workspaces"), T.files(spark, d, "workspace_id", "last_indexed"))


@query("WITH r AS (SELECT id, session_id, called_at, list_distinct(regexp_extract_all(lower(coalesce(metadata, '')), '[a-z0-9]+')) AS words FROM tc WHERE tool_name IN ('find_text','rank_hits') AND session_id IS NOT NULL AND called_at IS NOT NULL), l AS (SELECT *, lag(words) OVER (PARTITION BY session_id ORDER BY called_at, id) AS before FROM r) SELECT id FROM l WHERE before IS NOT NULL AND greatest(len(words), len(before)) > 0 AND len(list_intersect(words, before)) * 2 >= greatest(len(words), len(before))")
def i12_repeated_searches(spark, d):
    return A.repeated_searches(T.tool_calls(spark, d, "session_id", "tool_name", "metadata"), ("find_text", "rank_hits"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
