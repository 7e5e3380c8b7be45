"""Queries on the catalogue: lookups, filters, counts, rankings (B, D, E, H) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import naming, paths, risk, text
from codeloom.operators import catalog as C
from codeloom.queries.base import Area
from codeloom.sources import catalogue as T
from codeloom.sources.tables import table

query = Area()
NAMES = ("cache_quota", "parse_manifest", "settle_meter", "shift_invoice", "route_relay")
_IN = ", ".join(f"'{n}'" for n in NAMES)


@query(f"SELECT id, name, language, file_path FROM s WHERE name IN ({_IN})")
def b01_b03_names(spark, d):
    return C.lookup(T.symbols(spark, d, "name", "language", "file_path"), "name", NAMES).select("id", "name", "language", "file_path")


@query("SELECT name, count(*)::BIGINT AS symbols, min(id) AS first_id, array_to_string(list_sort(list(DISTINCT file_path)), ',') AS files FROM s WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1")
def b03_names_grouped(spark, d):
    rows = T.symbols(spark, d, "name", "file_path").filter(F.col("name").isNotNull())
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("symbols"), F.min("id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("file_path")), ",").alias("files")).filter("symbols > 1")


@query("SELECT c.id, c.parent_id, c.start_line FROM s c JOIN s p ON c.parent_id = p.id WHERE p.kind = 'class'")
def b04_children(spark, d):
    parents = T.symbols(spark, d, "kind").filter("kind = 'class'").select("id")
    return C.lookup_joined(T.symbols(spark, d, "parent_id", "start_line"), "parent_id", parents).select("id", "parent_id", "start_line")


@query("SELECT file_path, id, name, kind, start_line, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id)::INT AS place FROM s")
def b05_b06_outline(spark, d):
    from pyspark.sql import Window

    s = T.symbols(spark, d, "file_path", "name", "kind", "start_line")
    return s.select("file_path", "id", "name", "kind", "start_line", F.row_number().over(Window.partitionBy("file_path").orderBy(F.asc_nulls_last("start_line"), "id")).alias("place"))


@query("SELECT file_path, array_to_string(list_sort(list(DISTINCT lower(name))), ' ') AS titles FROM s WHERE kind IN ('class','struct','interface','trait','enum','function','method','constructor','module','namespace','type','constant','delegate') AND name IS NOT NULL GROUP BY file_path")
def b07_titles(spark, d):
    s = T.symbols(spark, d, "file_path", "name", "kind").filter(F.col("kind").isin(*C.DEFINITION_KINDS) & F.col("name").isNotNull())
    return s.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set(F.lower("name"))), " ").alias("titles"))


@query("SELECT id, name, file_path FROM s WHERE name ILIKE '%quota%' OR code_context ILIKE '%quota%' ORDER BY name, file_path, id LIMIT 1000")
def b08_like_search(spark, d):
    return C.like_search(T.symbols(spark, d, "name", "file_path", "code_context"), "quota", ["name", "code_context"]).select("id", "name", "file_path")


@query("SELECT id, name FROM (SELECT id, language || '.' || name AS name, kind, reference_score, file_path FROM s) WHERE lower(name) LIKE '%.' || 'quotastore' AND name <> 'QuotaStore' AND kind IN ('class','struct','interface','trait','enum','function','method','constructor','module','namespace','type','constant','delegate') ORDER BY reference_score DESC NULLS LAST, name, file_path, id LIMIT 50")
def b09_qualified_suffix(spark, d):
    s = T.symbols(spark, d, "name", "language", "kind", "file_path", "reference_score").withColumn("name", F.concat_ws(".", "language", "name"))
    return C.qualified_suffix(s, "QuotaStore", 50).select("id", "name")


@query("SELECT kind, language, semantic_group, count(*)::BIGINT AS n FROM s WHERE kind IN ('function','method') AND language = 'python' GROUP BY ALL")
def b10_b12_filters(spark, d):
    s = T.symbols(spark, d, "kind", "language", "semantic_group")
    return C.lookup(C.lookup(s, "kind", ["function", "method"]), "language", "python").groupBy("kind", "language", "semantic_group").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT DISTINCT name AS n FROM s WHERE kind IN ('function','struct')) SELECT DISTINCT i.id, i.name FROM i JOIN n ON i.name = n.n OR starts_with(i.name, n.n || '::') OR starts_with(i.name, n.n || '.')")
def b13_b15_identifiers(spark, d):
    names = T.symbols(spark, d, "name", "kind").filter("kind in ('function', 'struct') and name is not null").select("name")
    return C.names_or_members(T.identifiers(spark, d, "name"), names).select("id", "name")


@query("WITH n AS (SELECT DISTINCT name AS n FROM s WHERE kind IN ('function','method')), x AS (SELECT id FROM s WHERE regexp_matches(file_path, '@TEST@')) SELECT DISTINCT i.id, i.name FROM i JOIN n ON i.name = n.n WHERE i.kind IN ('call','member_access') AND (i.containing_symbol_id IS NULL OR i.containing_symbol_id NOT IN (SELECT id FROM x))")
def b16_identifiers_outside(spark, d):
    s = T.symbols(spark, d, "name", "kind", "file_path")
    names = s.filter("kind in ('function', 'method')").select("name")
    tests = s.filter(paths.is_test_path(F.col("file_path"))).select(F.col("id").alias("containing_symbol_id"))
    uses = T.identifiers(spark, d, "name", "kind", "containing_symbol_id").filter(F.col("kind").isin("call", "member_access"))
    return C.names_or_members(uses.join(tests, "containing_symbol_id", "left_anti"), names).select("id", "name")


@query("SELECT DISTINCT i.file_path, i.name FROM i JOIN (SELECT DISTINCT file_path, name FROM s WHERE kind IN ('function','method','class')) w ON i.file_path = w.file_path AND i.name = w.name")
def b17_presence(spark, d):
    wanted = T.symbols(spark, d, "file_path", "name", "kind").filter("kind in ('function', 'method', 'class')")
    return C.presence(T.identifiers(spark, d, "file_path", "name"), ["file_path", "name"], wanted)


@query("SELECT DISTINCT i.containing_symbol_id, i.name FROM i JOIN (SELECT DISTINCT containing_symbol_id AS c, name FROM i WHERE kind = 'call' AND regexp_matches(file_path, '@TEST@')) w ON i.containing_symbol_id = w.c AND i.name = w.name")
def b18_scoped_presence(spark, d):
    uses = T.identifiers(spark, d, "containing_symbol_id", "name", "kind", "file_path")
    wanted = uses.filter((F.col("kind") == "call") & paths.is_test_path(F.col("file_path"))).filter("containing_symbol_id is not null and name is not null")
    return C.presence(T.identifiers(spark, d, "containing_symbol_id", "name"), ["containing_symbol_id", "name"], wanted)


@query("SELECT e.id, e.from_id, e.to_id, e.kind FROM e WHERE e.to_id IN (SELECT id FROM s WHERE kind = 'method') AND e.kind = 'calls'")
def b19_b21_incoming(spark, d):
    return C.lookup_joined(T.edges(spark, d), "to_id", T.symbols(spark, d, "kind").filter("kind = 'method'").select("id")).filter("kind = 'calls'").select("id", "from_id", "to_id", "kind")


@query("SELECT id, file_path, start_byte, end_byte, row_number() OVER (PARTITION BY file_path ORDER BY start_byte, end_byte, id)::INT AS place FROM sr WHERE kind IN ('comment','doc_comment')")
def b22_regions(spark, d):
    from pyspark.sql import Window

    r = C.lookup(T.source_regions(spark, d, "file_path", "kind", "start_byte", "end_byte"), "kind", ["comment", "doc_comment"])
    return r.select("id", "file_path", "start_byte", "end_byte", F.row_number().over(Window.partitionBy("file_path").orderBy(F.asc_nulls_last("start_byte"), F.asc_nulls_last("end_byte"), "id")).alias("place"))


@query("SELECT id, name, json_extract_string(metadata, '$.arity') AS arity FROM s WHERE json_valid(metadata) AND json_extract_string(metadata, '$.is_async') = 'true' AND language IN ('python','rust')")
def b23_facts_by_json(spark, d):
    s = T.symbols(spark, d, "name", "language", "metadata").filter(F.col("language").isin("python", "rust"))
    ok = F.get_json_object("metadata", "$.is_async") == "true"
    return s.filter(ok).select("id", "name", F.get_json_object("metadata", "$.arity").alias("arity"))


@query(r"SELECT path, language FROM f WHERE regexp_matches(path, '^(?:.*/)?(?:src|lib)/(?:.*/)?[^/]*\.(?:rs|py)$') AND NOT regexp_matches(path, '^(?:.*/)?index\.[^/]*$')")
def b24_glob(spark, d):
    return T.files(spark, d, "language").filter(C.glob(F.col("path"), "**/{src,lib}/**/*.{rs,py}, !**/index.*")).select("path", "language")


@query("SELECT DISTINCT l.file_path, l.start_line AS line FROM i l JOIN sr r ON l.file_path = r.file_path AND l.start_line BETWEEN r.start_line AND r.end_line WHERE r.kind IN ('doc_comment','comment')")
def b26_lines_in_regions(spark, d):
    lines = T.identifiers(spark, d, "file_path", "start_line").select("file_path", F.col("start_line").alias("line")).distinct()
    regions = T.source_regions(spark, d, "file_path", "kind", "start_line", "end_line").filter(F.col("kind").isin("doc_comment", "comment"))
    return C.lines_in_regions(lines, regions)


@query("SELECT DISTINCT revision, workspace_id, file_path, change_kind FROM revision_file_changes WHERE revision > 18 AND revision <= 33")
def b28_revision_range(spark, d):
    return C.revision_range(table(spark, d, "revision_file_changes"), 18, 33).select("revision", "workspace_id", "file_path", "change_kind").distinct()


@query("SELECT path, last_modified FROM f WHERE last_modified >= (SELECT max(last_modified) FROM files) - 30 * 86400 ORDER BY last_modified DESC, path LIMIT 100")
def b29_recent_files(spark, d):
    now = table(spark, d, "files").agg(F.max("last_modified")).first()[0] or 0
    return C.recent_files(T.files(spark, d, "last_modified"), now, 30, 100).select("path", "last_modified")


@query("SELECT id, name, kind, language, reference_score FROM s WHERE reference_score >= 2 AND kind IN ('function','method') AND NOT regexp_matches(file_path, '@TEST@') AND regexp_matches(file_path, '(^|/)src/') ORDER BY reference_score DESC, name, file_path, id LIMIT 200")
def b30_metrics_query(spark, d):
    s = T.symbols(spark, d, "name", "kind", "language", "reference_score", "file_path")
    s = s.filter((F.col("reference_score") >= 2) & F.col("kind").isin("function", "method") & ~paths.is_test_path(F.col("file_path")) & F.col("file_path").rlike("(^|/)src/"))
    return C.ranked(s, "reference_score", 200, ("name", "file_path", "id")).select("id", "name", "kind", "language", "reference_score")


@query("SELECT identifier_id, arg_min(type_name, (ordinal, id)) AS first_type, count(*)::BIGINT AS arguments FROM ta WHERE identifier_id IS NOT NULL GROUP BY identifier_id")
def b31_b38_type_of_use(spark, d):
    t = T.type_arguments(spark, d, "identifier_id", "type_name", "ordinal").filter("identifier_id is not null")
    return t.groupBy("identifier_id").agg(F.min_by("type_name", F.struct("ordinal", "id")).alias("first_type"), F.count(F.lit(1)).alias("arguments"))


@query("SELECT id, session_id, tool_name FROM tc WHERE called_at >= (SELECT max(called_at) FROM tool_calls) - INTERVAL 7 DAY")
def b32_telemetry_window(spark, d):
    newest = table(spark, d, "tool_calls").agg((F.max("called_at") - F.expr("interval 7 days")).alias("since"))
    return T.tool_calls(spark, d, "session_id", "tool_name").crossJoin(F.broadcast(newest)).filter("called_at >= since").select("id", "session_id", "tool_name")


@query("SELECT kind, language, count(*)::BIGINT AS n FROM s GROUP BY GROUPING SETS ((kind), (language))")
def d01_symbol_stats(spark, d):
    s = T.symbols(spark, d, "kind", "language").select(F.explode(F.array(F.struct(F.col("kind"), F.lit(None).cast("string").alias("language")), F.struct(F.lit(None).cast("string").alias("kind"), F.col("language")))).alias("x"))
    return s.groupBy("x.kind", "x.language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_path, count(*)::BIGINT AS n FROM s GROUP BY file_path")
def d02_file_stats(spark, d):
    return T.symbols(spark, d, "file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT to_id AS id, count(*)::BIGINT AS n FROM e GROUP BY to_id ORDER BY n DESC, id LIMIT 50")
def d03_most_referenced(spark, d):
    return C.ranked(T.edges(spark, d).groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "n", 50, ("id",))


@query("SELECT language, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY language")
def d04_d30_languages(spark, d):
    return C.share_of_total(T.files(spark, d, "language"), "language")


@query("SELECT kind, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY kind")
def d05_d32_kinds(spark, d):
    return C.share_of_total(T.symbols(spark, d, "kind"), "kind")


@query("SELECT (SELECT count(*) FROM s)::BIGINT AS symbols, (SELECT count(*) FROM f)::BIGINT AS files, (SELECT count(*) FROM e)::BIGINT AS edges, (SELECT coalesce(sum(size), 0) FROM f)::BIGINT AS bytes, (SELECT count(DISTINCT nullif(language, '')) FROM f)::BIGINT AS languages")
def d06_d07_totals(spark, d):
    a = T.symbols(spark, d).agg(F.count(F.lit(1)).alias("symbols"))
    b = T.files(spark, d, "size", "language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct(F.nullif("language", F.lit(""))).alias("languages"))
    e = T.edges(spark, d).agg(F.count(F.lit(1)).alias("edges"))
    return a.crossJoin(b).crossJoin(e)  # three single rows


@query("SELECT kind, count(*)::BIGINT AS n, round(avg(confidence), 6) AS confidence FROM e GROUP BY kind")
def d08_edge_kinds(spark, d):
    return T.edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT id, name, reference_score FROM s WHERE reference_score > 0 ORDER BY reference_score DESC, name, file_path, id LIMIT 50")
def d09_centrality_topk(spark, d):
    return C.ranked(T.symbols(spark, d, "name", "reference_score", "file_path").filter("reference_score > 0"), "reference_score", 50, ("name", "file_path", "id")).select("id", "name", "reference_score")


@query("SELECT language, count(*)::BIGINT AS total, count(*) FILTER (coalesce(trim(doc_comment), '') <> '')::BIGINT AS documented, round(count(*) FILTER (coalesce(trim(doc_comment), '') <> '') * 100.0 / count(*), 4) AS percent FROM (SELECT coalesce(language, '') AS language, doc_comment FROM s WHERE kind IN ('class','struct','interface','trait','enum','function','method','module','namespace','type')) GROUP BY ROLLUP (language)")
def d10_doc_coverage(spark, d):
    return C.documentation_coverage(T.symbols(spark, d, "kind", "language", "doc_comment"))


@query(r"SELECT id, name, file_path FROM s WHERE visibility = 'public' AND kind IN ('class','struct','interface','trait','enum','function','method','module','namespace','type') AND coalesce(trim(doc_comment), '') = '' AND NOT regexp_matches(file_path, '@TEST@') AND NOT regexp_matches(file_path, '(^|/)(fixtures|fixture|Fixtures|Fixture|testdata|test_data|test-data|__fixtures__|snapshots|Snapshots|__snapshots__|benchmarks|Benchmarks|benchmark|Benchmark)(/|$)') ORDER BY reference_score DESC NULLS LAST, name, file_path, id LIMIT 100")
def d11_undocumented(spark, d):
    return C.undocumented(T.symbols(spark, d, "name", "kind", "visibility", "doc_comment", "file_path", "reference_score"), 100).select("id", "name", "file_path")


@query("SELECT id, name, file_path FROM s WHERE visibility = 'public' AND kind IN ('function','method') AND coalesce(reference_score, 0) < 0.1")
def d12_d13_dead_code(spark, d):
    s = T.symbols(spark, d, "name", "kind", "visibility", "file_path", "reference_score")
    return s.filter((F.col("visibility") == "public") & F.col("kind").isin("function", "method") & (F.coalesce("reference_score", F.lit(0.0)) < 0.1)).select("id", "name", "file_path")


@query("SELECT containing_symbol_id, kind, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM i WHERE kind IN ('call','member_access') AND containing_symbol_id IS NOT NULL GROUP BY ALL")
def d16_d17_names_per_container(spark, d):
    u = T.identifiers(spark, d, "containing_symbol_id", "kind", "name").filter(F.col("kind").isin("call", "member_access") & F.col("containing_symbol_id").isNotNull())
    return u.groupBy("containing_symbol_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query(r"SELECT language, kind, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS directory, json_extract_string(metadata, '$.arity') AS facet, count(*)::BIGINT AS n FROM s WHERE json_valid(metadata) AND json_extract_string(metadata, '$.arity') IS NOT NULL GROUP BY ALL")
def d18_d19_pattern_summary(spark, d):
    s = T.symbols(spark, d, "language", "kind", "file_path", "metadata").withColumn("facet", F.get_json_object("metadata", "$.arity")).filter("facet is not null")
    return s.groupBy("language", "kind", paths.directory(F.col("file_path")).alias("directory"), "facet").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT workspace_id, count(*)::BIGINT AS files, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(sum(symbol_count), 0)::BIGINT AS symbols, max(last_indexed) AS newest FROM f GROUP BY workspace_id")
def d26_d27_workspace_usage(spark, d):
    return T.files(spark, d, "workspace_id", "size", "symbol_count").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("symbols"), F.max("last_indexed").alias("newest"))


@query("WITH n AS (SELECT count(*) AS n FROM s WHERE reference_score IS NOT NULL), r AS (SELECT reference_score, row_number() OVER (ORDER BY reference_score DESC, id) AS rn FROM s WHERE reference_score IS NOT NULL) SELECT reference_score AS p95 FROM r, n WHERE rn = floor(n * 0.05) + 1")
def d24_k13_p95_score(spark, d):
    s = T.symbols(spark, d, "reference_score").filter("reference_score is not null")
    out = C.nth_element(s.withColumn("x", -F.col("reference_score")).withColumn("g", F.lit(1)), ["g"], "x", {"x": 0.05})
    return out.select((-F.col("x")).alias("p95"))


@query("SELECT count(*)::BIGINT AS vectors, (SELECT count(*) FROM f) + (SELECT count(*) FROM s) AS documents FROM embeddings")
def d36_d37_source_counts(spark, d):
    docs = T.symbols(spark, d).select("id").unionByName(T.files(spark, d).select(F.col("path").alias("id"))).agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors")).crossJoin(docs)


@query("SELECT file_path, id, name, reference_score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY reference_score DESC NULLS LAST, name, id) AS rank FROM s WHERE kind IN ('function','method')) WHERE rank <= 3")
def e08_top_per_file(spark, d):
    s = T.symbols(spark, d, "file_path", "name", "kind", "reference_score").filter(F.col("kind").isin("function", "method"))
    return C.top_per_group(s, ["file_path"], [F.desc_nulls_last("reference_score"), F.asc_nulls_last("name"), "id"], 3).select("file_path", "id", "name", "reference_score", "rank")


@query("SELECT id, name, CASE WHEN kind IN ('class','interface') THEN 1 WHEN kind = 'function' THEN 2 WHEN kind IN ('method','constructor') THEN 3 WHEN kind IN ('type','enum') THEN 4 WHEN kind IN ('variable','constant') THEN 5 ELSE 10 END AS priority FROM s ORDER BY priority, name, file_path, id LIMIT 500")
def e10_definition_priority(spark, d):
    k = F.col("kind")
    p = F.when(k.isin("class", "interface"), 1).when(k == "function", 2).when(k.isin("method", "constructor"), 3).when(k.isin("type", "enum"), 4).when(k.isin("variable", "constant"), 5).otherwise(10)
    return T.symbols(spark, d, "name", "kind", "file_path").withColumn("priority", p).orderBy("priority", F.asc_nulls_last("name"), "file_path", "id").limit(500).select("id", "name", "priority")


@query("SELECT id, name FROM s ORDER BY name, file_path, id LIMIT 100 OFFSET 200")
def e11_page(spark, d):
    return C.page(T.symbols(spark, d, "name", "file_path"), [F.asc_nulls_last("name"), "file_path", "id"], 200, 100).select("id", "name")


_SEG = {k: paths.segment_pattern(v) for k, v in {"vendor": paths.VENDOR_SEGMENTS, "generated": paths.GENERATED_SEGMENTS, "docs": paths.DOCS_SEGMENTS}.items()}
_ROLE = f"CASE WHEN regexp_matches(path, '{_SEG['vendor']}') THEN 'vendor' WHEN regexp_matches(path, '{_SEG['generated']}') THEN 'generated' WHEN regexp_matches(path, '@TEST@') THEN 'test' WHEN regexp_matches(path, '{_SEG['docs']}') OR language IN ('markdown','json','toml','yaml') THEN 'docs' ELSE 'source' END"


@query(f"SELECT path, {_ROLE} AS role, CASE WHEN NOT regexp_matches(path, '@TEST@') THEN '' ELSE lower(regexp_extract(path, '(?:^|/)(integration|smoke|unit)(?:/|$)', 1)) END AS subrole, regexp_replace(path, '/[^/]*$', '') AS directory, CASE WHEN lower(path) LIKE '%node_modules%' OR lower(path) LIKE '%vendor%' THEN 0.1 WHEN lower(path) LIKE '%docs%' OR lower(path) LIKE '%documentation%' THEN 0.2 WHEN regexp_matches(lower(path), '(^|/)(tests?|specs?)/|/__tests__/') THEN 0.4 WHEN lower(path) LIKE '%src%' OR lower(path) LIKE '%lib%' THEN 1.0 ELSE 0.7 END::DOUBLE AS weight FROM f")
def h16_h22_path_roles(spark, d):
    p = F.col("path")
    return T.files(spark, d, "language").select("path", paths.role(p, F.col("language")).alias("role"), paths.test_subrole(p).alias("subrole"), paths.directory(p).alias("directory"), paths.directory_weight(p).cast("double").alias("weight"))


@query(r"SELECT name, snake, replace(snake, '_', '-') AS kebab, upper(snake) AS screaming, lower(regexp_replace(name, '[^\p{L}\p{N}]', '', 'g')) AS compact FROM (SELECT DISTINCT name, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1_\2', 'g'), '([^_\-])(\p{Lu}\p{Ll})', '\1_\2', 'g'), '[_-]+', '_', 'g'), '^_', '')) AS snake FROM s WHERE name IS NOT NULL)")
def h01_h09_naming(spark, d):
    n = F.col("name")
    rows = T.symbols(spark, d, "name").select("name").filter("name is not null").distinct()
    return rows.select("name", naming.snake_case(n).alias("snake"), naming.kebab_case(n).alias("kebab"), naming.screaming_snake_case(n).alias("screaming"), naming.compact(n).alias("compact"))


@query(r"WITH t AS (SELECT doc_id, text, ceil(length(text) / CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]') THEN 2.0 ELSE 4.0 END)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL) SELECT doc_id, tokens, regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]') AS cjk FROM t")
def h10_h13_token_estimates(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.has_cjk(F.col("text")).alias("cjk"))


_ASKED = ("QuotaStor", "PaletView", "rank_ledgers", "LoadInvoic", "tarif_index")


@query(f"WITH n AS (SELECT DISTINCT name FROM s WHERE name IS NOT NULL), m AS (SELECT unnest([{', '.join(repr(x) for x in _ASKED)}]) AS q) SELECT q, min(name) AS closest, d::INT AS distance FROM (SELECT q, name, levenshtein(q, name) AS d, min(levenshtein(q, name)) OVER (PARTITION BY q) AS best FROM m, n) WHERE d = best GROUP BY q, d")
def h07_h08_closest_names(spark, d):
    # the asked-for names are a fixed list, so each row is compared with those alone
    x = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.levenshtein(F.lit(q), F.col("name")).alias("d"), F.col("name")) for q in _ASKED])).alias("x")
    both = T.symbols(spark, d, "name").filter("name is not null").select("name").distinct().select(x)
    return both.groupBy("x.q").agg(F.min(F.struct("x.d", "x.name")).alias("b")).select("q", F.col("b.name").alias("closest"), F.col("b.d").alias("distance"))


@query(f"WITH n AS (SELECT count(*) AS n FROM s WHERE reference_score IS NOT NULL), r AS (SELECT reference_score, row_number() OVER (ORDER BY reference_score DESC, id) AS rn FROM s WHERE reference_score IS NOT NULL), p AS (SELECT reference_score AS p95 FROM r, n WHERE rn = floor(n * 0.05) + 1), x AS (SELECT id, least(1.0, ln(1 + coalesce(reference_score, 0)) / ln(1 + p95)) AS c, CASE visibility WHEN 'public' THEN 1.0 WHEN 'private' THEN 0.2 ELSE 0.5 END AS v, CASE WHEN kind IN ('function','method','constructor') THEN 1.0 WHEN kind IN ('class','struct','interface','trait','enum','module','namespace','type') THEN 0.7 WHEN kind IN ('variable','constant','property','field') THEN 0.3 END AS k FROM s, p WHERE NOT regexp_matches(file_path, '@TEST@')) SELECT id, round(0.35 * c + 0.25 * v + 0.30 * 1.0 + 0.10 * k, 6)::DOUBLE AS risk, CASE WHEN round(0.35 * c + 0.25 * v + 0.30 + 0.10 * k, 6) >= 0.7 THEN 'HIGH' WHEN round(0.35 * c + 0.25 * v + 0.30 + 0.10 * k, 6) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM x WHERE k IS NOT NULL")
def h26_h31_risk_scores(spark, d):
    s = T.symbols(spark, d, "kind", "visibility", "file_path", "reference_score")
    p95 = d24_k13_p95_score(spark, d)
    rows = s.filter(~paths.is_test_path(F.col("file_path"))).crossJoin(F.broadcast(p95)).withColumn("k", risk.kind_weight(F.col("kind"))).filter("k is not null")
    score = F.round(risk.risk(risk.centrality(F.coalesce("reference_score", F.lit(0.0)), F.col("p95")), risk.visibility_score(F.col("visibility")), risk.test_weakness(F.lit(None).cast("string"), F.lit(1.0)), F.col("k")), 6)
    return rows.select("id", score.alias("risk"), risk.risk_label(score).alias("label"))


@query(r"SELECT id, (length(code_context) - length(replace(code_context, '(', ''))) - (length(code_context) - length(replace(code_context, ')', ''))) AS round, (length(code_context) - length(replace(code_context, '{', ''))) - (length(code_context) - length(replace(code_context, '}', ''))) AS curly, sha256(code_context) AS hash FROM s WHERE code_context IS NOT NULL AND kind IN ('function','method')")
def h35_h48_brackets_and_hash(spark, d):
    c = F.col("code_context")
    s = T.symbols(spark, d, "kind", "code_context").filter(c.isNotNull() & F.col("kind").isin("function", "method")).withColumn("b", text.bracket_balance(c))
    return s.select("id", F.col("b.round").cast("long").alias("round"), F.col("b.curly").cast("long").alias("curly"), text.content_hash(c).alias("hash"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
