"""Queries on joins, graphs and resolution (C, D14, D25, G) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import graph as G
from codeloom.operators import hierarchy, resolve
from codeloom.queries.base import Area
from codeloom.sources import catalogue as T
from codeloom.sources.tables import table

query = Area()


@query(r"""WITH dir AS (SELECT to_id AS id, sum(CASE kind WHEN 'calls' THEN 3 WHEN 'implements' THEN 2 WHEN 'imports' THEN 2 WHEN 'extends' THEN 2 WHEN 'instantiates' THEN 2 WHEN 'contains' THEN 0 ELSE 1 END) AS direct FROM e WHERE from_id <> to_id GROUP BY 1),
 u AS (SELECT name, file_path, kind FROM i WHERE kind IN ('type_usage','import') UNION ALL SELECT substr(name, instr(name, '.') + 1), file_path, kind FROM i WHERE kind IN ('type_usage','import') AND contains(name, '.')),
 b AS (SELECT s.id, sum(CASE u.kind WHEN 'import' THEN 2.0 ELSE 1.0 END) AS boost FROM s JOIN u ON u.name = s.name AND u.file_path <> s.file_path WHERE s.kind IN ('class','struct','enum','interface','trait','type','module','namespace','constant') AND NOT regexp_matches(s.file_path, '@TEST@') GROUP BY 1),
 one AS (SELECT s.*, coalesce(direct, 0) + coalesce(boost, 0) AS score FROM s LEFT JOIN dir ON s.id = dir.id LEFT JOIN b ON s.id = b.id),
 best AS (SELECT parent_id AS id, max(score) AS best FROM one WHERE kind = 'constructor' GROUP BY 1),
 three AS (SELECT one.id, name, kind, file_path, CASE WHEN kind IN ('class','struct') AND score = 0 AND best IS NOT NULL THEN best * 0.7 ELSE score END AS score FROM one LEFT JOIN best ON one.id = best.id)
 SELECT id, name, kind, file_path, round(CASE WHEN regexp_matches(file_path, '@TEST@') THEN score * 0.1 ELSE score END, 9)::DOUBLE AS score FROM three""")
def reference_scores(spark, d):
    """D14, the flagship."""
    return G.reference_scores(T.symbols(spark, d, "name", "kind", "language", "file_path", "parent_id"), T.edges(spark, d), T.identifiers(spark, d, "name", "file_path", "kind"))


@query("SELECT DISTINCT m.id, m.name, c.name AS owner FROM s m JOIN s c ON m.parent_id = c.id WHERE m.kind = 'method' AND c.kind IN ('class','struct')")
def c01_c04_members(spark, d):
    s = T.symbols(spark, d, "name", "kind", "parent_id")
    owners = s.filter("kind in ('class', 'struct')").select(F.col("id").alias("parent_id"), F.col("name").alias("owner"))
    return s.filter("kind = 'method'").select("id", "name", "parent_id").join(owners, "parent_id").select("id", "name", "owner").distinct()


@query("SELECT s.id, s.name, t.type_name FROM s JOIN i ON i.containing_symbol_id = s.id JOIN ta t ON t.identifier_id = i.id WHERE t.type_name ILIKE '%string%' AND s.kind IN ('function','method','field','property')")
def c02_symbols_by_type(spark, d):
    t = T.type_arguments(spark, d, "identifier_id", "type_name").filter(F.col("type_name").ilike("%string%")).select("identifier_id", "type_name")
    i = T.identifiers(spark, d, "containing_symbol_id").select(F.col("id").alias("identifier_id"), F.col("containing_symbol_id").alias("sid"))
    s = T.symbols(spark, d, "name", "kind").filter(F.col("kind").isin("function", "method", "field", "property"))
    return t.join(i, "identifier_id").join(s, F.col("sid") == F.col("id")).select("id", "name", "type_name")


@query("SELECT id, name FROM s WHERE signature ILIKE '%Quota%' AND kind IN ('function','method')")
def c03_signature_filter(spark, d):
    return T.symbols(spark, d, "name", "kind", "signature").filter(F.col("signature").ilike("%Quota%") & F.col("kind").isin("function", "method")).select("id", "name")


@query("SELECT file_path, count(DISTINCT edge)::BIGINT AS edges FROM (SELECT s.file_path, e.id AS edge FROM e JOIN s ON e.from_id = s.id UNION ALL SELECT s.file_path, e.id FROM e JOIN s ON e.to_id = s.id) GROUP BY 1")
def c05_edges_per_file(spark, d):
    return resolve.edges_per_file(T.symbols(spark, d, "file_path"), T.edges(spark, d))


@query("SELECT f.path, count(s.id)::BIGINT AS symbols, coalesce(sum(s.reference_score), 0) AS score FROM f LEFT JOIN s ON s.file_path = f.path GROUP BY 1 HAVING count(s.id) > 0 ORDER BY symbols DESC, path LIMIT 50")
def c06_file_hotspots(spark, d):
    s = T.symbols(spark, d, "file_path", "reference_score").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("reference_score"), F.lit(0.0)).alias("score"))
    return T.files(spark, d).select("path").join(s, F.col("path") == F.col("file_path")).select("path", "symbols", "score").orderBy(F.desc("symbols"), "path").limit(50)


@query("""WITH t AS (SELECT id AS test_id, name AS test_name FROM s WHERE regexp_matches(file_path, '@TEST@') AND kind IN ('function','method','constructor')),
 p AS (SELECT id, name, language FROM s WHERE NOT regexp_matches(file_path, '@TEST@') AND kind IN ('function','method','constructor')),
 n AS (SELECT name, language, min(id) AS id FROM p GROUP BY 1, 2 HAVING count(*) <= 10),
 pairs AS (SELECT DISTINCT p.id, test_id, test_name, 'resolved' AS source FROM i JOIN t ON i.containing_symbol_id = test_id JOIN p ON i.target_symbol_id = p.id
  UNION SELECT n.id, test_id, test_name, 'name' FROM i JOIN t ON i.containing_symbol_id = test_id JOIN n ON i.name = n.name AND i.language = n.language WHERE coalesce(trim(i.target_symbol_id), '') = '')
 SELECT id, count(DISTINCT test_id)::BIGINT AS tests, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT test_name))[1:5], ',') AS names FROM pairs GROUP BY id""")
def c07_d25_test_linkage(spark, d):
    return resolve.link_tests(T.symbols(spark, d, "name", "kind", "language", "file_path"), T.identifiers(spark, d, "name", "language", "containing_symbol_id", "target_symbol_id"))


_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"


@query(f"""WITH u AS (SELECT id AS use_id, name, language, {_DIR.format('file_path')} AS dir FROM i WHERE kind = 'call' AND coalesce(trim(target_symbol_id), '') = ''),
 u2 AS (SELECT *, {_DIR.format('dir')} AS par FROM u),
 c AS (SELECT id, name, language, file_path, {_DIR.format('file_path')} AS dir, 1 + CASE WHEN kind IN ('function','method','constructor') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(file_path, '@TEST@') THEN 75 ELSE 0 END AS own FROM s),
 c2 AS (SELECT *, {_DIR.format('dir')} AS par FROM c),
 j AS (SELECT use_id, c2.id AS symbol_id, own + CASE WHEN u2.language = c2.language THEN 100 ELSE 0 END + CASE WHEN u2.dir = c2.dir THEN 50 WHEN u2.par = c2.par THEN 25 ELSE 0 END AS score, c2.language, c2.file_path FROM u2 JOIN c2 ON u2.name = c2.name)
 SELECT use_id, symbol_id, greatest(0, score)::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY use_id ORDER BY score DESC, language DESC, file_path DESC, symbol_id DESC) AS rn FROM j) WHERE rn = 1""")
def c08_c09_resolve_calls(spark, d):
    pending = T.identifiers(spark, d, "name", "language", "file_path", "kind", "target_symbol_id").filter((F.col("kind") == "call") & (F.coalesce(F.trim("target_symbol_id"), F.lit("")) == ""))
    return resolve.resolve_calls(pending, T.symbols(spark, d, "name", "kind", "language", "file_path"))


_ROUTE_CALLS = "SELECT path AS id, CASE WHEN language = 'json' THEN NULL WHEN language IN ('go','rust') THEN 'get' ELSE 'POST' END AS verb, regexp_replace(path, '^[^/]*', '') AS path, 0.9 AS confidence FROM f WHERE contains(path, '/')"
_ROUTE_HANDLERS = "SELECT path AS id, CASE WHEN language = 'python' THEN NULL WHEN language IN ('go','rust') THEN 'GET' ELSE 'POST' END AS verb, regexp_replace(regexp_replace(path, '^[^/]*', ''), '[a-z]+-?_?[0-9a-z]{3}(/|\\.[a-z]+$)', '{x}\\1', 'g') AS template, CASE WHEN line_count > 60 THEN 0.8 ELSE 0.6 END AS confidence FROM f WHERE language IN ('go','rust','python') AND contains(path, '/')".replace("\\\\", "\\")


@query(rf"""WITH c AS ({_ROUTE_CALLS}), h0 AS ({_ROUTE_HANDLERS}),
 h AS (SELECT *, list_filter(string_split(regexp_replace(template, '\{{x\}}\.[a-z]+$', '{{x}}'), '/'), lambda x: x <> '') AS segs FROM h0), cc AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM c),
 m AS (SELECT cc.id, h.id AS hid, least(cc.confidence, h.confidence) AS conf FROM cc JOIN h ON len(parts) = len(segs) AND cc.verb IS NOT NULL AND (h.verb IS NULL OR upper(h.verb) = upper(cc.verb)) AND len(list_filter(list_zip(parts, segs), lambda z: NOT (regexp_matches(z[2], '^(:.*|\{{.*\}}|<.*>)$') OR z[1] = z[2]))) = 0),
 b AS (SELECT id, max(conf) AS conf FROM m GROUP BY 1), t AS (SELECT m.id, count(DISTINCT hid) AS n, min(hid) AS hid FROM m JOIN b ON m.id = b.id AND m.conf = b.conf GROUP BY 1)
 SELECT cc.id, CASE WHEN t.n = 1 THEN t.hid END AS handler_id, CASE WHEN coalesce(t.n, 0) <> 1 THEN CASE WHEN cc.verb IS NOT NULL THEN upper(cc.verb) || ' ' || cc.path ELSE cc.path END END AS external, b.conf::DOUBLE AS confidence FROM cc LEFT JOIN b ON cc.id = b.id LEFT JOIN t ON cc.id = t.id""")
def c12_c14_route_match(spark, d):
    f = T.files(spark, d, "language", "line_count").filter(F.instr("path", "/") > 0)
    lang, rest = F.col("language"), F.regexp_replace("path", "^[^/]*", "")
    calls = f.select(F.col("path").alias("id"), F.when(lang == "json", None).when(lang.isin("go", "rust"), "get").otherwise("POST").alias("verb"), rest.alias("path"), F.lit(0.9).alias("confidence"))
    template = F.regexp_replace(F.regexp_replace(rest, r"[a-z]+-?_?[0-9a-z]{3}(/|\.[a-z]+$)", "{x}$1"), r"\{x\}\.[a-z]+$", "{x}")
    handlers = f.filter(lang.isin("go", "rust", "python")).select(F.col("path").alias("id"), F.when(lang == "python", None).otherwise("GET").alias("verb"), template.alias("template"), F.when(F.col("line_count") > 60, 0.8).otherwise(0.6).alias("confidence"))
    return resolve.match_routes(calls, handlers)


@query("WITH u AS (SELECT name, min(id) AS id FROM s WHERE kind IN ('class','struct') AND name IS NOT NULL GROUP BY 1 HAVING count(*) = 1) SELECT ta.id, ta.type_name, u.id AS symbol_id, CASE WHEN u.id IS NULL THEN 'table:' || ta.type_name END AS external FROM ta LEFT JOIN u ON ta.type_name = u.name")
def c15_unique_types(spark, d):
    t = T.type_arguments(spark, d, "type_name").select("id", "type_name")
    s = T.symbols(spark, d, "name", "kind").filter("kind in ('class', 'struct')")
    return resolve.resolve_unique(t, "type_name", s, "table")


@query("WITH fr AS (SELECT id, name FROM s WHERE kind = 'function'), u AS (SELECT name, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM fr GROUP BY 1) SELECT i.id, i.containing_symbol_id, CASE WHEN i.target_symbol_id IN (SELECT id FROM fr) THEN i.target_symbol_id ELSE u.id END AS target_id FROM i JOIN u ON i.name = u.name WHERE i.kind = 'call' AND (coalesce(trim(i.target_symbol_id), '') = '' OR i.target_symbol_id IN (SELECT id FROM fr))")
def c16_incoming_by_name(spark, d):
    frontier = T.symbols(spark, d, "name", "kind").filter("kind = 'function'").select("id", "name")
    unique = frontier.groupBy("name").agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("only"))
    uses = T.identifiers(spark, d, "name", "kind", "containing_symbol_id", "target_symbol_id").filter("kind = 'call'")
    hit = uses.join(unique, "name").join(frontier.select(F.col("id").alias("there")), F.col("target_symbol_id") == F.col("there"), "left")
    hit = hit.filter((F.coalesce(F.trim("target_symbol_id"), F.lit("")) == "") | F.col("there").isNotNull())
    return hit.select("id", "containing_symbol_id", F.coalesce("there", "only").alias("target_id"))


@query("WITH n AS (SELECT from_id AS id, to_id AS o FROM e UNION SELECT to_id, from_id FROM e) SELECT n.id, array_to_string(list_sort(list(DISTINCT s.name)), ' ') AS partners FROM n JOIN s ON n.o = s.id WHERE s.name IS NOT NULL GROUP BY 1 HAVING strlen(array_to_string(list_sort(list(DISTINCT s.name)), ' ')) <= 2000")
def c17_partner_names(spark, d):
    return resolve.partner_names(T.edges(spark, d), T.symbols(spark, d, "name"))


@query("SELECT containing_symbol_id AS id, array_to_string(list(kind || '@' || start_line ORDER BY start_byte, id), ' ') AS facts FROM sr WHERE containing_symbol_id IS NOT NULL AND start_byte IS NOT NULL AND start_line IS NOT NULL AND kind IS NOT NULL GROUP BY 1")
def c18_facts_text(spark, d):
    r = T.source_regions(spark, d, "containing_symbol_id", "kind", "start_line", "start_byte").filter("containing_symbol_id is not null and start_byte is not null and start_line is not null and kind is not null")
    each = F.struct("start_byte", F.col("id"), F.concat_ws("@", "kind", F.col("start_line").cast("string")).alias("t"))
    return r.groupBy(F.col("containing_symbol_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), " ").alias("facts"))


@query("""WITH d AS (SELECT id, name, file_path, start_line FROM s WHERE kind = 'function' AND name LIKE '%quota%'),
 x AS (SELECT e.file_path, e.line_number AS line, 0 AS p, e.kind FROM e WHERE e.to_id IN (SELECT id FROM d) UNION ALL SELECT i.file_path, i.start_line, 1, i.kind FROM i WHERE i.name IN (SELECT name FROM d))
 SELECT file_path, line, CASE WHEN arg_min(p, (p, kind)) = 0 THEN 'edge' ELSE 'use' END AS source, arg_min(kind, (p, kind)) AS kind FROM x WHERE (file_path, line) NOT IN (SELECT (file_path, start_line) FROM d WHERE start_line IS NOT NULL AND file_path IS NOT NULL) AND line IS NOT NULL GROUP BY 1, 2""")
def c21_j04_references(spark, d):
    defs = T.symbols(spark, d, "name", "kind", "file_path", "start_line").filter((F.col("kind") == "function") & F.col("name").contains("quota"))
    return resolve.references(T.edges(spark, d), T.identifiers(spark, d, "name", "kind", "file_path", "start_line"), defs).filter("line is not null")


@query("WITH r AS (SELECT max(revision) AS r FROM file_snapshots), b AS (SELECT file_path AS path, arg_max(coalesce(hash, ''), last_indexed) AS h FROM file_snapshots, r WHERE revision = r GROUP BY 1) SELECT coalesce(f.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN lower(coalesce(f.hash, '')) = lower(b.h) THEN 'unchanged' ELSE 'modified' END AS state FROM f FULL JOIN b ON f.path = b.path")
def c23_c24_changed_files(spark, d):
    from codeloom.sources.tables import current_rows

    snap = table(spark, d, "file_snapshots")
    last = snap.agg(F.max("revision").alias("r"))
    before = current_rows(snap.join(F.broadcast(last), F.col("revision") == F.col("r"), "left_semi"), "file_path", ["hash"]).select(F.col("file_path").alias("path"), F.lower("hash").alias("hash"))
    return resolve.changed_files(T.files(spark, d, "hash").select("path", F.lower("hash").alias("hash")), before)


@query("SELECT e.from_id AS id, array_to_string(list_sort(list(DISTINCT t.name)), ',') AS callees FROM e JOIN s ON e.from_id = s.id JOIN s t ON e.to_id = t.id WHERE e.kind = 'calls' AND s.kind IN ('function','method') AND t.name IS NOT NULL GROUP BY 1")
def c25_callee_map(spark, d):
    return resolve.callee_map(T.symbols(spark, d, "name", "kind").filter("name is not null or kind is not null"), T.edges(spark, d))


@query("SELECT id, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing FROM (SELECT from_id AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT to_id, 1, 0 FROM e) GROUP BY 1")
def d03_degrees(spark, d):
    return G.degree_stats(T.edges(spark, d))


@query("""WITH RECURSIVE st AS (SELECT id FROM s WHERE kind = 'function' AND name LIKE 'cache%'), g AS (SELECT DISTINCT from_id, to_id FROM e WHERE kind IN ('calls','uses') AND from_id <> to_id),
 r AS (SELECT id, 0 AS hops FROM st UNION SELECT g.to_id, r.hops + 1 FROM r JOIN g ON g.from_id = r.id WHERE r.hops < 6) SELECT id, min(hops)::INT AS hops FROM r GROUP BY 1""")
def g01_g02_call_distances(spark, d):
    starts = T.symbols(spark, d, "name", "kind").filter("kind = 'function' and name like 'cache%'")
    return G.distances(T.edges(spark, d).filter(F.col("kind").isin("calls", "uses")), starts, 6).select("id", "hops")


@query("""WITH pr AS (SELECT e.from_id, e.to_id, CASE WHEN e.kind = 'uses' THEN 'references' ELSE e.kind END AS kind, e.confidence, s.reference_score AS score FROM e LEFT JOIN s ON e.from_id = s.id),
 p AS (SELECT *, CASE kind WHEN 'calls' THEN 0 WHEN 'overrides' THEN 1 WHEN 'implements' THEN 2 WHEN 'extends' THEN 3 WHEN 'instantiates' THEN 4 WHEN 'references' THEN 5 WHEN 'imports' THEN 6 END AS priority FROM pr),
 seed AS (SELECT id FROM s WHERE kind IN ('function','method') AND name LIKE '%quota%'),
 f1 AS (SELECT from_id AS id, min((priority, -coalesce(confidence, 0), to_id)) AS b, max(score) AS score FROM p WHERE to_id IN (SELECT id FROM seed) AND from_id NOT IN (SELECT id FROM seed) GROUP BY 1),
 k1 AS (SELECT id, 1 AS depth, b[1] AS priority, b[3] AS target, score FROM f1 ORDER BY priority, score DESC NULLS LAST, id LIMIT 250),
 f2 AS (SELECT from_id AS id, min((priority, -coalesce(confidence, 0), to_id)) AS b, max(score) AS score FROM p WHERE to_id IN (SELECT id FROM k1) AND from_id NOT IN (SELECT id FROM seed) AND from_id NOT IN (SELECT id FROM f1) GROUP BY 1),
 k2 AS (SELECT id, 2 AS depth, b[1] AS priority, b[3] AS target, score FROM f2 ORDER BY priority, score DESC NULLS LAST, id LIMIT 250)
 SELECT id, depth::INT AS depth, priority::INT AS priority, target, score FROM k1 UNION ALL SELECT id, depth::INT, priority::INT, target, score FROM k2""")
def g05_j07_impact(spark, d):
    s = T.symbols(spark, d, "name", "kind", "reference_score")
    seeds = s.filter("kind in ('function', 'method') and name like '%quota%'")
    return G.impact(T.edges(spark, d), s.select("id", F.col("reference_score").alias("score")), seeds, 2)


@query("""WITH p AS (SELECT id FROM s WHERE kind = 'method' AND name LIKE '%ledger%'),
 x AS (SELECT e.from_id AS id, 0 AS d, e.kind, e.to_id AS "pivot", 'incoming' AS direction FROM e WHERE e.to_id IN (SELECT id FROM p) UNION ALL SELECT e.to_id, 1, e.kind, e.from_id, 'outgoing' FROM e WHERE e.from_id IN (SELECT id FROM p))
 SELECT id, arg_min(direction, (d, kind, "pivot")) AS direction, arg_min(kind, (d, kind, "pivot")) AS kind, arg_min("pivot", (d, kind, "pivot")) AS "pivot" FROM x WHERE id NOT IN (SELECT id FROM p) GROUP BY 1""")
def g09_k01_neighbours(spark, d):
    return G.neighbours(T.edges(spark, d), T.symbols(spark, d, "name", "kind").filter("kind = 'method' and name like '%ledger%'"))


@query("""WITH RECURSIVE x AS (SELECT s.id, s.parent_id, s.name, s.kind FROM s), ok AS (SELECT a.id, b.id AS par FROM x a LEFT JOIN x b ON a.parent_id = b.id),
 tree AS (SELECT id, [id] AS chain FROM ok WHERE par IS NULL UNION ALL SELECT o.id, list_append(t.chain, o.id) FROM tree t JOIN ok o ON o.par = t.id),
 steps AS (SELECT id, unnest(chain[1:-2]) AS step, generate_subscripts(chain[1:-2], 1) AS pos FROM tree WHERE len(chain) > 1)
 SELECT 'symbols:' || steps.id AS node, array_to_string(list(x.name ORDER BY pos), ' ') AS owners FROM steps JOIN x ON x.id = steps.step WHERE x.name IS NOT NULL GROUP BY steps.id""")
def g13_owner_chains(spark, d):
    s = table(spark, d, "symbols")
    sets = hierarchy.nested_sets(spark, hierarchy.forest({"symbols": (s, "id", "parent_id")}))
    return G.owner_chain(hierarchy.with_paths(spark, sets), T.symbols(spark, d, "name").filter("name is not null"))


@query("""WITH RECURSIVE ok AS (SELECT a.id, b.id AS par FROM s a LEFT JOIN s b ON a.parent_id = b.id), w AS (SELECT id FROM s WHERE kind = 'class' AND name LIKE 'Quota%'),
 tree AS (SELECT id FROM ok WHERE par IS NULL UNION ALL SELECT o.id FROM tree t JOIN ok o ON o.par = t.id),
 r AS (SELECT w.id AS a, w.id AS n FROM w WHERE w.id IN (SELECT id FROM tree) UNION ALL SELECT r.a, o.id FROM r JOIN ok o ON o.par = r.n) SELECT 'symbols:' || a AS ancestor, 'symbols:' || n AS node FROM r WHERE a <> n""")
def g11_g12_subtrees(spark, d):
    s = table(spark, d, "symbols")
    sets = hierarchy.nested_sets(spark, hierarchy.forest({"symbols": (s, "id", "parent_id")}))
    wanted = T.symbols(spark, d, "name", "kind").filter("kind = 'class' and name like 'Quota%'").select(F.concat(F.lit("symbols:"), "id").alias("node"))
    return hierarchy.descendants(sets, wanted).select("ancestor", "node")


@query("SELECT s.id, s.name, s.reference_score FROM s WHERE s.reference_score > 0 AND s.kind IN ('function','method') AND NOT regexp_matches(s.file_path, '@TEST@') AND s.id NOT IN (SELECT to_id FROM e JOIN s t ON e.from_id = t.id WHERE regexp_matches(t.file_path, '@TEST@')) ORDER BY s.reference_score DESC, s.name, s.file_path, s.id LIMIT 20")
def j15_centrality_gaps(spark, d):
    s = T.symbols(spark, d, "name", "kind", "file_path", "reference_score")
    tests = s.filter(paths.is_test_path(F.col("file_path"))).select(F.col("id").alias("from_id"))
    tested = T.edges(spark, d).join(tests, "from_id", "left_semi").select(F.col("to_id").alias("id"))
    open_ones = s.filter((F.col("reference_score") > 0) & F.col("kind").isin("function", "method") & ~paths.is_test_path(F.col("file_path"))).join(tested, "id", "left_anti")
    return open_ones.orderBy(F.desc("reference_score"), "name", "file_path", "id").limit(20).select("id", "name", "reference_score")


QUERIES, ORACLES = query.QUERIES, query.ORACLES
