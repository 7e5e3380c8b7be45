"""Queries on the projection, annotations, web edges, pages, tests, repairs and the facade with their SQL (A, B, C, D35, E, F06, G, H33, H52, I, J)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.api import Engine
from codeloom.functions import paths
from codeloom.operators import analysis as A
from codeloom.operators import annotations as N
from codeloom.operators import catalog as C
from codeloom.operators import changes, context, hierarchy, pages, resolve, vectors, web
from codeloom.operators import graph as G
from codeloom.operators import projection as P
from codeloom.plans.cut import shared_dir
from codeloom.queries.base import Area
from codeloom.queries.relations import c12_c14_route_match
from codeloom.sources import catalogue as T
from codeloom.sources import sinks
from codeloom.sources.tables import table

query = Area()
_LAST = "(SELECT DISTINCT file_path FROM revision_file_changes WHERE revision = (SELECT max(revision) FROM revision_file_changes) AND file_path IS NOT NULL)"


def _last_changed(spark, d):
    c = table(spark, d, "revision_file_changes")
    last = c.agg(F.max("revision").alias("r"))
    return c.join(F.broadcast(last), F.col("revision") == F.col("r"), "left_semi").filter("file_path is not null").select("file_path").distinct()


# --- the projection ----------------------------------------------------------
_CUT = "CASE WHEN strlen({0}) <= 2000 THEN {0} ELSE left({0}, list_max(list_filter(range(0, 2001), lambda k: strlen(left({0}, k::INT)) <= 2000))::INT) END"
_CAMEL_W = r"regexp_split_to_array(regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g'), chr(1))"
_PRE = r"array_to_string(flatten(list_transform(list_filter(regexp_split_to_array({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), lambda w: list_concat([w], list_filter(list_concat(CASE WHEN lower(w) <> w AND upper(w) <> w THEN " + _CAMEL_W.replace("{", "{{").replace("}", "}}") + r" ELSE [] END, CASE WHEN contains(w, '_') THEN list_filter(string_split(w, '_'), lambda p: p <> '') ELSE [] END), lambda p: p <> '' AND lower(p) <> lower(w))))), ' ')"
_SYMBOL_DOCS = f"SELECT 'symbol' AS doc_type, id AS key, file_path, name, body, '' AS path_text, {_PRE.format('whole')} AS pretokenized FROM (SELECT *, concat_ws(' ', name, signature, body) AS whole FROM (SELECT *, {_CUT.format('code')} AS body FROM (SELECT *, coalesce(code_context, '') AS code FROM s)))"
_FILE_DOCS = rf"SELECT 'file' AS doc_type, path AS key, path AS file_path, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS name, body, path AS path_text, {_PRE.format('body')} AS pretokenized FROM (SELECT *, {_CUT.format('c')} AS body FROM (SELECT *, coalesce(content, '') AS c FROM f))"


def _symbol_docs(spark, d):
    return P.symbol_documents(T.symbols(spark, d, "name", "signature", "code_context", "file_path"))


def _file_docs(spark, d):
    return P.file_documents(T.files(spark, d, "content"))


@query(_SYMBOL_DOCS)
def a25_symbol_documents(spark, d):
    return _symbol_docs(spark, d)


@query(_FILE_DOCS)
def a26_file_documents(spark, d):
    return _file_docs(spark, d)


@query(f"SELECT doc_type, key FROM (SELECT 'symbol' AS doc_type, id AS key, file_path FROM s UNION ALL SELECT 'file', path, path FROM f) WHERE file_path IS NULL OR file_path NOT IN {_LAST}")
def a27_delete_by_path(spark, d):
    docs = _symbol_docs(spark, d).unionByName(_file_docs(spark, d))
    return P.delete_paths(docs, _last_changed(spark, d)).select("doc_type", "key")


@query(f"""WITH inside AS (SELECT id FROM s WHERE file_path IN {_LAST}), p AS (SELECT to_id AS id FROM e WHERE from_id IN (SELECT id FROM inside) UNION SELECT from_id FROM e WHERE to_id IN (SELECT id FROM inside)),
 again AS (SELECT file_path FROM s WHERE id IN (SELECT id FROM p) AND file_path IS NOT NULL UNION SELECT file_path FROM {_LAST}) SELECT id AS key, s.file_path FROM s JOIN again USING (file_path)""")
def a32_partner_documents(spark, d):
    """The documents that are made again once the last revision's files have changed."""
    s = T.symbols(spark, d, "file_path")
    again = P.partner_paths(s, T.edges(spark, d), _last_changed(spark, d))
    return s.join(again, "file_path", "left_semi").select(F.col("id").alias("key"), "file_path")


_LEFT = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {c} WHERE coalesce({col}, '') NOT IN {_LAST}" for n, c, col in (("files", "f", "path"), ("symbols", "s", "file_path"), ("identifiers", "i", "file_path"), ("type_arguments", "ta", "file_path"), ("source_regions", "sr", "file_path")))


@query(_LEFT)
def a10_a11_cascade(spark, d):
    """Rows that are left in each table once the last revision's files are deleted with all that hangs on them."""
    now = {"files": T.files(spark, d), "symbols": T.symbols(spark, d, "file_path"), "identifiers": T.identifiers(spark, d, "file_path"), "type_arguments": T.type_arguments(spark, d, "file_path"), "source_regions": T.source_regions(spark, d, "file_path")}
    out = None
    for name, df in P.delete_files(now, _last_changed(spark, d)).items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"SELECT 'published' AS state, 'files' AS name, count(*)::BIGINT AS n FROM f UNION ALL SELECT 'published', 'symbols', count(*) FROM s UNION ALL SELECT 'deleted', 'files', count(*) FROM f WHERE path NOT IN {_LAST} UNION ALL SELECT 'deleted', 'symbols', count(*) FROM s WHERE coalesce(file_path, '') NOT IN {_LAST} UNION ALL SELECT 'wiped', 'files', 0 UNION ALL SELECT 'wiped', 'symbols', 0")
def a08_a12_a29_store(spark, d):
    """Rows by table of a store after its tables are published, after a deletion by file, and after it is wiped."""
    store = sinks.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = []
    steps = (("published", lambda: store.publish({"files": T.files(spark, d), "symbols": T.symbols(spark, d, "file_path")}, "fresh")), ("deleted", lambda: store.delete_files(_last_changed(spark, d))), ("wiped", store.wipe))
    for state, step in steps:
        step()
        rows += [(state, name, n) for name, n in store.info().items()]
    return spark.createDataFrame(rows, "state string, name string, n long")


@query("SELECT i.id, s.id AS containing_symbol_id, t.id AS target_symbol_id FROM i LEFT JOIN s ON i.containing_symbol_id = s.id LEFT JOIN s t ON i.target_symbol_id = t.id")
def a15_a17_keep_known(spark, d):
    """Both references of each use through the sink's own operator."""
    ids = T.symbols(spark, d)
    uses = T.identifiers(spark, d, "containing_symbol_id", "target_symbol_id")
    return sinks.keep_known(sinks.keep_known(uses, "containing_symbol_id", ids), "target_symbol_id", ids).select("id", "containing_symbol_id", "target_symbol_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT -vec_id - 1, -2 FROM embeddings WHERE vec_id % 7 = 0")
def a21_a22_embedding_upsert(spark, d):
    """Vectors of some keys replaced and of others added."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    kind = dict(e.dtypes)["label"]
    new = e.filter("vec_id % 3 = 0").withColumn("label", F.lit(-1).cast(kind)).unionByName(e.filter("vec_id % 7 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), F.lit(-2).cast(kind).alias("label")))
    return vectors.upsert(e, new, "vec_id")


# --- annotations ---------------------------------------------------------------
_TAGS = r"(SELECT id AS symbol_id, unnest(t) AS annotation, generate_subscripts(t, 1) - 1 AS ordinal FROM (SELECT id, regexp_extract_all(lower(doc_comment), '@([a-z]\w*)', 1) AS t FROM s WHERE doc_comment IS NOT NULL))"


def _tags(spark, d):
    return N.doc_tags(T.symbols(spark, d, "doc_comment"))


@query(f"SELECT s.id, g.annotations FROM s LEFT JOIN (SELECT symbol_id, string_agg(annotation, ' ' ORDER BY ordinal) AS annotations FROM {_TAGS} GROUP BY 1) g ON s.id = g.symbol_id")
def c22_annotations(spark, d):
    return N.hydrate(T.symbols(spark, d).select("id"), _tags(spark, d))


@query(f"SELECT id FROM s WHERE id IN (SELECT symbol_id FROM {_TAGS} WHERE annotation = 'param') AND id IN (SELECT symbol_id FROM {_TAGS} WHERE annotation = 'return')")
def f06_f07_annotated(spark, d):
    from codeloom.operators.search import parse_query

    return N.annotated(T.symbols(spark, d).select("id"), _tags(spark, d), parse_query("@param @return").annotations)


@query(f"""WITH RECURSIVE ok AS (SELECT a.id, b.id AS par FROM s a LEFT JOIN s b ON a.parent_id = b.id), tree AS (SELECT id, [id] AS chain FROM ok WHERE par IS NULL UNION ALL SELECT o.id, list_append(t.chain, o.id) FROM tree t JOIN ok o ON o.par = t.id)
 SELECT DISTINCT 'symbols:' || id AS node FROM (SELECT id, unnest(chain[1:-2]) AS above FROM tree) WHERE above IN (SELECT symbol_id FROM {_TAGS} WHERE annotation IN ('since', 'internal'))""")
def g14_owned_by_annotated(spark, d):
    sets = hierarchy.nested_sets(spark, hierarchy.forest({"symbols": (table(spark, d, "symbols"), "id", "parent_id")}))
    return N.owned_by_annotated(sets, _tags(spark, d), ["since", "internal"])


# --- web edges -----------------------------------------------------------------
def _matched_sql() -> str:
    from codeloom.queries.relations import ORACLES as R

    return R["c12_c14_route_match"]


def _web(spark, d):
    return web.web_edges(c12_c14_route_match(spark, d))


@query(f"SELECT 'http_call|' || id || '|' || coalesce(handler_id, 'external:' || external) AS id, id AS from_id, coalesce(handler_id, 'external:' || external) AS to_id, confidence FROM ({_matched_sql()})")
def b34_web_edges(spark, d):
    return web.by_kind(_web(spark, d), "http_call").select("id", "from_id", "to_id", "confidence")


@query(f"""WITH m AS (SELECT id AS from_id, coalesce(handler_id, 'external:' || external) AS to_id FROM ({_matched_sql()})),
 hop1 AS (SELECT DISTINCT to_id AS id FROM m WHERE from_id IN (SELECT path FROM f WHERE language = 'rust') AND to_id NOT IN (SELECT path FROM f WHERE language = 'rust')),
 hop2 AS (SELECT DISTINCT to_id AS id FROM m WHERE from_id IN (SELECT id FROM hop1) AND to_id NOT IN (SELECT path FROM f WHERE language = 'rust') AND to_id NOT IN (SELECT id FROM hop1))
 SELECT path AS id, 0::INT AS hops FROM f WHERE language = 'rust' UNION ALL SELECT id, 1::INT FROM hop1 UNION ALL SELECT id, 2::INT FROM hop2""")
def g04_web_distances(spark, d):
    """Hops over web edges alone, files being their nodes; the last are external names."""
    starts = T.files(spark, d, "language").filter("language = 'rust'").select(F.col("path").alias("id"))
    none = T.edges(spark, d).filter(F.lit(False))
    return web.web_distances(none, _web(spark, d), starts, 2).select("id", "hops")


@query(f"SELECT handler_id AS seed, id AS caller, max(confidence) AS confidence FROM ({_matched_sql()}) WHERE handler_id IN (SELECT path FROM f WHERE language IN ('go', 'rust')) GROUP BY 1, 2")
def g06_web_callers(spark, d):
    seeds = T.files(spark, d, "language").filter("language in ('go', 'rust')").select(F.col("path").alias("id"))
    return web.web_callers(_web(spark, d), seeds).select("seed", "caller", "confidence")


@query(f"SELECT id, handler_id IS NOT NULL AS matched, external FROM ({_matched_sql()})")
def c13_h44_h45_k08_route_labels(spark, d):
    """Whether one handler alone fits each call best, and the label of the others."""
    return c12_c14_route_match(spark, d).select("id", F.col("handler_id").isNotNull().alias("matched"), "external")


# --- resolution ----------------------------------------------------------------
@query("""SELECT id, CASE WHEN ns = '' THEN 0 WHEN starts_with(ns, 'crate::') AND (m = t OR ends_with(m, '::' || t)) THEN 500 WHEN starts_with(ns, 'std::') AND (m = t OR ends_with(m, '::' || t)) THEN 450 END::INT AS score
 FROM (SELECT id, m, ns, regexp_replace(ns, '^(crate|std)::', '') AS t FROM (SELECT id, replace(regexp_replace(file_path, '\\.[^.]*$', ''), '/', '::') AS m, CASE start_line % 4 WHEN 0 THEN '' WHEN 1 THEN 'crate::' || regexp_replace(regexp_replace(file_path, '\\.[^.]*$', ''), '^.*/', '') WHEN 2 THEN 'std::' || regexp_replace(regexp_replace(file_path, '\\.[^.]*$', ''), '^.*/', '') ELSE 'crate::elsewhere' END AS ns FROM s WHERE file_path IS NOT NULL AND start_line IS NOT NULL))""")
def c10_namespace_scores(spark, d):
    """The score of each symbol's module path for a namespace that names it, names something else, or is empty."""
    stem = F.regexp_replace("file_path", r"\.[^.]*$", "")
    leaf, line = F.regexp_replace(stem, "^.*/", ""), F.col("start_line") % 4
    ns = F.when(line == 0, "").when(line == 1, F.concat(F.lit("crate::"), leaf)).when(line == 2, F.concat(F.lit("std::"), leaf)).otherwise("crate::elsewhere")
    s = T.symbols(spark, d, "file_path", "start_line").filter("file_path is not null and start_line is not null")
    return s.select("id", resolve.namespace_score(ns, F.replace(stem, F.lit("/"), F.lit("::"))).cast("int").alias("score"))


_EXPORTS = "(SELECT * FROM (VALUES ('a::X', 'b::X'), ('b::X', 'c::inner::X'), ('r::A', 'r::B'), ('r::B', 'r::A'), ('m::Y', 'n2::Y'), ('m::Y', 'n1::Y')) AS t(path, target))"


@query("SELECT * FROM (VALUES (1, 'a::X', 'c::inner::X'), (2, 'b::X', 'c::inner::X'), (3, 'r::A', 'r::A'), (4, 'm::Y', 'n1::Y'), (5, 'z::Z', 'z::Z')) AS t(id, path, resolved)")
def c11_reexports(spark, d):
    """A literal frame: chains, a ring, two targets, and no re-export at all."""
    pending = spark.createDataFrame([(1, "a::X"), (2, "b::X"), (3, "r::A"), (4, "m::Y"), (5, "z::Z")], "id int, path string")
    exports = spark.createDataFrame([("a::X", "b::X"), ("b::X", "c::inner::X"), ("r::A", "r::B"), ("r::B", "r::A"), ("m::Y", "n2::Y"), ("m::Y", "n1::Y")], "path string, target string")
    return resolve.chase_reexports(pending, exports)


@query("""SELECT t.id, string_agg(x.n, ',' ORDER BY x.n) AS implementors FROM (SELECT id FROM s WHERE kind IN ('trait', 'interface', 'function')) t JOIN
 (SELECT to_id, n, row_number() OVER (PARTITION BY to_id ORDER BY n) AS r FROM (SELECT DISTINCT e.to_id, coalesce(s.name, e.from_id) AS n FROM e LEFT JOIN s ON e.from_id = s.id)) x ON x.to_id = t.id AND x.r <= 8 GROUP BY 1""")
def c26_implementors(spark, d):
    """What refers to each trait, interface and function, taken for its implementations, as the tables hold no such edges."""
    edges = T.edges(spark, d).withColumn("kind", F.lit("implements"))
    s = T.symbols(spark, d, "name", "kind").withColumn("kind", F.when(F.col("kind") == "function", "interface").otherwise(F.col("kind")))
    return resolve.implementor_map(s, edges).select("id", F.array_join("implementors", ",").alias("implementors"))


@query("""WITH c AS (SELECT e.id, e.file_path AS caller_file, e.from_id AS caller_scope, p.name AS parent_name FROM e JOIN s t ON e.to_id = t.id JOIN s p ON t.parent_id = p.id WHERE p.name IS NOT NULL)
 SELECT id, EXISTS (SELECT * FROM i WHERE i.file_path = c.caller_file AND i.name = c.parent_name) AS in_file, EXISTS (SELECT * FROM i WHERE i.containing_symbol_id = c.caller_scope AND i.name = c.parent_name) AS in_scope FROM c""")
def c27_parent_context(spark, d):
    s = T.symbols(spark, d, "name", "parent_id")
    owners = s.select(F.col("id").alias("to_id"), F.col("parent_id").alias("pid")).join(s.select(F.col("id").alias("pid"), F.col("name").alias("parent_name")).filter("parent_name is not null"), "pid")
    cands = T.edges(spark, d).select("id", F.col("file_path").alias("caller_file"), F.col("from_id").alias("caller_scope"), "to_id").join(owners, "to_id")
    return resolve.parent_context(cands, T.identifiers(spark, d, "name", "file_path", "containing_symbol_id")).select("id", "in_file", "in_scope")


# --- ranking and pages -----------------------------------------------------------
@query("""SELECT id, rank::INT AS rank FROM (SELECT id, row_number() OVER (ORDER BY score DESC, is_code DESC, name, path, id) AS rank FROM (SELECT id, coalesce(reference_score, 0) AS score, coalesce(language NOT IN ('markdown','json','toml','yaml'), FALSE) AS is_code, name, file_path AS path FROM s WHERE name IS NOT NULL AND file_path IS NOT NULL)) WHERE rank <= 50""")
def e07_pivot_order(spark, d):
    s = T.symbols(spark, d, "name", "file_path", "language", "reference_score").filter("name is not null and file_path is not null")
    rows = s.select("id", F.coalesce("reference_score", F.lit(0.0)).alias("score"), F.coalesce(~F.col("language").isin(*paths.DOC_LANGUAGES), F.lit(False)).alias("is_code"), "name", F.col("file_path").alias("path"))
    return C.order_pivots(rows, 50).select("id", "rank")


@query("SELECT file_path, CASE WHEN b IS NULL OR a >= 2 * b THEN 1 WHEN c >= 0.7 * a THEN 3 ELSE 2 END::INT AS pivots FROM (SELECT file_path, max(reference_score) FILTER (r = 1) AS a, max(reference_score) FILTER (r = 2) AS b, max(reference_score) FILTER (r = 3) AS c FROM (SELECT file_path, reference_score, row_number() OVER (PARTITION BY file_path ORDER BY reference_score DESC) AS r FROM s WHERE reference_score IS NOT NULL AND file_path IS NOT NULL) WHERE r <= 3 GROUP BY 1)")
def e06_pivot_counts(spark, d):
    return C.pivot_counts(T.symbols(spark, d, "file_path", "reference_score").filter("file_path is not null"), "file_path", "reference_score")


@query("""WITH RECURSIVE ok AS (SELECT a.id, b.id AS par, a.file_path, a.start_line FROM s a LEFT JOIN s b ON a.parent_id = b.id), tree AS (SELECT id, id AS root FROM ok WHERE par IS NULL UNION ALL SELECT o.id, t.root FROM tree t JOIN ok o ON o.par = t.id),
 kept AS (SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY coalesce(start_line, -1), id) AS r FROM ok WHERE par IS NULL AND file_path IS NOT NULL) WHERE r <= 2)
 SELECT kept.file_path AS grp, 'symbols:' || tree.id AS node FROM tree JOIN kept ON tree.root = kept.id""")
def e09_limited_outline(spark, d):
    """The first two top-level symbols of each file with all that they hold."""
    sets = hierarchy.nested_sets(spark, hierarchy.forest({"symbols": (table(spark, d, "symbols"), "id", "parent_id")}))
    group = T.symbols(spark, d, "file_path", "start_line").filter("file_path is not null").select(F.concat(F.lit("symbols:"), "id").alias("node"), F.col("file_path").alias("grp"), F.coalesce("start_line", F.lit(-1)).alias("place"))
    return C.limit_roots(sets, group, 2)


@query("SELECT id, name, (row_number() OVER (ORDER BY name, id) - 1)::BIGINT AS row FROM s WHERE name IS NOT NULL QUALIFY row BETWEEN 100 AND 159")
def e12_j09_spillover_page(spark, d):
    """Rows 100 to 159 of a result that was kept under a handle."""
    held = pages.Spillover(spark)
    handle = held.put(T.symbols(spark, d, "name").filter("name is not null").select("id", "name"), "me", ["name", "id"], "symbols")
    return held.get(handle, "me", 100, 60).select("id", "name", "row")


@query("""WITH p AS (SELECT e.from_id, e.to_id, CASE WHEN e.kind = 'uses' THEN 'references' ELSE e.kind END AS kind, e.confidence, s.reference_score AS score FROM e LEFT JOIN s ON e.from_id = s.id),
 q AS (SELECT *, CASE kind WHEN 'calls' THEN 0 WHEN 'references' THEN 5 WHEN 'imports' THEN 6 END AS priority FROM p), seed AS (SELECT id FROM s WHERE kind = 'method'),
 f1 AS (SELECT from_id AS id, min(priority) AS priority, max(score) AS score FROM q WHERE priority IS NOT NULL AND to_id IN (SELECT id FROM seed) AND from_id NOT IN (SELECT id FROM seed) GROUP BY 1)
 SELECT id, priority::INT AS priority, score FROM f1 ORDER BY priority, score DESC NULLS LAST, id LIMIT 25""")
def e04_e05_impact_frontier(spark, d):
    """The first 25 of what depends on methods, in impact order."""
    s = T.symbols(spark, d, "kind", "reference_score")
    return G.impact(T.edges(spark, d), s.select("id", F.col("reference_score").alias("score")), s.filter("kind = 'method'"), 1, cap=25).select("id", "priority", "score")


@query("SELECT * FROM (VALUES (1, 'pivots', 1200), (1, 'neighbours', 600), (1, 'summary', 200), (2, 'pivots', 1800), (2, 'neighbours', 900), (2, 'summary', 300), (3, 'pivots', 2400), (3, 'neighbours', 1200), (3, 'summary', 400)) AS t(pivots, part, tokens)")
def j18_budgets(spark, d):
    return spark.createDataFrame([(n, k, v) for n in (1, 2, 3) for k, v in context.allocate(n).items()], "pivots int, part string, tokens int")


_PACKED = [["a" * 900, "b" * 700, "c" * 60, "d" * 300], ["x" * 5000, "y"], []]


@query("SELECT * FROM (VALUES (0, '0,2', '1,3'), (1, '0', '1'), (2, '', '')) AS t(request, kept, spilled)")
def j19_packing(spark, d):
    """First fit within 1,000 characters: what doesn't fit is skipped, the first is always kept."""
    rows = [(i, *(",".join(map(str, x)) for x in context.pack(entries, 250))) for i, entries in enumerate(_PACKED)]
    return spark.createDataFrame(rows, "request int, kept string, spilled string")


@query("SELECT * FROM (VALUES ('edited', 2.5), ('entry,stack', 6.0), ('near_line,symbol', 2.25), ('failing_test', 2.5), ('', 1.0)) AS t(signals, factor)".replace("2.5)", "2.5::DOUBLE)", 1))
def j16_signal_factors(spark, d):
    return spark.createDataFrame([(x, float(context.signal_factor({s for s in x.split(",") if s}))) for x in ("edited", "entry,stack", "near_line,symbol", "failing_test", "")], "signals string, factor double")


@query("SELECT * FROM (VALUES ('a', 4.0), ('b', 4.0), ('c', 0.75), ('d', 0.5), ('e', 0.35)) AS t(id, score)".replace("4.0)", "4.0::DOUBLE)", 1))
def j17_injected_seeds(spark, d):
    got = context.inject_seeds({"a": 4.0, "d": 0.5}, {"b"}, {"c"}, {"d", "e"})
    return spark.createDataFrame(sorted(got.items()), "id string, score double")


# --- tests and evidence ------------------------------------------------------------
def _sets(kind: str) -> str:
    return " OR ".join(f"(language = '{lang}' AND lower(name) IN ({', '.join(repr(n) for n in sets[kind])}))" for lang, sets in A.EVIDENCE.items() if sets[kind])


@query(f"SELECT containing_symbol_id AS id, count(*) FILTER ({_sets('assertions')})::INT AS assertions, count(*) FILTER ({_sets('errors')})::INT AS errors, count(*) FILTER ({_sets('mocks')})::INT AS mocks FROM i WHERE kind = 'call' AND containing_symbol_id IS NOT NULL GROUP BY 1")
def h52_call_evidence(spark, d):
    return A.call_evidence(T.identifiers(spark, d, "name", "kind", "language", "containing_symbol_id"))


@query("""WITH t AS (SELECT id, name, file_path FROM s WHERE regexp_matches(file_path, '@TEST@') AND name IS NOT NULL), l AS (SELECT e.to_id AS id, t.name, t.file_path FROM e JOIN t ON e.from_id = t.id),
 b AS (SELECT DISTINCT regexp_replace(file_path, '^.*/', '') AS b FROM l ORDER BY 1 LIMIT 3) SELECT DISTINCT id FROM l WHERE EXISTS (SELECT * FROM b WHERE file_path = b OR ends_with(file_path, '/' || b)) OR name = (SELECT max(name) FROM l)""")
def b37_failing_links(spark, d):
    """Symbols whose linked tests fail: those in three files, told by the ends of their paths, and those of one name."""
    s = T.symbols(spark, d, "name", "file_path").filter("name is not null")
    tests = s.filter(paths.is_test_path(F.col("file_path"))).select(F.col("id").alias("from_id"), F.col("name").alias("t"), F.col("file_path").alias("p"))
    links = T.edges(spark, d).join(tests, "from_id")
    linked = links.groupBy(F.col("to_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set("p"))).alias("linked_test_paths"), F.to_json(F.array_sort(F.collect_set("t"))).alias("linked_tests"))
    failing = [r[0] for r in links.select(paths.basename(F.col("p")).alias("b")).distinct().orderBy("b").limit(3).collect()]
    return C.failing_links(linked, failing, [links.agg(F.max("t")).first()[0]]).select("id")


@query("WITH o AS (SELECT kind AS pattern, count(*)::BIGINT AS n FROM s WHERE kind IS NOT NULL GROUP BY 1) SELECT 'exact' AS asked, pattern, n FROM o WHERE pattern = 'method' UNION ALL SELECT 'part', pattern, n FROM o WHERE contains(lower(pattern), 'er') UNION ALL SELECT 'none', pattern, n FROM o")
def b39_pattern_ids(spark, d):
    """Kinds as patterns, asked for exactly, by a part, and by what none holds."""
    seen = T.symbols(spark, d, "kind").filter("kind is not null").groupBy(F.col("kind").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name, text in (("exact", "method"), ("part", "ER"), ("none", "zzz")):
        got = C.pattern_ids(seen, text).select(F.lit(name).alias("asked"), "pattern", "n")
        out = got if out is None else out.unionByName(got)
    return out


_TOP = "SELECT '{0}' AS card, label, round(n * 100.0 / total, 1)::DOUBLE AS percent FROM (SELECT {1} AS label, count(*) AS n, sum(count(*)) OVER () AS total FROM {2} WHERE {1} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label DESC LIMIT 1)"


@query(" UNION ALL ".join("(" + _TOP.format(*x) + ")" for x in (("language", "language", "f"), ("kind", "kind", "s"), ("hotspot", "file_path", "s"))) + " UNION ALL (SELECT 'most_referenced', name, NULL::DOUBLE FROM s WHERE reference_score IS NOT NULL ORDER BY reference_score DESC, id DESC LIMIT 1)")
def d35_story_cards(spark, d):
    return C.story_cards(T.symbols(spark, d, "name", "kind", "file_path", "reference_score"), T.files(spark, d, "language"))


# --- graph lookups -----------------------------------------------------------------
@query("""WITH r AS (SELECT s.id, CASE WHEN s.name = 'Quota.merge' THEN 0 WHEN p.id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM s LEFT JOIN s p ON s.parent_id = p.id AND p.name = 'Quota' WHERE s.name IN ('Quota.merge', 'merge'))
 SELECT 'qualified' AS asked, id, tier::INT AS tier FROM r WHERE tier = (SELECT min(tier) FROM r) UNION ALL SELECT 'bare', id, 0::INT FROM s WHERE name = 'drain_depot'""")
def g15_g16_symbol_lookup(spark, d):
    s = T.symbols(spark, d, "name", "parent_id")
    got = lambda name, text: C.symbol_lookup(s, text).select(F.lit(name).alias("asked"), "id", F.col("tier").cast("int").alias("tier"))
    return got("qualified", "Quota.merge").unionByName(got("bare", "drain_depot"))


@query("""WITH p AS (SELECT id FROM s WHERE name = (SELECT min(name) FROM s WHERE kind = 'function' AND id IN (SELECT to_id FROM e))),
 x AS (SELECT from_id AS id FROM e WHERE to_id IN (SELECT id FROM p) UNION SELECT to_id FROM e WHERE from_id IN (SELECT id FROM p)), one AS (SELECT id FROM x WHERE id NOT IN (SELECT id FROM p)),
 plain AS (SELECT id FROM one WHERE id NOT IN (SELECT id FROM s WHERE regexp_matches(file_path, '@TEST@'))), best AS (SELECT plain.id FROM plain LEFT JOIN s ON s.id = plain.id WHERE (SELECT count(*) FROM plain) < 4 ORDER BY s.reference_score DESC NULLS LAST, plain.id LIMIT 3),
 y AS (SELECT from_id AS id FROM e WHERE to_id IN (SELECT id FROM best) UNION SELECT to_id FROM e WHERE from_id IN (SELECT id FROM best))
 SELECT id FROM one UNION SELECT id FROM y WHERE id NOT IN (SELECT id FROM best) AND id NOT IN (SELECT id FROM p)""")
def g10_second_hop(spark, d):
    """The neighbours of one function, and those of its best neighbours if it has few."""
    s = T.symbols(spark, d, "name", "kind", "file_path", "reference_score")
    edges = T.edges(spark, d)
    name = s.filter("kind = 'function'").join(edges.select(F.col("to_id").alias("id")), "id", "left_semi").agg(F.min("name").alias("name"))
    pivots = s.join(F.broadcast(name), "name", "left_semi")
    tests = s.filter(paths.is_test_path(F.col("file_path")))
    return G.second_hop(edges, pivots, G.neighbours(edges, pivots), s.select("id", F.col("reference_score").alias("score")), tests).select("id")


@query("SELECT id FROM s WHERE name = (SELECT min(name) FROM s WHERE kind = 'method') ORDER BY id LIMIT 1000")
def g03_endpoints(spark, d):
    s = T.symbols(spark, d, "name", "kind", "file_path")
    name = s.filter("kind = 'method'").agg(F.min("name")).first()[0]
    return spark.createDataFrame([(i,) for i in G.endpoints(s, name, unique=False)], "id string")


@query("WITH n AS (SELECT min(file_path) AS p FROM s) SELECT id, name, kind FROM s, n WHERE s.file_path = n.p")
def j02_outline(spark, d):
    path = T.symbols(spark, d, "file_path").agg(F.min("file_path")).first()[0]
    return Engine(spark, d).symbols(path).select("id", "name", "kind")


@query("SELECT language, kind, json_extract_string(metadata, '$.arity') AS facet, count(*)::BIGINT AS n FROM s WHERE json_extract_string(metadata, '$.arity') IS NOT NULL GROUP BY ALL")
def j08_pattern_facets(spark, d):
    return Engine(spark, d).patterns()


@query(r"SELECT path, sha256(regexp_replace(content, '\bMap\b', 'Table', 'g')) AS hash, len(regexp_extract_all(content, '\bMap\b'))::INT AS replaced FROM f WHERE regexp_matches(content, '\bMap\b') AND path IN (SELECT file_path FROM i WHERE name = 'Map')")
def j12_rename(spark, d):
    """A name replaced in every file that refers to it."""
    out = context.rename_in_files(T.files(spark, d, "content"), T.identifiers(spark, d, "name", "file_path"), "Map", "Table")
    return out.select("path", F.sha2("content", 256).alias("hash"), "replaced")


@query("SELECT w.workspace_id, coalesce(n, 0)::BIGINT AS files, coalesce(x, 0)::BIGINT AS symbols, CASE WHEN w.last_indexed IS NULL THEN 'missing' WHEN newest > w.last_indexed THEN 'stale' ELSE 'ready' END AS state FROM workspaces w LEFT JOIN (SELECT workspace_id, count(*) AS n, sum(symbol_count) AS x, max(last_indexed) AS newest FROM f GROUP BY 1) g ON w.workspace_id = g.workspace_id")
def j13_workspaces(spark, d):
    return Engine(spark, d).workspaces()


# --- queues and repairs -----------------------------------------------------------
@query("SELECT event_id, rescan FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) > 20 AS rescan, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE NOT rescan OR r <= 15")
def i03_shedding(spark, d):
    """Events that stay queued where a user's queue may hold 20 and is cut to the newest 15."""
    return changes.shed(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 20, 15).select("event_id", "rescan")


@query("""WITH ends AS (SELECT min(revision) AS lo, max(revision) AS hi FROM file_snapshots), cur AS (SELECT revision, workspace_id, file_path, nullif(arg_max(coalesce(hash, chr(1)), last_indexed), chr(1)) AS hash FROM file_snapshots GROUP BY 1, 2, 3),
 a AS (SELECT cur.* FROM cur, ends WHERE revision = hi), b AS (SELECT cur.* FROM cur, ends WHERE revision = lo), w AS (SELECT workspace_id FROM file_snapshots, ends WHERE revision = hi GROUP BY 1 HAVING count(*) > 3)
 SELECT coalesce(a.workspace_id, b.workspace_id) AS workspace_id, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'delete' ELSE 'index' END AS action FROM a FULL JOIN b ON a.workspace_id = b.workspace_id AND a.file_path = b.file_path
 WHERE coalesce(a.workspace_id, b.workspace_id) IN (SELECT workspace_id FROM w) AND (a.file_path IS NULL OR b.file_path IS NULL OR a.hash IS DISTINCT FROM b.hash)""")
def i06_repair(spark, d):
    """What a full comparison of the overflowing workspaces' last listing with the first must change."""
    snap = table(spark, d, "file_snapshots")
    ends = snap.agg(F.min("revision").alias("lo"), F.max("revision").alias("hi"))
    both = snap.crossJoin(F.broadcast(ends))
    from codeloom.sources.tables import current_rows

    now, stored = (current_rows(both.filter(f"revision = {x}"), ["workspace_id", "file_path"], ["hash"]) for x in ("hi", "lo"))
    flagged = changes.needs_rescan(both.filter("revision = hi"), "workspace_id", 3).filter("rescan")
    return changes.repair(now, stored, flagged, "workspace_id", "file_path")


@query("SELECT path FROM f WHERE (SELECT max(last_indexed) FROM files) - last_indexed >= 30 AND coalesce(symbol_count, 0) < 10")
def i07_i08_due_repairs(spark, d):
    """Files as repairs that wait: old enough, and tried (here: symbols) fewer than ten times."""
    f = T.files(spark, d, "symbol_count").select("path", F.col("last_indexed").alias("updated_at"), F.col("symbol_count").alias("attempts"))
    now = table(spark, d, "files").agg(F.max("last_indexed")).first()[0]
    return changes.due_repairs(f, now).select("path")


@query("SELECT id, length(text)::BIGINT AS chars FROM (SELECT id, concat_ws(' ', kind, name) AS text FROM s)")
def i16_batches(spark, d):
    """Every symbol once through a function of at most 250 rows."""
    rows = T.symbols(spark, d, "kind", "name").select("id", F.concat_ws(" ", "kind", "name").alias("text"))

    def measure(pdf):
        assert len(pdf) <= 250
        return pdf.assign(chars=pdf["text"].str.len())[["id", "chars"]]

    return changes.in_batches(rows, measure, "id string, chars long")


QUERIES, ORACLES = query.QUERIES, query.ORACLES
