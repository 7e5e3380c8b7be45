"""Queries on scans, sinks, streams, single requests and set operations (A, B25, B33, B35, E13, E14, F08, F39, G18, H33, H47, H49, I01, I05, J, K) with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.api import Engine
from codeloom.operators import analysis as A
from codeloom.operators import catalog as C
from codeloom.operators import context
from codeloom.operators import search as S
from codeloom.plans.cut import shared_dir, write_bytes
from codeloom.plans.split import split_prefix
from codeloom.queries import relations
from codeloom.queries.base import Area, with_ctes
from codeloom.queries.operations import _EV, _events
from codeloom.queries.operations import ORACLES as OPERATIONS
from codeloom.queries.scalars import _NOT_CODE
from codeloom.sources import catalogue as T
from codeloom.sources import sinks
from codeloom.sources.tables import table
from codeloom.streaming import changes as stream

query = Area()

# --- sources and sinks --------------------------------------------------------
_TREE = {
    "src/a.py": b"x = 1\ny = 2\n", "src/deep/b.rs": b"fn main() {}\n", "node_modules/c.js": b"f()\n", "lib.min.js": b"f()\n", "notes.unknown": b"plain text", "bin/d.py": b"x\n", "blob.py": b"\x50\x01\x00\x00", "big.py": b"x = 1\n" * 200_000, "old/e.py": b"x\n",
}


@query("SELECT * FROM (VALUES ('src/a.py', 'python', 12, 3), ('src/deep/b.rs', 'rust', 13, 2), ('notes.unknown', 'text', 10, 1)) AS t(path, language, size, line_count)")
def a03_a06_a28_scan(spark, d):
    """A folder with sources, a text without parser, and all that a scan leaves out: tools' folders, minified, binary and large files, and what the ignore file names."""
    root = f"tree-{uuid.uuid4().hex}"
    for name, data in _TREE.items():
        write_bytes(spark, f"{root}/{name}", data)
    write_bytes(spark, f"{root}/.gitignore", b"old/\n")
    return sinks.scan(spark, f"{shared_dir(spark)}/{root}").select("path", "language", F.col("size").cast("int").alias("size"), F.col("line_count").cast("int").alias("line_count"))


@query("SELECT id, name, kind, file_path, parent_id, last_indexed FROM s")
def a13_symbols_sink(spark, d):
    return T.symbols(spark, d, "name", "kind", "file_path", "parent_id")


@query("SELECT id, from_id, to_id, kind, file_path, line_number, confidence FROM e")
def a14_relationships_sink(spark, d):
    return T.edges(spark, d)


@query("SELECT id, type_name, coalesce(ordinal, -1)::INT AS ordinal FROM ta WHERE identifier_id IN (SELECT id FROM i)")
def a18_types_sink(spark, d):
    """Type arguments whose use is known."""
    t = T.type_arguments(spark, d, "identifier_id", "type_name", "ordinal")
    return C.lookup_joined(t, "identifier_id", T.identifiers(spark, d).select("id")).select("id", "type_name", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"))


# --- filters -------------------------------------------------------------------
@query("SELECT id FROM s WHERE language = 'python' AND kind = 'function' AND regexp_matches(file_path, '^(?:.*/)?[^/]*\\.py$') AND NOT regexp_matches(file_path, '@TEST@')")
def b25_search_filter(spark, d):
    s = T.symbols(spark, d, "language", "kind", "file_path")
    return s.filter(C.search_filter(language="Python", kind="function", file_pattern="**/*.py", no_tests=True)).select("id")


@query("WITH w AS (SELECT min(workspace_id) AS w FROM file_snapshots), h AS (SELECT revision, count(DISTINCT file_path)::BIGINT AS files FROM file_snapshots, w WHERE workspace_id = w GROUP BY 1) SELECT revision, files FROM h ORDER BY revision DESC LIMIT 4")
def b33_snapshot_history(spark, d):
    """One workspace's last four snapshots with their number of files."""
    snap = table(spark, d, "file_snapshots")
    w = snap.agg(F.min("workspace_id").alias("workspace_id"))
    h = snap.join(F.broadcast(w), "workspace_id", "left_semi").groupBy("revision").agg(F.count_distinct("file_path").alias("files"))
    return C.ranked(h, "revision", 4, ())


@query("SELECT id, language FROM s WHERE json_extract_string(metadata, '$.arity') = '2'")
def b35_facts_by_pattern(spark, d):
    s = T.symbols(spark, d, "language", "metadata").withColumn("facet", F.get_json_object("metadata", "$.arity"))
    return C.lookup(s, "facet", "2").select("id", "language")


@query("SELECT * FROM (VALUES (-5, 1), (0, 1), (1, 1), (6, 6), (500, 500), (501, 500), (100000, 500)) AS t(asked, allowed)")
def e13_limit_clamp(spark, d):
    return spark.createDataFrame([(n, C.clamp(n)) for n in (-5, 0, 1, 6, 500, 501, 100000)], "asked int, allowed int")


@query("SELECT * FROM (VALUES (250, 10), (200, 7), (130, 5), (80, 3), (30, 1), (1, 1)) AS t(tokens, kept)")
def e14_reduction(spark, d):
    """How many of ten items of 25 tokens each stay within some budgets."""
    return spark.createDataFrame([(n, len(context.reduce(["x" * 100] * 10, n))) for n in (250, 200, 130, 80, 30, 1)], "tokens int, kept int")


# --- tokens ----------------------------------------------------------------------
_SEGS = r"list_filter(regexp_split_to_array(signature, '[\s\x0b(){}\[\]<>,;\"''!@#$%^&*+=|~/\\`.\-:]+'), lambda x: regexp_full_match(x, '[\p{L}\p{N}_]+'))"
_PARTS = r"CASE WHEN regexp_matches(x, '\p{Lu}') AND regexp_matches(x, '\p{Ll}') THEN regexp_split_to_array(regexp_replace(regexp_replace(x, '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g'), chr(1)) ELSE [] END"
_AFFIX = " , ".join(f"CASE WHEN starts_with(x, '{a}') AND strlen(x) - {len(a)} >= 2 THEN substr(x, {len(a) + 1}) END, CASE WHEN ends_with(x, '{a}') AND strlen(x) - {len(a)} >= 2 THEN left(x, length(x) - {len(a)}) END" for a in ("is_", "_mut"))
_ENDS = ", ".join(f"CASE WHEN ends_with(x, '{a}') AND length(x) > {len(a)} THEN left(x, length(x) - {len(a)}) END" for a in ("Store", "Reader"))
_HEAD = r"CASE WHEN starts_with(x, 'I') AND length(x) > 1 AND regexp_matches(x[2], '\p{Lu}') THEN substr(x, 2) END"


_GIVEN = f"list_filter(list_transform(list_concat([x], {_PARTS}, CASE WHEN contains(x, '_') THEN string_split(x, '_') ELSE [] END, [{_AFFIX}, {_HEAD}, {_ENDS}]), lambda t: lower(t)), lambda t: t IS NOT NULL AND t <> '')"


#: Of the query in :mod:`codeloom.queries.retrieval`: a segment's tokens in their order, each once.
_IN_ORDER = f"SELECT id, array_to_string(flatten(list_transform({_SEGS}, lambda x: list_filter({_GIVEN}, lambda t, i: list_position({_GIVEN}, t) = i))), ' ') AS tokens FROM s WHERE signature IS NOT NULL"


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform({_SEGS}, lambda x: list_concat([x], {_PARTS}, CASE WHEN contains(x, '_') THEN string_split(x, '_') ELSE [] END, [{_AFFIX}, {_HEAD}, {_ENDS}]))), lambda t: lower(t)), lambda t: t IS NOT NULL AND t <> ''))), ' ') AS tokens FROM s WHERE signature IS NOT NULL")
def f08_f09_f39_f40_distinct_tokens(spark, d):
    """The distinct tokens of each signature with their variants without affixes."""
    toks = S.code_tokens(F.col("signature"), affixes=("is_", "_mut"), prefixes=("I",), suffixes=("Store", "Reader"))
    return T.symbols(spark, d, "signature").filter("signature is not null").select("id", F.array_join(F.array_sort(F.array_distinct(toks)), " ").alias("tokens"))


# --- tests -------------------------------------------------------------------------
def _evidence(kind: str) -> str:
    return " OR ".join(f"(i.language = '{lang}' AND lower(i.name) IN ({', '.join(repr(n) for n in sets[kind])}))" for lang, sets in A.EVIDENCE.items() if sets[kind])


def _picked(name: str, pattern: str) -> str:
    return f"CASE WHEN empty THEN 0 WHEN named THEN c.{name} ELSE len(regexp_extract_all(code, '{pattern}')) END::INT AS {name}"


@query(rf"""WITH c AS (SELECT containing_symbol_id AS id, count(*) FILTER ({_evidence('assertions')}) AS assertions, count(*) FILTER ({_evidence('errors')}) AS errors, count(*) FILTER ({_evidence('mocks')}) AS mocks FROM i WHERE kind = 'call' AND containing_symbol_id IS NOT NULL GROUP BY 1),
 t AS (SELECT id, regexp_replace(code_context, '{_NOT_CODE}', ' ', 'g') AS code, regexp_matches(lower(trim(regexp_replace(trim(code_context), '(?s)^\{{(.*)\}}$', '\1'))), '^(pass|\.\.\.|todo!\(\)|unimplemented!\(\)|todo|// todo|# todo)( |$)') OR trim(regexp_replace(trim(code_context), '(?s)^\{{(.*)\}}$', '\1')) = '' AS empty FROM s WHERE kind IN ('function', 'method') AND code_context IS NOT NULL AND regexp_matches(file_path, '@TEST@') AND name IS NOT NULL),
 x AS (SELECT t.id, empty, named, {_picked('assertions', A.ASSERTIONS)}, {_picked('errors', A.ERRORS)}, {_picked('mocks', A.MOCKS)} FROM (SELECT t.*, coalesce(c.assertions + c.errors + c.mocks > 0, FALSE) AS named FROM t LEFT JOIN c ON t.id = c.id) t LEFT JOIN c ON t.id = c.id)
 SELECT id, assertions, errors, mocks, CASE WHEN empty THEN 'placeholder' WHEN named THEN 'calls' ELSE 'patterns' END AS evidence, CASE WHEN empty OR assertions = 0 THEN 'stub' WHEN assertions >= 3 OR errors > 0 OR (mocks > 0 AND assertions >= 2) THEN 'thorough' WHEN assertions = 1 THEN 'thin' ELSE 'adequate' END AS tier, CASE WHEN NOT empty AND NOT named THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM x""")
def h33_assessed_tests(spark, d):
    """Every function of a test path, taken for a test case by its name."""
    s = T.symbols(spark, d, "name", "kind", "file_path", "code_context").withColumn("name", F.concat(F.lit("test_"), "name"))
    return A.assess_tests(s, T.identifiers(spark, d, "name", "kind", "language", "containing_symbol_id"))


# --- single requests ------------------------------------------------------------------
_EDITS = [("exact", "a = 1\nb = 1\n", "= 1", "= 2", "last"), ("all", "f(f(x))", "f", "g", "all"), ("lines", "if x:\n      y()\n", "  if x:\n  y()", "z()", "first"), ("slip", "let quota = 1;", "let qouta = 1;", "ok", "first")]


@query("SELECT * FROM (VALUES ('exact', e'a = 1\\nb = 2\\n'), ('all', 'g(g(x))'), ('lines', e'z()\\n'), ('slip', 'ok')) AS t(name, after)")
def j10_edits(spark, d):
    return spark.createDataFrame([(n, context.edit(t, old, new, which)) for n, t, old, new, which in _EDITS], "name string, after string")


_SOURCE = "  def f(a):\n    pass\nend"


@query("SELECT * FROM (VALUES ('replace_full', e'  X\\nend'), ('replace_body', e'  def f(a):\\nX\\nend'), ('replace_signature', e'  X    pass\\nend'), ('insert_before', e'  Xdef f(a):\\n    pass\\nend'), ('insert_after', e'  def f(a):\\n    passX\\nend'), ('add_doc', e'  X\\n  def f(a):\\n    pass\\nend')) AS t(operation, after)")
def j11_span_operations(spark, d):
    return spark.createDataFrame([(o, context.rewrite_span(_SOURCE, 2, 20, "X", o, 12, 20)) for o in context.OPERATIONS], "operation string, after string")


@query("SELECT e'--- a/p\\n+++ b/p\\n@@ -1,2 +1,2 @@\\n x\\n-y\\n+z\\n' AS diff")
def j22_diff(spark, d):
    return spark.createDataFrame([(context.unified_diff("x\ny\n", "x\nz\n", "p"),)], "diff string")


@query("SELECT * FROM (VALUES ('whole', 3), ('cut', 6)) AS t(name, lines)")
def h47_h49_truncated_code(spark, d):
    """A text within its limits stays whole; a longer one keeps five lines and a mark in each gap."""
    smart = context.smart_truncate([f"line {i}" for i in range(20)] + ["def f():", "return 1"], 5)
    rows = [("whole", len(context.head_tail("a\nb\nc", 100).split("\n"))), ("cut", len(smart.split("\n")))]
    return spark.createDataFrame(rows, "name string, lines int")


@query("SELECT min(name) AS title FROM s WHERE kind = 'function'")
def j01_search_promotes_names(spark, d):
    """The first hit of a search for a function's full name."""
    name = T.symbols(spark, d, "name", "kind").filter("kind = 'function'").agg(F.min("name")).first()[0]
    return Engine(spark, d).search(name, limit=1, exclude_tests=False).select("title")


_DIVE = "(SELECT max(name) FROM s WHERE kind = 'class' AND id IN (SELECT parent_id FROM s))"


@query(f"SELECT 'definitions' AS part, id FROM s WHERE name = {_DIVE} UNION ALL SELECT 'children', id FROM s WHERE parent_id IN (SELECT id FROM s WHERE name = {_DIVE})")
def j03_deep_dive(spark, d):
    s = T.symbols(spark, d, "name", "kind", "parent_id")
    name = s.filter("kind = 'class'").join(s.select(F.col("parent_id").alias("id")), "id", "left_semi").agg(F.max("name")).first()[0]
    got = Engine(spark, d).deep_dive(name)
    return got["definitions"].select(F.lit("definitions").alias("part"), "id").unionByName(got["children"].select(F.lit("children").alias("part"), "id"))


@query("SELECT from_id || ',' || to_id AS path FROM e WHERE from_id <> to_id ORDER BY from_id, to_id LIMIT 1")
def j05_call_path(spark, d):
    """The path between the ends of one edge."""
    a, b = T.edges(spark, d).filter("from_id <> to_id").orderBy("from_id", "to_id").select("from_id", "to_id").first()
    return spark.createDataFrame([(",".join(Engine(spark, d).call_path(a, b)),)], "path string")


@query("SELECT TRUE AS pivots_fit, TRUE AS within")
def j06_context(spark, d):
    """The context of a question has one to three pivots and its code keeps to the budget, but for the least that is always kept."""
    got = Engine(spark, d).context("settle quota ledger", 10)
    n = len(got["pivots"])
    budget = context.allocate(max(1, n))["pivots"] // max(1, n)
    return spark.createDataFrame([(1 <= n <= 3, all(context.estimate(code) <= budget or code.count("\n") <= 6 for _, code in got["pivots"]))], "pivots_fit boolean, within boolean")


@query(f"SELECT source, count(*)::BIGINT AS n FROM ({relations.ORACLES['c21_j04_references']}) GROUP BY 1" if "c21_j04_references" in relations.ORACLES else None)
def g18_reference_sources(spark, d):
    """How many places the merged references have from edges and from uses."""
    return relations.QUERIES["c21_j04_references"](spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- streams ---------------------------------------------------------------------------
@query(OPERATIONS["i02_merge_events"])
def i01_i05_stream_merge(spark, d):
    """The same merge from a stream of files, applied batch by batch."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = _events(spark, d).select(F.col("path").cast("string").alias("path"), "change", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"))
    events.coalesce(1).write.parquet(f"{root}/in")
    stream.run(stream.merged(stream.read_events(spark, f"{root}/in")), lambda batch, n: batch.write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint")
    last = spark.read.parquet(f"{root}/out").groupBy("path").agg(F.max(F.struct("events", "change")).alias("b"))
    kind = dict(_events(spark, d).dtypes)["path"]
    return last.select(F.col("path").cast(kind).alias("path"), F.col("b.change").alias("change"), F.col("b.events").alias("events"))


# --- set operations and windows -----------------------------------------------------------
@query("SELECT 'first' AS op, file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS r FROM s WHERE file_path IS NOT NULL AND start_line IS NOT NULL) WHERE r = 1 UNION ALL SELECT 'third', file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS r FROM s WHERE file_path IS NOT NULL AND start_line IS NOT NULL) WHERE r = 3")
def k06_k07_ranks(spark, d):
    s = T.symbols(spark, d, "file_path", "start_line").filter("file_path is not null and start_line is not null").select("file_path", "start_line", "id")
    one = C.first_per_group(s, ["file_path"], ["start_line", "id"]).select(F.lit("first").alias("op"), "file_path", "id")
    return one.unionByName(C.top_per_group(s, ["file_path"], ["start_line", "id"], 3).filter("rank = 3").select(F.lit("third").alias("op"), "file_path", "id"))


@query("SELECT kind, count(*)::BIGINT AS n, TRUE AS dense FROM s WHERE kind IS NOT NULL GROUP BY 1")
def k10_split_prefix(spark, d):
    """Whether the running counts of each kind, made without any task that holds a kind, are 0 to n - 1."""
    rows = split_prefix(T.symbols(spark, d, "kind").filter("kind is not null").select("kind", "id"), ["kind"], ["id"], F.lit(1).cast("long"), "place")
    per = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("a"), F.max("place").alias("b"), F.count_distinct("place").alias("x"))
    return per.select("kind", "n", ((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("x") == F.col("n"))).alias("dense"))


@query("SELECT language, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM i GROUP BY 1")
def k11_shares(spark, d):
    return C.share_of_total(T.identifiers(spark, d, "language"), "language")


@query("SELECT path FROM f WHERE last_modified >= (SELECT max(last_modified) FROM f) - 30 * 86400 ORDER BY last_modified DESC, path LIMIT 1000000")
def k14_k16_recent(spark, d):
    """Files of the last thirty days before the newest, which a scalar subquery tells."""
    f = T.files(spark, d, "last_modified")
    now = f.agg(F.max("last_modified")).first()[0]
    return C.recent_files(f, now, 30, 1_000_000).select("path")


@query("SELECT s.id, CASE WHEN EXISTS (SELECT * FROM e WHERE e.to_id = s.id) THEN 1.0 ELSE coalesce(s.reference_score, 0.0) END::DOUBLE AS reference_score FROM s")
def k15_k17_gated_update(spark, d):
    """A column set where a row exists elsewhere, and its own value or a default else."""
    hit = T.edges(spark, d).select(F.col("to_id").alias("id")).distinct().withColumn("reference_score", F.lit(1.0))
    s = T.symbols(spark, d, "reference_score").select("id", F.coalesce("reference_score", F.lit(0.0)).alias("reference_score"))
    return C.update_where_exists(s, hit, "id", "reference_score")


@query("SELECT name, n::BIGINT AS n, rank::INT AS rank FROM (SELECT name, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT name, count(*) AS n FROM i WHERE name IS NOT NULL GROUP BY 1)) WHERE rank <= 3")
def k08_dense_ranks(spark, d):
    """The names with the three greatest numbers of uses, ties included; the numbers are ranked, of which there are few."""
    n = T.identifiers(spark, d, "name").filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    top = n.select("n").distinct().orderBy(F.desc("n")).limit(3).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"))))
    return n.join(F.broadcast(top), "n").select("name", "n", "rank")


QUERIES, ORACLES = query.QUERIES, query.ORACLES | {"f08_f39_f40_code_tokens": with_ctes(_IN_ORDER)}
