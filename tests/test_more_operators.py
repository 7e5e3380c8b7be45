import pytest
from conftest import rows
from pyspark.sql import functions as F

from codeloom.operators import analysis, catalog, changes, context, graph, resolve, search

EDGE = "id string, from_id string, to_id string, kind string, file_path string, line_number int, confidence double"


def edges(spark, *pairs):
    return spark.createDataFrame([(f"e{i}", a, b, k, "f", 1, 1.0) for i, (a, b, k) in enumerate(pairs)], EDGE)


def test_namespaces_score_or_veto(spark):
    df = spark.createDataFrame([(None, "m"), ("crate::a::b", "x::a::b"), ("std::fs", "fs"), ("crate::a", "b"), ("other::a", "a")], "ns string, m string")
    assert [r[0] for r in df.select(resolve.namespace_score(F.col("ns"), F.col("m"))).collect()] == [0, 500, 450, None, None]


def test_implementors(spark):
    s = spark.createDataFrame([("t", "T", "trait"), ("a", "A", "struct"), ("c", "C", "class")], "id string, name string, kind string")
    e = edges(spark, ("a", "t", "implements"), ("gone", "t", "extends"), ("a", "c", "extends"))
    assert rows(resolve.implementor_map(s, e)) == [("t", ["A", "gone"])]


def test_parent_context(spark):
    c = spark.createDataFrame([("f", "s", "P"), ("g", "s", "Q")], "caller_file string, caller_scope string, parent_name string")
    u = spark.createDataFrame([("f", "P", "s"), ("h", "Q", None)], "file_path string, name string, containing_symbol_id string")
    assert {(r.parent_name, r.in_file, r.in_scope) for r in resolve.parent_context(c, u).collect()} == {("P", True, True), ("Q", False, False)}


def test_file_scores_and_rescue(spark):
    f = spark.createDataFrame([("src/main.rs",), ("main.rs",), ("src/other.rs",), (None,)], "path string")
    got = {r.path: r.score for r in search.file_scores(f, "main.rs").collect()}
    assert got == {"src/main.rs": 31.0, "main.rs": 71.0}
    some, none = f.filter("path = 'main.rs'"), f.limit(0)
    assert {r.rescued for r in search.rescued(some, f).collect()} == {False} and {r.rescued for r in search.rescued(none, some).collect()} == {True}
    assert search.semantic_fallback("parse_query", 0, False) and not search.semantic_fallback("parse_query", 0, True)


def test_endpoints(spark):
    s = spark.createDataFrame([("1", "f", "a/x.rs"), ("2", "f", "b/y.rs")], "id string, name string, file_path string")
    assert graph.endpoints(s, "f", "x.rs") == ["1"] and graph.endpoints(s, "f", unique=False) == ["1", "2"]
    for bad in ("f", "g"):
        with pytest.raises(ValueError):
            graph.endpoints(s, bad)


def test_second_hop(spark):
    e = edges(spark, ("a", "p", "calls"), ("b", "a", "calls"), ("p", "b", "calls"), ("z", "b", "calls"))
    p = spark.createDataFrame([("p",)], "id string")
    scores = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    first = graph.neighbours(e, p)
    assert {r.id for r in graph.second_hop(e, p, first, scores, p.limit(0)).collect()} == {"a", "b", "z"}
    assert {r.id for r in graph.second_hop(e, p, first, scores, p.limit(0), enough=2).collect()} == {"a", "b"}


def test_symbol_lookup_tiers(spark):
    s = spark.createDataFrame([("c", "C", None), ("m", "run", "c"), ("n", "run", None), ("q", "C::run2", None)], "id string, name string, parent_id string")
    ids = lambda name: {r.id for r in catalog.symbol_lookup(s, name).collect()}
    assert ids("C::run") == {"m"} and ids("run") == {"m", "n"} and ids("D.run") == {"m", "n"} and ids("C::run2") == {"q"} and ids("zz") == set()


def test_truncation_and_seeds():
    text = context.smart_truncate(["def f():", "  a", "  b", "  return c", "end"], 3)
    assert text == "def f():\n...\n  return c\nend"
    assert context.inject_seeds({"a": 3.0}, {"b"}, {"a", "c"}, {"d"}) == {"a": 3.0, "b": 3.0, "c": 0.75, "d": 0.35}


def test_repairs_and_batches(spark):
    r = spark.createDataFrame([("a", 0, 0), ("b", 90, None), ("c", 0, 10)], "path string, updated_at long, attempts int")
    assert [x.path for x in changes.due_repairs(r, 100).collect()] == ["a"]
    n = changes.in_batches(spark.range(600).coalesce(1), lambda pdf: pdf.assign(n=len(pdf)).head(1), "id long, n long", 250)
    assert sorted(x.n for x in n.collect()) == [100, 250, 250] or sum(x.n for x in n.collect()) == 600


def test_quality_roles_and_warnings(spark):
    schema = "id string, name string, kind string, language string, file_path string, visibility string, doc_comment string, code_context string, reference_score double"
    s = spark.createDataFrame([("t", "test_a", "function", "python", "tests/a.py", None, None, "assert x\nassert y\nwith raises(E): pass", None), ("n", "setup_db", "function", "python", "tests/a.py", None, None, "", None), ("m", "main", "function", "go", "a.go", "public", None, "x", 9.0), ("u", None, "function", "go", "a.go", None, " ", None, None)], schema)
    q = {r.id: r.tier for r in analysis.test_quality(s).collect()}
    assert q == {"t": "thorough", "n": "stub"}
    roles = {r.id: r.role for r in s.select("id", analysis.test_role(F.col("name"), F.col("kind"), F.col("file_path")).alias("role")).collect()}
    assert roles == {"t": "test_case", "n": "fixture_setup", "m": None, "u": None}
    w = {(r.id, r.warning) for r in analysis.warnings(s, edges(spark)).collect()}
    assert w == {("m", "entry_point"), ("m", "unreferenced"), ("m", "undocumented_hot")}
