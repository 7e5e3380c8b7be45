import datetime as dt

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.operators import catalog, changes, context, graph, resolve, search, telemetry, vectors
from codeloom.streaming.changes import fold

EDGE = "id string, from_id string, to_id string, kind string, file_path string, line_number int, confidence double"
SYMBOL = "id string, name string, kind string, language string, file_path string, parent_id string"


def edges(spark, *pairs):
    return spark.createDataFrame([(f"e{i}", a, b, k, "f", 1, 1.0) for i, (a, b, k) in enumerate(pairs)], EDGE)


def test_reference_scores_step_by_step(spark):
    s = spark.createDataFrame([("a", "a", "function", "rust", "src/a.rs", None), ("t", "Trait", "interface", "rust", "src/t.rs", None), ("i", "Impl", "class", "rust", "src/i.rs", None), ("k", "K", "class", "java", "src/k.java", None), ("kc", "K", "constructor", "java", "src/k.java", "k"), ("x", "x", "function", "rust", "tests/x.rs", None), ("ci", "go", "function", "c", "src/go.c", None), ("ch", "go", "function", "c", "src/go.h", None)], SYMBOL)
    e = edges(spark, ("x", "a", "calls"), ("a", "a", "calls"), ("a", "t", "uses"), ("i", "t", "implements"), ("a", "kc", "calls"), ("a", "x", "calls"), ("x", "ch", "mystery"), ("a", "k", "contains"))
    u = spark.createDataFrame([("m.Trait", "src/o.rs", "type_usage"), ("Trait", "src/t.rs", "import")], "name string, file_path string, kind string")
    got = {r.id: r.score for r in graph.reference_scores(s, e, u).collect()}
    assert got["a"] == 3 and got["t"] == pytest.approx(1 + 2 + 1) and got["i"] == pytest.approx(0.7 * got["t"])
    assert got["k"] == pytest.approx(0.7 * 3) and got["x"] == pytest.approx(0.3) and got["ci"] == pytest.approx(0.7 * got["ch"])


def test_distances_cycles_and_limits(spark):
    e = edges(spark, ("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "d", "calls"), ("d", "c", "calls"), ("c", "z", "calls"), ("q", "r", "calls"))
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.hops for r in graph.distances(e, start, 6).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "z": 3}
    assert {r.id for r in graph.distances(e, start, 1).collect()} == {"a", "b", "d"}


def test_impact_caps_and_marks(spark):
    e = edges(spark, *[(f"c{i}", "s", "calls") for i in range(5)], ("far", "c4", "calls"), ("s", "c0", "calls"))
    scores = spark.createDataFrame([(f"c{i}", float(i)) for i in range(5)], "id string, score double")
    seeds = spark.createDataFrame([("s",)], "id string")
    assert {r.id for r in graph.impact(e, scores, seeds, 2, cap=2).collect()} == {"c4", "c3", "far"}


def test_neighbours_prefer_incoming(spark):
    e = edges(spark, ("a", "p", "calls"), ("p", "a", "uses"), ("p", "b", "calls"))
    p = spark.createDataFrame([("p",)], "id string")
    assert {(r.id, r.direction) for r in graph.neighbours(e, p).collect()} == {("a", "incoming"), ("b", "outgoing")}


def test_resolver_prefers_near_and_last(spark):
    s = spark.createDataFrame([("1", "f", "function", "go", "x/y/a.go"), ("2", "f", "function", "go", "z/b.go"), ("3", "f", "field", "go", "x/y/c.go"), ("4", "f", "function", "java", "x/y/d.java"), ("5", "f", "function", "go", "x/y/tests/e.go")], "id string, name string, kind string, language string, file_path string")
    p = spark.createDataFrame([("u", "f", "go", "x/y/m.go"), ("v", "f", None, "q/r/s/m.go"), ("w", "none", "go", "x/y/m.go")], "id string, name string, language string, file_path string")
    got = {r.use_id: (r.symbol_id, r.score) for r in resolve.resolve_calls(p, s).collect()}
    assert got["u"] == ("1", 161) and got["v"][0] == "4" and "w" not in got


def test_routes(spark):
    calls = spark.createDataFrame([("1", "GET", "/a/7", 0.9), ("2", None, "/a/7", 0.9), ("3", "POST", "/a/7", 0.9), ("4", "GET", "/b/1", 0.9), ("5", "GET", None, 0.9)], "id string, verb string, path string, confidence double")
    handlers = spark.createDataFrame([("h", "get", "/a/:id", 0.8), ("g", None, "/a/{x}", 0.7), ("p", "GET", "/b/<n>", 0.6), ("q", "GET", "/b/:n", 0.6), ("low", "POST", "/a/7", 0.4)], "id string, verb string, template string, confidence double")
    got = {r.id: (r.handler_id, r.external) for r in resolve.match_routes(calls, handlers).collect()}
    assert got["1"] == ("h", None) and got["2"] == (None, "/a/7") and got["3"] == ("g", None) and got["4"] == (None, "GET /b/1")


def test_linked_tests_skip_ambiguous_names(spark):
    s = spark.createDataFrame([(f"p{i}", "many", "function", "go", f"src/{i}.go") for i in range(11)] + [("one", "single", "function", "go", "src/s.go"), ("t", "TestX", "function", "go", "tests/t.go")], "id string, name string, kind string, language string, file_path string")
    u = spark.createDataFrame([("many", "go", "t", None), ("single", "go", "t", " "), ("x", "go", "t", "p3")], "name string, language string, containing_symbol_id string, target_symbol_id string")
    assert {(r.id, r.sources) for r in resolve.link_tests(s, u).collect()} == {("one", "name"), ("p3", "resolved")}


def test_globs(spark):
    df = spark.createDataFrame([("src/a.rs",), ("src/x/b.py",), ("lib/c.rs",), ("a.rs",)], "path string")
    hit = lambda g: {r[0] for r in df.filter(catalog.glob(F.col("path"), g)).collect()}
    assert hit("src/**/*.{rs,py}") == {"src/a.rs", "src/x/b.py"}
    assert hit("a.rs") == {"src/a.rs", "a.rs"}
    assert hit("**/*.rs,!lib/**") == {"src/a.rs", "a.rs"}


def test_nth_element_is_not_interpolated(spark):
    for n, want in ((1, 0.0), (20, 19.0), (21, 19.0)):
        df = spark.createDataFrame([("g", float(i)) for i in range(n)] + [("g", None)], "g string, v double")
        assert catalog.nth_element(df, ["g"], "v", {"p95": 0.95}).first().p95 == want


def test_episodes(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    calls = [(1, "s", "w", at(0), "find_text", 0), (2, "s", "w", at(10), "find_text", 3), (3, "s", "w", at(21), "find_text", 1), (4, "s", "w", at(22), "open_symbol", 1), (5, "s", "v", at(23), "rank_hits", 1), (6, "s", "x", at(24), "rank_hits", 1), (7, None, "x", at(1), "rank_hits", 1)]
    df = spark.createDataFrame(calls, "id long, session_id string, workspace_id string, called_at timestamp_ntz, tool_name string, result_count long")
    got = sorted((r.episode, r.searches, r.zero_hits, r.outcome_tool) for r in telemetry.episodes(df).collect())
    assert got == [(1, 2, 1, None), (2, 1, 0, "open_symbol"), (3, 1, 0, None), (4, 1, 0, None)]


def test_tokens():
    assert search.tokenize("getHTTPResponse my_var x->y") == ["gethttpresponse", "get", "http", "response", "my_var", "my", "var", "x", "y"]
    assert search.tokenize("a::b is_valid", preserve=("::",), affixes=("is_",)) == ["a", "::", "b", "is_valid", "is", "valid"]
    assert search.tokenize("IUserService", prefixes=("I",), suffixes=("Service",)) == ["iuserservice", "i", "user", "service", "userservice", "iuser"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB_ .-:é日", max_size=30))
def test_tokens_are_lower_case_and_stable(text):
    once = search.tokenize(text)
    assert all(t == t.lower() for t in once) and all(t in search.tokenize(t) for t in once)


def test_query_parsing():
    q = search.parse_query("test call trace loading @Override")
    assert q.intent == "test" and q.annotations == ["override"] and "callers" in q.aliases
    assert search.parse_query("semantic search").aliases and search.is_natural("how does fast_refs work") and not search.is_natural("a_b c_d")
    assert search.rrf_weights("parse_query") == (1.0, 0.3) and search.preprocess("*.rs") == "glob"


def test_bm25_by_hand_and_relaxation(spark):
    docs = spark.createDataFrame([(1, "alpha beta", None), (2, "alpha alpha gamma delta", ""), (3, "omega", "alpha"), (4, None, None)], "id long, body string, note string")
    q = [search.parse_query("alpha beta"), search.parse_query("beta omega"), search.parse_query("nothing")]
    got = {(r["query"], r["id"]): (r.score, r.mode) for r in search.bm25(docs, "id", {"body": 1.0}, q).collect()}
    import math

    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (7 / 4)))
    assert set(got) == {(0, 1), (1, 1), (1, 3)} and got[0, 1][1] == "and" and got[1, 1][1] == "or"
    assert got[0, 1][0] == pytest.approx(idf(2) * part(1, 2) + idf(1) * part(1, 2))


def test_rerank_boosts_and_demotes(spark):
    schema = "score double, title string, path string, kind string, role string, body string, is_file boolean, is_test boolean, is_source boolean"
    df = spark.createDataFrame([(1.0, "scan", "src/scan.rs", "function", "source", "fn scan", False, False, True), (1.0, "scan", "vendor/scan.rs", "function", "vendor", "fn scan", False, False, True), (1.0, "browser_client", "src/x.py", "class", "source", None, False, False, True), (1.0, "browser_client", "src/browser_client.py", None, "source", None, True, False, True)], schema)
    got = [r.final for r in search.rerank(df, search.parse_query("scan")).collect()]
    assert got[0] == 1 + 100 + 40 + 10 + 60 and got[0] - got[1] == 130
    got = [r.final for r in search.rerank(df, search.parse_query("BrowserClient")).collect()]
    assert got[2] == 1 + 100 + 50 and got[3] == 1 + 120 + 30 + 30 * 0 or got[3] > got[2]


def test_lines(spark):
    f = spark.createDataFrame([("a", "x = retry_later\r\nRETRY-LATER\nnope", 1), ("b", None, 1), ("c", "", 1)], "path string, content string, line int")
    assert rows(search.line_search(f.drop("line"), "retry_later")) == [("a", 1, "x = retry_later"), ("a", 2, "RETRY-LATER")]
    assert rows(search.line_search(f.drop("line"), "nope -x")) == [("a", 3, "nope")]
    assert rows(search.line_search(f.drop("line"), "nope OR x")) == [("a", 1, "x = retry_later"), ("a", 3, "nope")]


def test_knn_exact_ties_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.id, r.rank) for r in vectors.knn(df, df.filter("vec_id = 1"), 2).collect()]
    assert sorted(got) == [(2, 1), (6, 2)]
    l2 = vectors.knn(df, df.filter("vec_id = 1"), 5, metric="l2").collect()
    assert {r.id for r in l2} == {2, 3, 4, 6} and vectors.knn(df.limit(0), df, 3).count() == 0


def test_rrf_is_symmetric_with_equal_weights(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    assert rows(vectors.rrf(a, b)) == rows(vectors.rrf(b, a)) and vectors.rrf(a, b).first().id == "y"


def test_event_folding_matches_the_stream(spark):
    events = [("p", "C", 1), ("p", "M", 2), ("q", "D", 1), ("q", "C", 2), ("r", "C", 1), ("r", "D", 2), ("s", "R", 1), ("s", "M", 2), ("t", "M", 1)]
    df = spark.createDataFrame(events, "path string, change string, seq long")
    got = {r.path: r.change for r in changes.merge_events(df, "path", ["seq"], "change").collect()}
    want = {}
    for p, c, _ in events:
        want[p] = fold(want.get(p), c)
    assert got == want == {"p": "C", "q": "M", "r": "D", "s": "R", "t": "M"}


def test_debounce_border(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", t, 1), ("p", t + dt.timedelta(seconds=1), 2), ("p", t + dt.timedelta(seconds=2, microseconds=1), 3)], "path string, ts timestamp_ntz, seq long")
    assert [r.seq for r in changes.debounce(df, "path", "ts", 1, ["seq"]).orderBy("seq").collect()] == [1, 3]


def test_context_helpers():
    assert context.pivot_count([10, 4]) == 1 and context.pivot_count([10, 9, 8]) == 3 and context.pivot_count([10, 9, 1]) == 2 and context.pivot_count([]) == 0
    assert context.pack(["x" * 900, "y" * 10, "z" * 5], 1) == ([0], [1, 2])
    assert context.pack(["x" * 500, "y" * 400, "z" * 200], 100) == ([0, 2], [1])
    assert context.edit("a\n  b\nc", "b\nc", "d") == "a\n  d" and context.rename("ab a b.a", "a", "z") == "ab z b.z"
    assert context.strip_comments('a "//x" // y\nb /* z\n */ c') == 'a "" \nb \n c'
    assert len(context.head_tail("\n".join("line" * 5 for _ in range(100)), 50).split("\n")) < 15
