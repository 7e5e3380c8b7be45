import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.operators import analysis, annotations, catalog, changes, context, pages, projection, resolve, web
from codeloom.plans.cut import read_bytes, write_bytes
from codeloom.sources import sinks


def test_pages_belong_to_their_owner_and_expire(spark):
    held = pages.Spillover(spark, entries=2, ttl=100)
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v"), F.lit("clash").alias("title"))
    h = held.put(df.repartition(7), "me", ["v"], now=0)
    assert [(r.row, r.v) for r in held.get(h, "me", 495, 10, now=1).orderBy("row").collect()] == [(i, i) for i in range(495, 505)]
    assert held.get(h, "me", 995, 50, now=1).count() == 5 and held.get(h, "me", 2000, 5, now=1).count() == 0
    with pytest.raises(KeyError):
        held.get(h, "you", now=1)
    empty = held.put(df.limit(0), "me", ["v"], now=2)
    assert held.get(empty, "me", now=2).count() == 0
    third = held.put(df, "me", ["v"], now=3)
    with pytest.raises(KeyError):  # it made room
        held.get(h, "me", now=3)
    with pytest.raises(KeyError):
        held.get(third, "me", now=200)


def test_projection_documents(spark):
    s = spark.createDataFrame([("a", "loadXMLFile", "fn load_x(a)", "é" * 1500, "p"), ("b", None, None, None, None)], "id string, name string, signature string, code_context string, file_path string")
    rows = {r.key: r for r in projection.symbol_documents(s).collect()}
    assert rows["a"].body == "é" * 1000 and rows["a"].pretokenized.split(" ")[:8] == ["loadXMLFile", "load", "XML", "File", "fn", "load_x(a)", "load", "x(a)"]
    assert rows["b"].pretokenized == "" and rows["b"].body == ""
    docs = projection.symbol_documents(s)
    assert [r.key for r in projection.delete_paths(docs, spark.createDataFrame([("p",), ("p",), (None,)], "file_path string")).collect()] == ["b"]
    edges = spark.createDataFrame([("a", "c")], "from_id string, to_id string")
    s2 = spark.createDataFrame([("a", "p"), ("c", "q"), ("d", "r")], "id string, file_path string")
    assert {r[0] for r in projection.partner_paths(s2, edges, spark.createDataFrame([("q",)], "file_path string")).collect()} == {"p", "q"}


def test_annotations(spark):
    s = spark.createDataFrame([("a", "@Since 2 @param x", "clash"), ("b", None, None), ("c", "none", None)], "id string, doc_comment string, annotation string")
    tags = annotations.doc_tags(s)
    assert {(r.id, r.annotations) for r in annotations.hydrate(s.select("id"), tags).collect()} == {("a", "since param"), ("b", None), ("c", None)}
    assert [r.id for r in annotations.annotated(s, tags, ["Param", "since"]).collect()] == ["a"] and annotations.annotated(s, tags, ["param", "x"]).count() == 0 and annotations.annotated(s, tags, []).count() == 3


def test_web_edges_lead_to_external_names(spark):
    m = spark.createDataFrame([("c1", "h1", None, 0.9), ("c2", None, "GET /x", None)], "id string, handler_id string, external string, confidence double")
    w = web.web_edges(m)
    assert {(r.from_id, r.to_id, r.external) for r in w.collect()} == {("c1", "h1", False), ("c2", "external:GET /x", True)}
    seeds = spark.createDataFrame([("h1",), ("h1",), ("h9",)], "id string")
    assert [(r.seed, r.caller) for r in web.web_callers(w, seeds).collect()] == [("h1", "c1")]


def test_reexports_and_bounded_names(spark):
    pending = spark.createDataFrame([(1, None), (2, "a")], "id int, path string")
    none = spark.createDataFrame([], "path string, target string")
    assert {(r.id, r.resolved) for r in resolve.chase_reexports(pending, none).collect()} == {(1, None), (2, "a")}
    pairs = spark.createDataFrame([("g", f"n{i:03d}") for i in range(300)] * 2, "g string, n string")
    assert sorted(r.n for r in resolve.first_names(pairs, "g", "n", 3).collect()) == ["n000", "n001", "n002"]


def test_merged_events_do_not_depend_on_spans(spark):
    import itertools

    kinds = ["C", "M", "D", "R"]
    rows = [(i, j, k) for i, seq in enumerate(itertools.product(kinds, repeat=4)) for j, k in enumerate(seq)]
    e = spark.createDataFrame(rows, "p int, o int, k string")
    from codeloom.streaming.changes import fold

    want = {}
    for p, _, k in rows:
        want[p] = fold(want.get(p), k)
    for width in (1, 2, 9):
        got = {r.p: (r.change, r.events) for r in changes.merge_events(e, "p", ["o"], "k", F.floor(F.col("o") / width)).collect()}
        assert got == {p: (c, 4) for p, c in want.items()}


def test_shedding_and_repair(spark):
    e = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "p string, o int")
    got = changes.shed(e, "p", ["o"], 5, 3)
    assert {(r.p, r.o, r.rescan) for r in got.collect()} == {("a", 7, True), ("a", 8, True), ("a", 9, True), ("b", 1, False)}
    now = spark.createDataFrame([("w", "x", "1"), ("w", "y", None), ("v", "z", "1")], "ws string, path string, hash string")
    old = spark.createDataFrame([("w", "x", "1"), ("w", "y", "2"), ("w", "q", "3")], "ws string, path string, hash string")
    assert {(r.path, r.action) for r in changes.repair(now, old, spark.createDataFrame([("w",)], "ws string"), "ws").collect()} == {("y", "index"), ("q", "delete")}


def test_edits():
    assert context.edit("let quota = 1;\n", "let qouta = 1;", "x") == "x\n"
    with pytest.raises(ValueError):
        context.edit("abc", "something else entirely", "x")
    src = "def é():\n    pass\n"
    body = src.encode().index(b"    pass")
    end = len(src.encode()) - 1
    assert context.rewrite_span(src, 0, end, "    return 1", "replace_body", body, end) == "def é():\n    return 1\n"
    assert context.rewrite_span(src, 0, end, "def f():\n", "replace_signature", body, end) == "def f():\n    pass\n"
    assert context.rewrite_span("x\n  f()", 4, 7, "# doc", "add_doc") == "x\n  # doc\n  f()"
    assert context.rewrite_span("ab", 1, 2, "c", "insert_before") == "acb" and context.rewrite_span("ab", 0, 1, "c", "insert_after") == "acb"
    for bad in ("replace_body", "nothing"):
        with pytest.raises(ValueError):
            context.rewrite_span("ab", 0, 1, "c", bad)


def test_ignore_rules_and_text(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\nold/\n")
    for name in ("a.log", "keep.log", "old/x.py", "b.py"):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text("x = 1\n")
    (tmp_path / "c.py").write_bytes(b"\x50\x01\x00\x00")
    got = {r.path for r in sinks.scan(spark, str(tmp_path)).collect()}
    assert got == {"keep.log", "b.py"}
    with pytest.raises(ValueError):
        paths.walked(F.col("path"), [], "nothing")


def test_store_keeps_revisions_whole(spark, tmp_path):
    a, b = sinks.Store(spark, str(tmp_path)), sinks.Store(spark, str(tmp_path))
    t = spark.createDataFrame([("p", "w"), ("q", "w")], "path string, ws string")
    assert a.publish({"files": t}) == 1 and b.manifest()["revision"] == 1
    assert a.delete_files(spark.createDataFrame([("p",)], "file_path string")) == 2 and b.info() == {"files": 1}
    before = b.manifest
    b.manifest = lambda: {**before(), "revision": 1}  # a writer that started from the revision before
    with pytest.raises(RuntimeError):
        b.publish({"files": t})
    assert a.info() == {"files": 1}


def test_code_without_comments_and_strings(spark):
    rows = [(1, 'f("a // b") // c\n/* "x" */ g(\'#\')'), (2, "x = 1 # y\n#z\n\"\"\"doc 'q'\"\"\""), (3, None), (4, '"' + "a" * 100_000 + '" b')]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id int, t string").select("id", text.code_only(F.col("t")).alias("c")).collect()}
    assert got[1] == "f( )  \n  g( )" and got[2].split() == ["x", "=", "1"] and got[3] is None and got[4].strip() == "b"


def test_tests_are_assessed_by_their_calls(spark):
    body = "def test_x():\n    # assert nothing (\n    assert (f())\n"
    s = spark.createDataFrame([("a", "test_x", "function", "tests/a.py", body), ("b", "test_y", "function", "tests/a.py", "pass"), ("c", "helper", "function", "tests/a.py", body), ("d", "test_z", "function", "src/a.py", body), ("e", "test_w", "function", "tests/a.py", None)], "id string, name string, kind string, file_path string, code_context string")
    uses = spark.createDataFrame([("a", "assertEqual", "call", "python")] * 3 + [(None, "assert", "call", "python")], "containing_symbol_id string, name string, kind string, language string")
    got = {r.id: (r.assertions, r.tier, r.evidence) for r in analysis.assess_tests(s, uses).collect()}
    assert got == {"a": (3, "thorough", "calls"), "b": (0, "stub", "placeholder")}
    got = {r.id: (r.assertions, r.evidence) for r in analysis.assess_tests(s, uses.limit(0)).collect()}
    assert got["a"] == (1, "patterns")


def test_patterns_links_and_cards_of_nothing(spark):
    seen = spark.createDataFrame([("a.b", 2), ("c", 1)], "pattern string, n long")
    assert [r.pattern for r in catalog.pattern_ids(seen, "A.").collect()] == ["a.b"] and catalog.pattern_ids(seen, "q").count() == 2 and catalog.pattern_ids(seen.limit(0), "q").count() == 0
    linked = spark.createDataFrame([(1, '["t/a.py"]', None), (2, "broken", '["x"]'), (3, None, None)], "id int, linked_test_paths string, linked_tests string")
    assert {r.id for r in catalog.failing_links(linked, ["a.py"], ["x"]).collect()} == {1, 2} and {r.id for r in catalog.failing_links(linked, ["root/t/a.py"], []).collect()} == {1}
    s = spark.createDataFrame([], "name string, id string, kind string, file_path string, reference_score double")
    assert [r.card for r in catalog.story_cards(s, spark.createDataFrame([], "language string")).collect()] == ["most_referenced"]


def test_small_files_of_the_shared_folder(spark):
    write_bytes(spark, "t/one", b"\0\1")
    write_bytes(spark, "t/one", b"\0\1")
    assert read_bytes(spark, "t/one") == b"\0\1" and read_bytes(spark, "t/none") is None


def test_postings_give_what_a_scan_gives(spark):
    from codeloom.operators.postings import Postings
    from codeloom.operators.search import bm25, parse_query

    rows = [(f"k{i}", "rank quota" if i % 3 else "ledger", "quota " * (i % 5), "clash") for i in range(60)] + [("n", None, "", "clash")]
    docs = spark.createDataFrame(rows, "key string, title string, body string, term string")
    fields, asked = {"title": 4.0, "body": 1.0}, [parse_query(q) for q in ("rank quota", "ledger", "nothing", "")]
    plain = lambda df: sorted((r.query, r.key, round(r.score, 9), r.mode) for r in df.collect())
    index = Postings(spark, fields).build(docs)
    assert plain(index.search(asked)) == plain(bm25(docs, "key", fields, asked))
    new = docs.filter("key < 'k2'").withColumn("title", F.lit("ledger of ranks"))
    index.upsert(new)
    index.delete(docs.filter("key > 'k5'"))
    now = docs.join(new.select("key"), "key", "left_anti").unionByName(new).filter("key <= 'k5'")
    assert plain(index.search(asked)) == plain(bm25(now, "key", fields, asked))
    plan = index.search(asked[:1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1]
    assert Postings(spark, fields).build(docs.limit(0)).search(asked).count() == 0


def test_stream_debouncing_is_that_of_the_batch(spark, tmp_path):
    import datetime as dt

    from codeloom.streaming import changes as stream

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "M", t0 + dt.timedelta(milliseconds=m), i) for i, m in enumerate([0, 100, 950, 1050, 3000, 3900, 4950, 9000])] + [("b", "C", t0, 100)]
    events = spark.createDataFrame(rows, stream.EVENT_SCHEMA)
    want = sorted(r.seq for r in changes.debounce(events, "path", "ts", 1, ["seq"]).collect())
    for i in range(3):  # in several micro-batches
        events.filter(f"seq % 100 >= {i * 3} and seq % 100 < {i * 3 + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.run(stream.debounced(stream.read_events(spark, str(tmp_path / "in"), 1), 1), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint"), "append")
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_scopes_leave_no_tables(spark, tmp_path):
    from codeloom.plans.cut import Workspace, scope, shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(__import__("os").listdir(root))
    with scope():
        assert Workspace(spark, "scoped").cut(spark.range(3)).count() == 3
        assert set(__import__("os").listdir(root)) != before
    assert set(__import__("os").listdir(root)) == before
