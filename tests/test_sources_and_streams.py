import datetime as dt

from codeloom.sources.sinks import Store, keep_known, scan
from codeloom.sources.tables import current_rows
from codeloom.streaming import changes as stream


def test_scan_skips_what_is_not_source(spark, tmp_path):
    for name, data in {"a/x.py": b"print(1)\n", "node_modules/y.js": b"1", "b/z.min.js": b"1", "b/bin.dat": b"\x00\x01", "b/big.txt": b"x" * 2000}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: r.language for r in scan(spark, f"file://{tmp_path}", max_bytes=1000).collect()}
    assert got == {"a/x.py": "python"}


def test_store_revisions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    f = lambda *r: spark.createDataFrame(list(r), "path string, v int")
    assert store.publish({"files": f(("a", 1), ("b", 1))}, "fresh") == 1
    assert store.apply("files", f(("b", 2), ("c", 2)), f(("a", 0)), "path") == 2
    assert sorted(map(tuple, store.read("files").collect())) == [("b", 2), ("c", 2)] and store.info() == {"files": 2}
    store.wipe()
    assert store.info() == {"files": 0}


def test_keep_known(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "gone"), ("3", None)], "id string, ref string")
    keys = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.ref for r in keep_known(df, "ref", keys).select("id", "ref").collect()} == {"1": "a", "2": None, "3": None}


def test_current_rows_ties(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 2, "z"), ("n", None, "q"), (None, 9, "w")], "id string, last_indexed long, v string")
    assert {(r.id, r.v) for r in current_rows(df, "id", ["v"]).collect()} == {("k", "z"), ("n", "q")}


def test_stream_merges_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [("p", "C", t, 1), ("p", "M", t, 2), ("q", "C", t, 1), ("q", "D", t, 2)]
    spark.createDataFrame(events, stream.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "true")
    out = {}
    q = stream.merged(stream.read_events(spark, f"{tmp_path}/in"))
    stream.run(q, lambda df, _: out.update({r.path: (r.change, r.events) for r in df.collect()}), f"{tmp_path}/cp")
    assert out == {"p": ("C", 2), "q": ("D", 2)}


def test_stream_debounce(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("p", "M", t, 1), ("p", "M", t, 2), ("p", "M", t + dt.timedelta(seconds=5), 3)], stream.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    n = []
    stream.run(stream.debounced(stream.read_events(spark, f"{tmp_path}/in")), lambda df, _: n.append(df.count()), f"{tmp_path}/cp", "append")
    assert sum(n) == 2
