import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import hierarchy as h


def _frame(spark, pairs):
    return spark.createDataFrame([(i, p, n) for n, (i, p) in enumerate(pairs)], "id string, parent string, last_indexed long")


def _brute(pairs):
    parent = {i: p for i, p in pairs if i is not None}
    out = {}
    for i in parent:
        chain, now = [i], i
        while (up := parent.get(now)) and up.strip() and up in parent and up not in chain:
            chain.append(up)
            now = up
        up = parent.get(now)
        if up and up in parent and up in chain:
            ring = chain[chain.index(up):]
            out[i] = (min(ring), -1)
        else:
            out[i] = (chain[-1], len(chain) - 1)
    return out


def _sets(spark, pairs, **kw):
    return h.nested_sets(spark, h.forest({"t": (_frame(spark, pairs), "id", "parent")}), **kw)


CASES = {
    "plain": [("r", None), ("a", "r"), ("b", "r"), ("c", "a")],
    "blank and missing parents": [("r", " "), ("s", "nowhere"), ("a", "s")],
    "self loop": [("x", "x"), ("y", "x")],
    "cycle with a tail": [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("u", "t"), ("r", None)],
    "deep": [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 60)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_walks(spark, name):
    got = {h_.node[2:]: (h_.root[2:], h_.depth) for h_ in _sets(spark, CASES[name]).collect()}
    assert got == _brute(CASES[name])


def test_a_long_chain_takes_few_rounds(spark):
    n = 20_000
    nodes = spark.range(n).selectExpr("'t' AS tree", "concat('t:', lpad(id, 7, '0')) AS node", "IF(id = 0, null, concat('t:', lpad(id - 1, 7, '0'))) AS parent")
    rows = h.nested_sets(spark, nodes).agg(F.count("*"), F.max("depth"), F.count_if(F.col("size") == n - F.col("depth")), F.count_if(F.col("lft") == F.col("depth"))).first()
    assert tuple(rows) == (n, n - 1, n, n)


def test_cycles_with_deep_trees_below(spark):
    pairs = [(f"c{i:03d}", f"c{(i + 1) % 100:03d}") for i in range(100)] + [("d0", "c050")] + [(f"d{i}", f"d{i - 1}") for i in range(1, 40)] + [("x", "x"), ("r", None), ("s", "r")]
    rows = {r.node[2:]: r for r in _sets(spark, pairs).collect()}
    assert {k: (r.root[2:], r.depth) for k, r in rows.items()} == _brute(pairs)
    assert [rows[f"d{i}"].size for i in (0, 39)] == [40, 1] and rows["c000"].size is None and rows["r"].size == 2
    assert sum(r.cyclic for r in rows.values()) == 101


@pytest.mark.parametrize("block", [4096, 3])
def test_all_descendants_against_walks(spark, monkeypatch, block):
    monkeypatch.setattr(h, "BLOCK", block)
    rng = random.Random(5)
    pairs = [("n0", None)] + [(f"n{i}", f"n{rng.randrange(i)}" if rng.random() < 0.9 else None) for i in range(1, 120)] + CASES["cycle with a tail"]
    parent = dict(pairs)
    looped = {"a", "b", "c", "t", "u"}
    got = sorted((r.tree, r.ancestor[2:], r.node[2:]) for r in h.all_descendants(_sets(spark, pairs)).collect())
    assert got == sorted(("t", i, j) for i in parent for j in parent if i != j and not looped & {i, j} and _has(parent, j, i))
    assert h.all_descendants(_sets(spark, [("r", None)])).count() == 0


def test_p3_queries_give_ranges_and_descendants(spark):
    from codeloom.queries import integrity as q

    d = "/root/testdata/sf0.001"
    rows = q.p3_ranges(spark, d).filter("depth >= 0").collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r.node_table, r.root_id), []).append(r)
    want = sorted((a.node_table, a.node_id, b.node_id) for group in by.values() for a in group for b in group if a.lft < b.lft <= a.rgt)
    assert want and want == sorted(map(tuple, q.p3_descendants(spark, d).collect()))


def test_ranges_nest_and_sizes_add_up(spark):
    rng = random.Random(3)
    pairs = [("n0", None)] + [(f"n{i}", f"n{rng.randrange(i)}" if rng.random() < 0.95 else None) for i in range(1, 300)]
    parent = dict(pairs)
    rows = {r.node[2:]: r for r in _sets(spark, pairs).collect()}
    for i, r in rows.items():
        below = [j for j in rows if j != i and _has(parent, j, i)]
        assert r.size == len(below) + 1 and r.rgt - r.lft + 1 == r.size
        ranged = [j for j, q in rows.items() if q.root == r.root and r.lft < q.lft <= r.rgt]
        assert sorted(below) == sorted(ranged)


def _has(parent, node, above):
    while (node := parent.get(node)) is not None:
        if node == above:
            return True
    return False


def test_paths_and_descendants(spark):
    sets = _sets(spark, CASES["plain"])
    paths = {r.node: r.path for r in h.with_paths(spark, sets).collect()}
    assert paths == {"t:r": "r", "t:a": "r/a", "t:b": "r/b", "t:c": "r/a/c"}
    wanted = spark.createDataFrame([("t:a",)], "node string")
    assert [r.node for r in h.descendants(sets, wanted).collect()] == ["t:c"]


def test_current_rows_nulls_and_empty(spark):
    old_and_new = spark.createDataFrame([("a", "old", 1), ("a", None, 2), ("old", None, 1), (None, "a", 1)], "id string, parent string, last_indexed long")
    got = {r.node: r.depth for r in h.nested_sets(spark, h.forest({"t": (old_and_new, "id", "parent")})).collect()}
    assert got == {"t:a": 0, "t:old": 0}
    assert h.nested_sets(spark, h.forest({"t": (old_and_new.limit(0), "id", "parent")})).count() == 0


def test_one_parent_with_many_children(spark):
    pairs = [("r", None)] + [(f"c{i}", "r") for i in range(2000)]
    rows = _sets(spark, pairs).collect()
    assert sorted(r.lft for r in rows) == list(range(2001))
