from conftest import rows

from codeloom.operators.orphans import CATALOGUE, Reference, missing_keys, orphan_references, orphan_report

JAN, FEB, MAR = 1704067200, 1706745600, 1709251200  # first seconds of months of 2024
REFS = (Reference("child", "ref", "parent"),)


def _tables(spark, child, parent):
    return {"child": spark.createDataFrame(child, "id string, ref string, last_indexed long, parent string, __p string"), "parent": spark.createDataFrame(parent, "id string, last_indexed long, ref string")}


def test_missing_later_and_present(spark):
    t = _tables(spark, [("a", "x", JAN, None, None), ("b", "y", FEB, None, None), ("c", "gone", FEB, "", ""), ("d", None, FEB, None, None), ("e", "  ", FEB, None, None), ("f", "X", FEB, None, None)], [("x", FEB, None), ("y", FEB + 5, None), ("y", MAR, None)])
    got = {(r.row_id, r.cause) for r in orphan_references(t, REFS).collect()}
    assert got == {("a", "later"), ("c", "missing"), ("f", "missing")}  # b: same month; keys compare as stored


def test_only_the_current_row_of_a_child_counts(spark):
    t = _tables(spark, [("a", "gone", JAN, None, None), ("a", "x", FEB, None, None), ("a", "x", FEB, None, None)], [("x", JAN, None)])
    assert rows(orphan_references(t, REFS)) == []


def test_null_ids_and_times(spark):
    t = _tables(spark, [(None, "gone", JAN, None, None), ("a", "x", None, None, None), ("b", "gone", None, None, None), ("c", "y", JAN, None, None)], [("x", MAR, None), ("y", None, None), (None, JAN, None)])
    assert {(r.row_id, r.cause, r.month) for r in orphan_references(t, REFS).collect()} == {("b", "missing", None)}


def test_empty_tables(spark):
    assert rows(orphan_references(_tables(spark, [], [("x", JAN, None)]), REFS)) == []
    assert len(rows(orphan_references(_tables(spark, [("a", "x", JAN, None, None)], []), REFS))) == 1
    assert rows(missing_keys(_tables(spark, [], []), REFS)) == []


def test_report_counts_hot_keys(spark):
    child = [(f"c{i}", "gone", JAN, None, None) for i in range(500)] + [("ok", "x", JAN, None, None)]
    got = orphan_report(_tables(spark, child, [("x", JAN, None)]), REFS).collect()
    assert [(r.month, r.refs, r.missing, r.later) for r in got] == [("2024-01", 501, 500, 0)]


def test_catalogue_names_four_references():
    assert {(r.child, r.field) for r in CATALOGUE} == {("symbols", "file_path"), ("source_regions", "containing_symbol_id"), ("type_arguments", "target_symbol_id"), ("type_arguments", "identifier_id")}
