from pyspark.sql import functions as F

from codeloom.operators.snapshots import canonical_hex, change_log_audit, file_changes

SCHEMA = "revision long, workspace_id string, file_path string, hash string, last_indexed long, key string, step int"


def _changes(spark, data):
    df = spark.createDataFrame([(*r, None, None) for r in data], SCHEMA)
    return sorted((r.revision, r.file_path, r.change_kind) for r in file_changes(df).collect())


def test_added_deleted_modified(spark):
    data = [(3, "w", "same", "ab", 1), (7, "w", "same", "AB", 2), (3, "w", "gone", "1", 1), (7, "w", "new", "2", 2), (3, "w", "mod", "3", 1), (7, "w", "mod", "4", 2)]
    assert _changes(spark, data) == [(7, "gone", "deleted"), (7, "mod", "modified"), (7, "new", "added")]


def test_nulls_notations_and_gaps(spark):
    data = [(1, "w", "a", None, 1), (2, "w", "a", None, 1), (9, "w", "a", "0", 1), (1, "w", "b", "0x0F", 1), (2, "w", "b", " f ", 1), (9, "w", "b", "00f", 1)]
    assert _changes(spark, data) == [(9, "a", "modified")]


def test_repeated_and_outdated_rows(spark):
    data = [(1, "w", "a", "1", 5), (1, "w", "a", "9", 4), (1, "w", "a", "1", 5), (2, "w", "a", "1", 6), (2, None, None, "1", 6), (None, "w", "a", "1", 6)]
    assert _changes(spark, data) == []


def test_one_or_no_revision(spark):
    assert _changes(spark, [(1, "w", "a", "1", 1)]) == []
    assert _changes(spark, []) == []


def test_a_file_that_comes_back(spark):
    assert _changes(spark, [(1, "w", "a", "1", 1), (2, "w", "b", "1", 1), (3, "w", "a", "1", 1), (3, "w", "b", "1", 1)]) == [(2, "a", "deleted"), (2, "b", "added"), (3, "a", "added")]


def test_canonical_notation(spark):
    got = spark.createDataFrame([("0xAb",), ("ab",), ("000",), ("",), (" ",), (None,)], "h string").select(canonical_hex(F.col("h"))).collect()
    assert [r[0] for r in got] == ["ab", "ab", "0", None, None, None]


def test_audit_of_the_log(spark):
    snaps = spark.createDataFrame([(1, "w", "a", "1", 1, None, None), (2, "w", "b", "1", 1, None, None)], SCHEMA)
    log = spark.createDataFrame([(2, "a", "deleted"), (2, "a", "deleted"), (2, "b", "modified"), (2, "c", "added"), (2, None, "added")], "revision long, file_path string, change_kind string")
    got = {(r.change_kind, r.verdict): r.n for r in change_log_audit(snaps, log).collect()}
    assert got == {("deleted", "agrees"): 1, ("added", "other_kind"): 1, ("added", "not_so"): 1}
