"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import current_rows


def canonical_hex(c: Column) -> Column:
    """A hexadecimal number in one notation: lower case, no ``0x``, no outer space, no leading zeros.

    Null and blank (not read) stay null.
    """
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(0x)?0*", "")
    return F.when(F.length(F.trim(c)) > 0, F.when(bare == "", F.lit("0")).otherwise(bare))


def row_hash(*columns: Column) -> Column:
    """A 256-bit hash of canonical values that tells null from every value and keeps fields apart."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def snapshot_changes(df: DataFrame, key: str, revision: str, compare: dict[str, Column], keep: list[str], version: str = "last_indexed") -> DataFrame:
    """The records added, deleted and modified from each revision to the next one that there is.

    A full outer join on (step, key) of each revision's rows with those of the revision
    before, comparing canonical hashes of ``compare``: a missing side gives
    additions and deletions, unequal hashes modifications. All steps run in one join, whose key is nearly unique, so
    no task gets more than its share.

    Columns: revision (the later one), key, ``keep`` (of the later side, else of the earlier one), change_kind, old_hash, new_hash
    (the canonical values, joined by ``|`` where there are several).

    Defined cases: of repeated rows of a revision and key the greatest ``version`` counts;
    rows with null revision or key are left out; null equals null and differs from every value; the first
    revision and a table with fewer than two revisions give no rows; revisions may have gaps.
    """
    names = list(compare)
    inputs = df.select(F.col(revision).alias("revision"), F.col(key).alias("key"), F.col(version).alias("version"), *[F.col(k).alias(f"keep_{k}") for k in keep], *[e.cast("string").alias(f"cmp_{n}") for n, e in compare.items()])
    rows = current_rows(inputs, ["revision", "key"], [f"keep_{k}" for k in keep] + [f"cmp_{n}" for n in names], "version")
    steps = inputs.select("revision").filter(F.col("revision").isNotNull()).distinct()
    steps = steps.select("revision", F.row_number().over(Window.orderBy("revision")).alias("step"))  # one row per revision
    shown = F.concat_ws("|", *[F.col(f"cmp_{n}") for n in names]) if len(names) > 1 else F.col(f"cmp_{names[0]}")
    rows = rows.join(steps, "revision").select("step", "key", "revision", *[f"keep_{k}" for k in keep], row_hash(*[F.col(f"cmp_{n}") for n in names]).alias("h"), shown.alias("shown"))
    later = rows.filter(F.col("step") > 1).alias("b")
    earlier = rows.withColumn("step", F.col("step") + 1).alias("a")
    joined = later.join(earlier, (F.col("a.step") == F.col("b.step")) & (F.col("a.key") == F.col("b.key")), "full_outer")
    kind = F.when(F.col("a.key").isNull(), "added").when(F.col("b.key").isNull(), "deleted").when(F.col("a.h") != F.col("b.h"), "modified")
    changed = joined.select(F.coalesce(F.col("b.step"), F.col("a.step")).alias("step"), F.coalesce(F.col("b.key"), F.col("a.key")).alias(key), *[F.coalesce(F.col(f"b.keep_{k}"), F.col(f"a.keep_{k}")).alias(k) for k in keep], kind.alias("change_kind"), F.col("a.shown").alias("old_hash"), F.col("b.shown").alias("new_hash")).filter(F.col("change_kind").isNotNull())
    return changed.join(steps, "step").select("revision", *keep, key, "change_kind", "old_hash", "new_hash")


def file_changes(snapshots: DataFrame) -> DataFrame:
    """:func:`snapshot_changes` of the file snapshots."""
    return snapshot_changes(snapshots, "file_path", "revision", {"hash": canonical_hex(F.col("hash"))}, ["workspace_id"])


def change_log_audit(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """How a change log that was kept beside the snapshots agrees with them, per revision.

    Columns revision, change_kind (of the snapshots, or of the log where they have none), verdict (agrees,
    other_kind, not_logged, not_so) and n. Repeated log rows count once; log rows without
    revision or path are left out; where a path is logged twice with different kinds, each kind is judged.
    """
    true = file_changes(snapshots).select(F.col("revision").alias("r1"), F.col("file_path").alias("p1"), F.col("change_kind").alias("k1"))
    said = log.select(F.col("revision").alias("r2"), F.col("file_path").alias("p2"), F.col("change_kind").alias("k2")).filter(F.col("r2").isNotNull() & F.col("p2").isNotNull()).distinct()
    both = true.join(said, (F.col("r1") == F.col("r2")) & (F.col("p1") == F.col("p2")), "full_outer")
    verdict = F.when(F.col("p2").isNull(), "not_logged").when(F.col("p1").isNull(), "not_so").when(F.col("k1").eqNullSafe(F.col("k2")), "agrees").otherwise("other_kind")
    return both.groupBy(F.coalesce("r1", "r2").alias("revision"), F.coalesce("k1", "k2").alias("change_kind"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
