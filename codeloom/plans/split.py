"""Ranks and prefix sums within groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.spread import stored_bytes

#: Buckets that a group is split into at least, and the stored bytes that one bucket of a group with all rows gets at most.
BUCKETS, BUCKET_BYTES = 64, 16 << 20


def split_prefix(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come earlier.

    The order within a group is by (bucket, ``order``), bucket being a hash of ``order``
    and the group: fixed, though not alphabetical. No task holds a whole group: rows are sorted within
    (group, bucket), and only one row per bucket meets the others of its group.
    ``order`` must be unique within the group. Nulls in ``group`` form a group. The number of buckets grows with the data, unless it is given.
    """
    buckets = buckets or max(BUCKETS, -(-stored_bytes(df) // BUCKET_BYTES))
    b, v = f"__b_{out}", f"__v_{out}"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*group, *order), F.lit(buckets)).cast("int")).withColumn(v, value)
    inner = Window.partitionBy(*group, b).orderBy(*order)
    rows = rows.withColumn(out, F.coalesce(F.sum(v).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = [f"__k{i}" for i in range(len(group))]
    sums = rows.groupBy(*group, b).agg(F.sum(v).alias("__s"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(b).alias("__kb"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    on = (rows[b] == sums["__kb"])
    for g, k in zip(group, keys):
        on = on & rows[g].eqNullSafe(sums[k])
    return rows.join(sums, on, "left").withColumn(out, F.col(out) + F.col("__before")).drop(*keys, "__kb", "__before", b, v)
