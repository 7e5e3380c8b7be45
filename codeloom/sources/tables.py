"""Reading the catalogue's tables, and the current row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a directory of them)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, key: str | list[str], columns: list[str], version: str = "last_indexed") -> DataFrame:
    """The row with the greatest ``version`` of each key, with ``columns``.

    One hash aggregation with partial combine: rows of a key that is repeated often are
    folded before the shuffle, so no key is too hot. A null version counts as the
    oldest; rows without a key (null) have no identity and are left out; of rows with equal
    version that differ, the one with the greatest values is taken, so the result is fixed.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in columns if c not in keys and c != version]
    alive = F.lit(True)
    for k in keys:
        alive = alive & F.col(k).isNotNull()
    newest = F.max(F.struct(F.col(version).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])).alias("__r")
    out = df.select(*keys, version, *rest).filter(alive).groupBy(*keys).agg(newest)
    return out.select(*keys, F.col("__r.v").alias(version), *[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(rest)])


def blank(c) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | (F.regexp_replace(c, r"[\s 　﻿]+", "") == "")
