"""Per-key picks, merges and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the values of a one-row table, such as a whole-table maximum, beside every row.

    The limit proves the broadcast holds one row; no rows are multiplied.
    """
    return df.crossJoin(F.broadcast(row.limit(1)))


def pick_per_key(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First n rows per key in `order`.

    Spark limits rows per key before the shuffle for this shape, so a key that holds
    much of the table sends n rows per task.
    """
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def latest_values(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Values of the greatest row per key by map-side aggregation."""
    best = F.max_by(F.struct(*values), F.struct(*order, *values)).alias("__v")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"__v.{v}").alias(v) for v in values])


def earliest_values(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*values), F.struct(*order, *values)).alias("__v")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"__v.{v}").alias(v) for v in values])


def union_first_source(sources: list[DataFrame], key: list[str], tie: list[str]) -> DataFrame:
    """Union with provenance; for a key held by several sources the earliest listed wins."""
    tagged = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for other in tagged[1:]:
        both = both.unionByName(other)
    values = [c for c in sources[0].columns if c not in key]
    return earliest_values(both, key, ["__src", *tie], values)


def upsert_latest(target: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Target with updates applied; per key the row with the greatest `order` stays."""
    values = [c for c in target.columns if c not in key]
    return latest_values(target.unionByName(updates), key, order, values)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first per key by arrival, minus keys the target holds."""
    values = [c for c in rows.columns if c not in key]
    return earliest_values(rows, key, order, values).join(target.select(*key), key, "left_anti")


def delete_keys(target: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return target.join(gone.select(*key), key, "left_anti")


def mirror_changes(target: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Keys with the change that makes target equal wanted: `insert` or `delete`."""
    side = F.struct(F.max("__t").alias("t"), F.max("__w").alias("w"))
    both = (
        target.select(*key, F.lit(1).alias("__t"), F.lit(0).alias("__w"))
        .unionByName(wanted.select(*key, F.lit(0).alias("__t"), F.lit(1).alias("__w")))
        .groupBy(*key)
        .agg(side.alias("s"))
    )
    change = F.when((F.col("s.w") == 1) & (F.col("s.t") == 0), "insert").when(
        (F.col("s.w") == 0) & (F.col("s.t") == 1), "delete"
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull()).drop("s")


def refresh_due(
    keys: DataFrame, cache: DataFrame, key: str, now: Column, days: int, needed: str, version: int
) -> DataFrame:
    """Keys to fetch again: absent, old, lacking a cell, or written by an older parser."""
    joined = keys.select(key).distinct().join(cache, key, "left")
    why = (
        F.when(F.col("fetched_at").isNull(), "absent")
        .when(F.datediff(now, F.col("fetched_at")) >= days, "old")
        .when(~F.map_contains_key("cells", needed), "field missing")
        .when(F.coalesce(F.col("parser_version"), F.lit(0)) < version, "older parser")
    )
    return joined.select(key, why.alias("why")).where(F.col("why").isNotNull())
