"""Keyed merges of tables, as unions and aggregations; Parquet needs no MERGE for them.

All of them are idempotent: merging the same rows again changes nothing.  Ties
are broken by all columns, so the result does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _digest(df: DataFrame) -> Column:
    """Hash of all columns for ties; maps count as JSON."""
    return F.xxhash64(*(F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns))


def _one_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Upsert: the new row of a key replaces the old; among new rows the one last in ``order``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    ties = [F.desc_nulls_last(_digest(old))]
    by = [F.desc("_new"), *([F.desc_nulls_last(order)] if order else []), *ties]
    return _one_per_key(both, keys, by).drop("_new")


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Insert where absent: stored rows stay, of new rows the one first in ``order`` comes in."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    by = [*([F.asc_nulls_last(order)] if order else []), F.asc(_digest(new))]
    return old.unionByName(_one_per_key(fresh, keys, by))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of every key."""
    return _one_per_key(df, keys, order)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of every key that occurs in ``new`` are replaced together."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content registry upsert: everything is overwritten but created_at, which stays the earliest."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in ("content_id", "created_at")]
    order = F.struct(F.col("_new"), F.col("created_at"), F.xxhash64(*old.columns))
    out = both.groupBy("content_id").agg(F.min("created_at").alias("created_at"), F.max_by(F.struct(*rest), order).alias("r"))
    return out.select("content_id", "created_at", "r.*").select(*old.columns)


def with_defaults(metadata, defaults):
    """Map column ``metadata`` with the entries of ``defaults`` where a key is absent."""
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(F.coalesce(metadata, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(missing, F.coalesce(metadata, F.create_map().cast("map<string,string>")))
