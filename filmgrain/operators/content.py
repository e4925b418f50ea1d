"""Keyed tables: content dedupe, insert-if-absent, keep-latest and point lookups.

Hot keys (many copies of one content) are reduced by map-side aggregates before any
shuffle, so a key never gathers its copies in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_writers(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by ``order``."""
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def dedupe_ingest(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """First writer of every content key, or the row already stored, with ``reused``."""
    fresh = first_writers(incoming, key, order)
    old = existing.select(key, *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c != key], F.lit(True).alias("_known"))
    df = fresh.join(old, key, "left")
    kept = [F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in existing.columns else F.col(c)
            for c in fresh.columns if c != key]
    return df.select(key, *kept, F.coalesce("_known", F.lit(False)).alias("reused"))


def insert_ignore(incoming: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows to append: keys not stored yet, first incoming row each."""
    rest = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
    return first.join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of both tables."""
    both = existing.unionByName(changes)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def lookup(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns occur in ``keys``; large tables keep their own partitioning
    when the key list is small enough for the adaptive planner to broadcast."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def newest(df: DataFrame, key: str, at: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(key, "_r.*")
