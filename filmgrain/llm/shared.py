"""Shared scratch, cut lineage and connected groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from filmgrain.session import work_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so later jobs survive lost executors
    and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """At most ``size`` rows, those with the smallest hashes of ``columns``. Rows are thinned by their hash
    before they are sorted, so what tasks send along doesn't grow with their number."""
    place = F.xxhash64(*columns)
    total = df.count()
    if total > 2 * size:
        df = df.where(F.pmod(place, F.lit(1 << 31)) < int((1 << 31) * 1.5 * size / total))
    return df.orderBy(F.pmod(place, F.lit(1 << 31)), place, *columns).limit(size)


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` can reach.

    Every round a node points at the smallest root among its neighbours' and then at its
    root's root, so long chains halve. Each round is stored; links stay in the cluster and
    only a count of changes comes back. A hub's links are combined before the shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(both.union(both.select("other", "node")).where("node <> other").distinct())
    roots = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    for _ in range(rounds):
        near = both.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("seen"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "seen").alias("best"))
        # The old root is told too, so a whole tree moves when one of its members meets another tree.
        told = step.where("best < root").groupBy(F.col("root").alias("node")).agg(F.min("best").alias("told"))
        # Stored, as all members of a group read their root's row: the skew join may split what comes straight from an exchange.
        moved = stored(step.join(told, "node", "left").select("node", "root", F.least("best", F.coalesce("told", "best")).alias("best")))
        up = moved.select(F.col("node").alias("best"), F.col("best").alias("above"))
        moved = stored(moved.join(up, "best", "left").select(
            "node", F.least("best", F.coalesce("above", "best")).alias("root"), (F.least("best", F.coalesce("above", "best")) < F.col("root")).alias("changed")))
        roots = moved.select("node", "root")
        if not moved.where("changed").limit(1).count():
            return roots
    raise RuntimeError(f"links did not settle in {rounds} rounds")
