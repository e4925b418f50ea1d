"""Dealing critique runs into shards that all hold the same mixture of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SHARDS = 40
SEED = "filmgrain"
ROW_OVERHEAD = 16


def _offsets(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``n`` per bucket to the rows before it and the rows of its whole key."""
    own = Window.partitionBy(*keys)
    return counts.withColumns({
        "before": F.sum("n").over(own.orderBy(order)) - F.col("n"), "total": F.sum("n").over(own)})


def deal_shards(critiques: DataFrame, shards: int = SHARDS, seed: str = SEED, buckets: int | None = None) -> DataFrame:
    """critique_run_id, size, text_crc32, law, shard, slot, grown_shard: every row in one shard.

    ``critiques``: critique_run_id, text, model_name; other columns are ignored. Rows of a model are
    ranked in a seeded shuffle (by a digest of seed and id), all rows are sorted by the
    fractional rank ``(2 * rank - 1) / (2 * rows of the model)``, and the order is cut into
    ``shards`` runs whose row counts differ by one at most (law ``rows``). Every run so holds
    every model in proportion, give or take one row and its share of the number of models.

    Ranks are exact at any size without a task holding a whole model: rows are ranked inside
    buckets of the digest, then inside buckets of the fractional rank, and small bucket
    counts give what stands before a bucket. The bucket number changes no result. A model
    with most of the rows is spread over all buckets.

    A null text has size 16 and the checksum of no bytes. Null models are a model of their own.
    Rows that share an id are dealt one by one; rows equal in all used columns may trade
    places. ``grown_shard`` is null under this law. An empty table gives no rows.
    """
    spark = critiques.sparkSession
    buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    # The first 60 bits of the digest, as a number.
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("critique_run_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    rows = critiques.select(
        "critique_run_id", F.coalesce(F.concat(F.lit("m"), "model_name"), F.lit("")).alias("model"), (F.octet_length(text) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), digest.alias("shuffle"))
    ties = ["shuffle", "critique_run_id", "text_crc32", "size"]

    rows = rows.withColumn("part", F.floor(F.col("shuffle") / F.lit(float(1 << 60)) * buckets).cast("int"))
    before = _offsets(rows.groupBy("model", "part").agg(F.count(F.lit(1)).alias("n")), ["model"], "part")
    ranked = rows.join(before.drop("n"), ["model", "part"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("model", "part").orderBy(*ties)))
    share = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("total")).cast("double")
    placed = ranked.withColumn("share", share).drop("before", "total", "part").withColumn(
        "part", F.least(F.floor(F.col("share") * buckets), F.lit(buckets - 1)).cast("int"))

    # Both sides count with the same plan, so the second pass reads the first one's shuffle.
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ends = _offsets(counts, [], "part").drop("n")
    order = Window.partitionBy("part").orderBy("share", "model", *ties)
    at = placed.join(ends, "part").withColumn("at", F.col("before") + F.row_number().over(order) - 1)
    shard = F.expr(f"at * {shards} div total")
    return at.withColumn("shard", shard.cast("int")).select(
        "critique_run_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("at") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
