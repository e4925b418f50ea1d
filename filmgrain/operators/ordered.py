"""Ordered operators that survive a key holding a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts each key in one task. The helpers here
partition by ``(key, chunk)``, where ``chunk`` never decreases along the order
(a time bucket, a frame number), and pass one small summary row per chunk from
chunk to chunk. The only window over a whole key then runs on those summaries.
Chunks that hold more than ``CHUNK_ROWS`` rows are cut finer first, so their
number grows with the rows and not only with the length of a clip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Order = Sequence[str]
# Rows of one chunk that a task sorts without harm, and the input below which no chunk is worth counting.
CHUNK_ROWS = 4_000_000
SMALL_BYTES = 64 << 20
# Bytes of stored input behind one task of a step that holds all its rows.
PART_BYTES = 4 << 20
# The same where a row of a small table grows into hundreds (``fan_out``).
FAN_BYTES = 1 << 20
# The planner takes rows without a file behind them for larger than this.
UNKNOWN_BYTES = 1 << 50


def clip_window():
    """All rows of one clip. Only for tables with a bounded number of rows per clip."""
    return Window.partitionBy("clip_id")


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small table over all shuffle partitions before each row grows into many.

    The adaptive planner sizes partitions by the rows it has seen, so without this a few
    megabytes of clips would be expanded into all their points by one task. The number is
    given, which keeps it from being merged again; it is a multiple of the usual one, as a
    repartition to the same number on the same keys is dropped as redundant. It grows with the
    input behind ``df``, so a task's share doesn't; rows whose size the planner doesn't know count
    as small. Later windows on these keys find the rows already in place.
    """
    n, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _input_bytes(df)
    return df.repartition(max(2 * n, -(-size // FAN_BYTES) if size < UNKNOWN_BYTES else 0), *keys)


def join_one(big: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join rows to a table with one row per key when a key may hold much of ``big``.

    The row of each key is listed once per salt and every big row takes one of them by its
    content, so a hot key is read by ``salts`` tasks. Where the planner measures ``one``
    as small it broadcasts it and the salt costs nothing.
    """
    rest = [c for c in big.columns if c not in keys]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _by_chunk(keys: Sequence[str]) -> list[str]:
    return [*keys, "_chunk"]


def _input_bytes(df: DataFrame) -> int:
    """What the planner knows of the size of everything ``df`` reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))


def parts_for(df: DataFrame) -> int | None:
    """Number of tasks for work on all rows of ``df``: it grows with the input, so a task's share doesn't. None for small inputs, which
    the planner may put together as it likes, and for rows whose size it doesn't know."""
    size = _input_bytes(df)
    if not SMALL_BYTES <= size < UNKNOWN_BYTES:
        return None
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over ``parts`` tasks (``parts_for``). The planner sizes tasks by packed bytes; rows that hold long lists grow a lot
    where they are unpacked, so their number is given and stays."""
    return df.repartition(parts, *keys) if parts else df


def _chunked(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column) -> DataFrame:
    """``df`` with ``_chunk``, which never decreases along the order.

    A chunk above ``CHUNK_ROWS`` is parted by the value range of its first order column that
    varies; a second round parts what one value or a crowded range still holds together. Large chunks
    are few (rows over ``CHUNK_ROWS`` at most), so the table of them is small and is measured as such.
    Small inputs keep the chunks they were given, with the same results.
    """
    df = df.withColumn("_chunk", chunk)
    if _input_bytes(df) < SMALL_BYTES:
        return df
    types = dict(df.dtypes)
    lead = []
    for c in order:
        if types[c] not in ("int", "bigint", "smallint", "tinyint", "double", "float", "timestamp", "date"):
            break
        lead.append((c, F.unix_date(c).cast("double") if types[c] == "date" else F.col(c).cast("double")))
    for _ in range(2):
        ends = []
        for i, (c, x) in enumerate(lead):
            held = F.count(c)
            varies = (F.min(c) != F.max(c)) | ((held > 0) & (held < F.count(F.lit(1))))
            ends += [F.min(x).alias(f"_low{i}"), F.max(x).alias(f"_high{i}"), F.coalesce(varies, F.lit(False)).alias(f"_varies{i}")]
        large = df.groupBy(*_by_chunk(keys)).agg(F.count(F.lit(1)).alias("_rows"), *ends).where(F.col("_rows") > CHUNK_ROWS)
        parts = F.ceil(F.col("_rows") / CHUNK_ROWS)
        cut = F.lit(0).cast("bigint")
        # A later column parts a chunk only where all earlier ones stand still. Nulls come first.
        for i, (c, x) in reversed(list(enumerate(lead))):
            low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
            share = F.least(F.floor((x - low) / F.when(high > low, high - low) * parts), parts - 1)
            share = F.when(high > low, share).when(F.col(c).isNotNull(), parts - 1)
            cut = F.when(F.col(f"_varies{i}"), F.coalesce(share, F.lit(0))).otherwise(cut)
        df = df.join(large, _by_chunk(keys), "left").withColumn("_part", F.when(F.col("_rows").isNotNull(), cut).otherwise(0))
        df = df.withColumn("_chunk", F.struct("_chunk", "_part")).drop("_part", "_rows", *(f"_{n}{i}" for n in ("low", "high", "varies") for i in range(len(lead))))
    return df


def with_row_number(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column, name: str = "rn",
                    total: str | None = None) -> DataFrame:
    """Zero-based position inside each key, optionally with the key's row count."""
    df = _chunked(df, keys, order, chunk)
    sizes = df.groupBy(*_by_chunk(keys)).agg(F.count(F.lit(1)).alias("_size"))
    run = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = sizes.select(
        *_by_chunk(keys),
        F.coalesce(F.sum("_size").over(run), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    inner = Window.partitionBy(*_by_chunk(keys)).orderBy(*order)
    out = df.withColumn("_local", F.row_number().over(inner)).join(sizes, _by_chunk(keys))
    out = out.withColumn(name, F.col("_before") + F.col("_local") - 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_chunk", "_before", "_local", "_total")


def with_previous(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column,
                  columns: Sequence[str], name: str = "prev") -> DataFrame:
    """Struct of ``columns`` of the row before, null on the first row of a key."""
    df = _chunked(df, keys, order, chunk)
    packed = F.struct(*columns)
    inner = Window.partitionBy(*_by_chunk(keys)).orderBy(*order)
    tails = df.groupBy(*_by_chunk(keys)).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    tails = tails.select(
        *_by_chunk(keys),
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"),
    )
    out = df.withColumn("_lag", F.lag(packed).over(inner)).join(tails, _by_chunk(keys))
    return out.withColumn(name, F.coalesce("_lag", "_carry")).drop("_chunk", "_lag", "_carry")


def with_next_marked(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column,
                     value: str, name: str) -> DataFrame:
    """First non-null ``value`` at or after each row (the forward as-of fill).

    The order is walked backwards so the frame only ever grows by one row.
    """
    df = _chunked(df, keys, order, chunk)
    back = [F.col(c).desc() for c in order]
    inner = Window.partitionBy(*_by_chunk(keys)).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.col(value).isNotNull(), F.struct(*order))
    heads = df.groupBy(*_by_chunk(keys)).agg(F.min_by(value, marked).alias("_head"))
    later = (
        Window.partitionBy(*keys).orderBy(F.col("_chunk").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = heads.select(
        *_by_chunk(keys), F.last("_head", ignorenulls=True).over(later).alias("_carry")
    )
    out = df.withColumn("_here", F.last(value, ignorenulls=True).over(inner)).join(heads, _by_chunk(keys))
    return out.withColumn(name, F.coalesce("_here", "_carry")).drop("_chunk", "_here", "_carry")


def with_neighbour_mean(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column,
                        value: str, reach: int, name: str, block: int = 4096) -> DataFrame:
    """Mean of up to ``reach`` rows either side, without the row itself.

    Rows are cut into blocks of equal size by position; the few rows near a block
    edge are copied into the neighbouring block so every frame is complete.
    """
    df = with_row_number(df, keys, order, chunk, "_pos")
    edge = [F.floor((F.col("_pos") + d) / block).cast("bigint") for d in (-reach, 0, reach)]
    df = df.withColumn("_home", edge[1]).withColumn("_block", F.explode(F.array_distinct(F.array(*edge))))
    w = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-reach, reach)
    own = F.col(value)
    others = F.count(F.lit(1)).over(w) - 1
    mean = F.when(others > 0, (F.sum(own).over(w) - own) / others)
    return df.withColumn(name, mean).where("_home = _block").drop("_pos", "_home", "_block")
