"""Line dedup of critique texts: exact reference counts behind sharded cuckoo filters."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from filmgrain.llm.batches import free_name, passed_on, mix, slices
from filmgrain.llm.shared import stored

MIN_CRITIQUES = 10
SHARD_KEYS = 200_000
SALTS = 16
SLOTS = 4
KICKS = 200
WHITE = b" \t\n\x0b\x0c\r"
COUNTS = "key binary, n_critiques bigint"
FILTERS = "shard int, filter binary"


# --- keys -------------------------------------------------------------------
def _key(line: bytes) -> bytes:
    """16-byte digest of the stripped, A-Z lower-cased line; empty for a blank line."""
    plain = line.strip(WHITE).lower()
    return hashlib.blake2b(plain, digest_size=16).digest() if plain else b""


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def count_lines(critiques: DataFrame) -> DataFrame:
    """key, n_critiques: in how many critiques each line stands (a critique counts once per line)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Counter(k for t in batch.column("text").to_pylist() for k in {_key(x) for x in _lines(t)} if k)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "n_critiques"])

    return critiques.select("text").mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("n_critiques").alias("n_critiques"))


def changed_counts(counts: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The reference counts after documents came or went. Deleting what was added gives the
    counts there were before; a key without references leaves the table."""
    parts = counts.select("key", "n_critiques")
    if added is not None:
        parts = parts.union(count_lines(added))
    if deleted is not None:
        parts = parts.union(count_lines(deleted).select("key", -F.col("n_critiques")))
    return parts.groupBy("key").agg(F.sum("n_critiques").alias("n_critiques")).where("n_critiques > 0")


# --- cuckoo filters ---------------------------------------------------------
def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first bucket, second bucket) of n x 16 key bytes; fingerprints are never 0."""
    words = np.ascontiguousarray(keys).view(np.uint64)
    mark = (words[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
    mark[mark == 0] = 1
    first = (words[:, 1] & np.uint64(buckets - 1)).astype(np.int64)
    return mark, first, first ^ _step(mark, buckets)


def _step(mark: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mark.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two buckets a key, with a stash for keys that
    find no place, so an insertion never fails and a deletion is exact for inserted keys."""

    def __init__(self, keys: int = 0, data: bytes | None = None):
        if data is None:
            self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.7))))), SLOTS), np.uint16)
            self.stash: Counter = Counter()
        else:
            buckets = int.from_bytes(data[:8], "little")
            size = buckets * SLOTS * 2
            self.table = np.frombuffer(data[8:8 + size], np.uint16).reshape(buckets, SLOTS).copy()
            self.stash = Counter(map(tuple, np.frombuffer(data[8 + size:], np.int64).reshape(-1, 2).tolist()))

    def to_bytes(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + np.array([*self.stash.elements()], np.int64).tobytes()

    def _low(self, mark: int, a: int, b: int) -> tuple[int, int]:
        return int(mark), int(min(a, b))

    def add(self, keys: np.ndarray) -> None:
        for mark, a, b in zip(*_places(keys, len(self.table))):
            self._add(mark, int(a), int(b))

    def _add(self, mark: np.uint16, a: int, b: int) -> None:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        at = a
        for kick in range(KICKS):
            slot = (kick + int(mark)) % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(_step(np.array([mark]), len(self.table))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        self.stash[self._low(mark, at, at ^ int(_step(np.array([mark]), len(self.table))[0]))] += 1

    def discard(self, keys: np.ndarray) -> None:
        """Takes out keys that were added before."""
        for mark, a, b in zip(*_places(keys, len(self.table))):
            for at in (int(a), int(b)):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                self.stash[self._low(mark, a, b)] -= 1
                self.stash += Counter()

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every added key, and for about one in 8,000 others."""
        mark, a, b = _places(keys, len(self.table))
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        if self.stash:
            found |= np.fromiter((self._low(*x) in self.stash for x in zip(mark, a, b)), bool, len(mark))
        return found


def _matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def _listed(counts: DataFrame, min_critiques: int) -> DataFrame:
    return counts.where(F.col("n_critiques") >= min_critiques)


def build_filters(counts: DataFrame, shards: int, min_critiques: int = MIN_CRITIQUES) -> DataFrame:
    """shard, filter: one cuckoo filter per shard over the keys that ``min_critiques`` or more hold."""
    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        made = CuckooFilter(len(keys))
        made.add(_matrix(keys))
        return pa.table({"shard": group.column("shard").slice(0, 1), "filter": pa.array([made.to_bytes()], pa.binary())})

    return _listed(counts, min_critiques).select(shard_of(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInArrow(run, FILTERS)


def changed_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_critiques: int = MIN_CRITIQUES) -> DataFrame:
    """The filters after a change of the counts: keys that reached the bound are added, keys
    that fell below it are deleted; the rest of a filter stays as it is."""
    was = _listed(before, min_critiques).select("key", F.lit(1).alias("was"))
    now = _listed(after, min_critiques).select("key", F.lit(1).alias("now"))
    moved = was.join(now, "key", "full").where("was is null or now is null").select(
        shard_of(F.col("key"), shards).alias("shard"), "key", F.col("now").isNotNull().alias("add"))

    def run(old: pa.Table, change: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else change).column("shard").slice(0, 1)
        keys, add = change.column("key").to_pylist(), change.column("add").to_pylist()
        made = CuckooFilter(data=old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(len(keys))
        for fn, want in ((made.discard, False), (made.add, True)):
            if some := [k for k, a in zip(keys, add) if a is want]:
                fn(_matrix(some))
        return pa.table({"shard": shard, "filter": pa.array([made.to_bytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(run, FILTERS)


# --- cleaning ---------------------------------------------------------------
def _candidates(critiques: DataFrame, filters: DataFrame, shards: int, salts: int) -> DataFrame:
    """critique_run_id, key: lines that a filter lets through.

    Lines go to their shard's filter; a shard is dealt to ``salts`` groups, so a line in a
    third of all critiques fills no single task. The filter row comes first in each group and
    lines stream past it.
    """
    kind = critiques.schema["critique_run_id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[k for k in {_key(x) for x in _lines(t)} if k] for t in batch.column("text").to_pylist()]
            ids = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("critique_run_id").take(pa.array(ids)), pa.array([k for f in found for k in f], pa.binary())], ["critique_run_id", "key"])

    lines = critiques.select("critique_run_id", "text").mapInArrow(keys, f"critique_run_id {kind}, key binary").select(
        shard_of(F.col("key"), shards).alias("shard"), F.pmod(F.xxhash64("critique_run_id"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(1).alias("part"), "critique_run_id", "key")
    heads = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("part"),
                           F.lit(None).cast(kind).alias("critique_run_id"), F.col("filter").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = None, None
        for batch in batches:
            shard, salt, part = (batch.column(c).to_numpy() for c in ("shard", "salt", "part"))
            place = shard.astype(np.int64) << 32 | salt
            cuts = np.flatnonzero(np.diff(place * 2 + part)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                rows = batch.slice(a, b - a)
                if part[a] == 0:
                    group, now = place[a], CuckooFilter(data=rows.column("key")[0].as_py())
                elif group == place[a]:
                    found = now.holds(_matrix(rows.column("key").to_pylist()))
                    yield rows.select(["critique_run_id", "key"]).filter(pa.array(found))

    dealt = heads.union(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "part")
    return dealt.mapInArrow(run, f"critique_run_id {kind}, key binary")


def drop_common_lines(critiques: DataFrame, min_critiques: int = MIN_CRITIQUES, counts: DataFrame | None = None,
                      filters: DataFrame | None = None, shards: int | None = None, salts: int | None = None) -> DataFrame:
    """``critiques`` with ``text`` cleaned and n_lines, n_dropped added.

    ``critiques``: critique_run_id, text and any further columns, which pass through (columns
    named n_lines or n_dropped are replaced). A line is a piece between line feeds; its key is the
    line without ASCII white space at either end, A-Z lower-cased. A key with at least one code
    point that stands in ``min_critiques`` or more critiques loses all its lines everywhere, the
    other lines stay, joined by line feeds. Blank lines always stay.

    Method: an exact table counts the critiques of every key; per shard a cuckoo filter holds
    the keys at or above the bound. Lines pass their shard's filter first, and what it lets
    through is confirmed by the exact counts, so a false positive drops nothing. Counts and
    filters of an earlier state may be given (``changed_counts``, ``changed_filters`` keep them
    current under additions and deletions); otherwise they are made from ``critiques``.

    A null text counts as empty: one empty line, and stays null-free ("") in the result. Every row is
    a critique of its own, also when it repeats another or has a null id. No critiques give no
    rows.
    """
    wide = passed_on(tuple(critiques.columns), ("n_lines", "n_dropped"))
    own, gone_here = free_name("_id", wide), free_name("_common", wide)
    critiques = critiques.select(*wide)
    if counts is None:
        counts = stored(count_lines(critiques))
    if shards is None:
        shards = -(-_listed(counts, min_critiques).count() // SHARD_KEYS) or 1
    if filters is None:
        filters = stored(build_filters(counts, shards, min_critiques))
    # Shards and salts together give every shuffle partition several groups, however few keys are listed.
    salts = salts or max(SALTS, -(-4 * int(critiques.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    passed = _candidates(critiques, filters, shards, salts)
    sure = passed.join(_listed(counts, min_critiques).select("key"), "key")
    common = sure.groupBy(F.col("critique_run_id").alias(own)).agg(F.collect_set("key").alias(gone_here))
    joined = critiques.join(common, F.col("critique_run_id").eqNullSafe(F.col(own)), "left").select(*wide, gone_here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, totals, gone = [], [], []
            for text, common in zip(batch.column("text").to_pylist(), batch.column(gone_here).to_pylist()):
                lines, common = _lines(text), set(common or ())
                kept = [x for x in lines if _key(x) not in common] if common else lines
                texts.append(b"\n".join(kept).decode())
                totals.append(len(lines))
                gone.append(len(lines) - len(kept))
            made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(totals, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c) if c in wide else None) for c in names], names)

    names = [*wide, "n_lines", "n_dropped"]
    schema = StructType([*critiques.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return joined.mapInArrow(run, schema)
