"""Hard negatives among shots: exact scores of many shots at once through packed products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmgrain.llm.batches import list_column
from filmgrain.llm.nearest import whole_features
from filmgrain.llm.shared import stored

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
BLOCK = 2048
ANCHOR_BLOCK = 256


class PackedShots:
    """A block of shots as one wide integer a component, a field of ``bits`` a shot.

    Sum over the components of (anchor component times wide integer) holds all scores of an anchor, each
    in its own field, as long as no score leaves its field. ``bits`` is chosen from the largest components
    on both sides, so none does.
    """

    def __init__(self, whole: np.ndarray, most: int):
        self.count, dims = whole.shape
        size = int(np.abs(whole).max(initial=0))
        bits = (max(1, dims * size * most).bit_length() + 8) // 8 * 8
        self.bytes = bits // 8
        ones = ((1 << bits * self.count) - 1) // ((1 << bits) - 1)
        self.bias = ones << bits - 1
        self.wide = [self._packed(whole[:, d] + size) - size * ones for d in range(dims)]

    def _packed(self, column: np.ndarray) -> int:
        fields = np.zeros((self.count, self.bytes), np.uint8)
        raw = column.astype("<i8").view(np.uint8).reshape(-1, 8)
        width = min(8, self.bytes)
        fields[:, :width] = raw[:, :width]
        return int.from_bytes(fields.tobytes(), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The integer inner product of ``anchor`` with every shot of the block."""
        total = self.bias
        for a, wide in zip(anchor, self.wide):
            if a:
                total += a * wide
        fields = np.frombuffer(total.to_bytes(self.count * self.bytes, "little"), np.uint8).reshape(-1, self.bytes)
        # Fields hold score + 2^(bits - 1): flipping the top bit gives two's complement, which is then widened to 64 bits.
        width = min(8, self.bytes)
        out = np.zeros((self.count, 8), np.uint8)
        out[:, 8 - width:] = fields[:, :width]
        if self.bytes <= 8:
            out[:, 7] ^= 0x80
        return out.view("<i8").ravel() >> (64 - 8 * width)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` shots of one length and key label as one row each: ids and components packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            whole = block.column("whole").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            most = int(np.abs(whole).max(initial=0))
            kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
            return pa.RecordBatch.from_arrays([
                block.column("dims").combine_chunks()[:1], block.column(LABEL).combine_chunks()[:1], pa.array([len(block)], pa.int32()), pa.array([most], pa.int64()),
                list_column([block.column("shot_id").to_numpy()], pa.int64()), pa.array([whole.astype(kind).tobytes()], pa.binary())], names)

        held, count, last = [], 0, None
        for batch in batches:
            keys = list(zip(batch.column("dims").to_pylist(), batch.column(LABEL).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and (last != keys[a]):
                    yield out(held)
                    held, count = [], 0
                last = keys[a]
                while a < b:
                    end = min(b, a + size - count)
                    held.append(batch.slice(a, end - a))
                    count, a = count + end - a, end
                    if count == size:
                        yield out(held)
                        held, count = [], 0
        if held:
            yield out(held)

    LABEL = "lighting_key"
    names = ["dims", LABEL, "n", "most", "ids", "data"]
    kind = rows.schema[LABEL].dataType.simpleString()
    order = ["dims", LABEL, "shot_id"]
    dealt = rows.select("dims", LABEL, "shot_id", "whole").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(run, f"dims int, {LABEL} {kind}, n int, most bigint, ids array<bigint>, data binary"))


def _unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * dims)]).reshape(n, dims).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _met(anchors: DataFrame, blocks: DataFrame, alike: bool) -> DataFrame:
    """Every block of anchors beside every block of shots of the same key label, or of other ones.

    The blocks of shots are dealt into slots, eight to a slot on average, and the few blocks of anchors
    are copied to each, so the large side is shuffled once.
    """
    slots = max(1, blocks.count() // 8)
    shots = blocks.select(*(F.col(c).alias(f"shot_{c}") for c in blocks.columns), F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int").alias("slot"))
    copied = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    same = F.col("lighting_key") == F.col("shot_lighting_key")
    return copied.join(shots, "slot").where((F.col("dims") == F.col("shot_dims")) & (same if alike else ~same))


def _best_of(columns: list[np.ndarray], group: int, k: int) -> list[np.ndarray]:
    """The first ``k`` rows of each group (the first ``group`` columns) by the last column, highest first, ties to the smaller id after the group."""
    order = np.lexsort((columns[group], -columns[-1], *columns[:group][::-1]))
    columns = [c[order] for c in columns]
    opens = np.ones(len(order), bool)
    opens[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in columns[:group]])
    at = np.flatnonzero(opens)
    rank = np.arange(len(order)) - np.repeat(at, np.diff([*at, len(order)]))
    return [c[rank < k] for c in columns]


def _scored(pairs: DataFrame, choose, schema: str, group: int, k: int) -> DataFrame:
    """What ``choose(row, anchor number, anchor id, scores, shot ids)`` gives for each anchor and block of shots; of the blocks
    that one batch brings together only the first ``k`` rows a group go on."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.array(row["shot_ids"], np.int64)
                packed = PackedShots(_unpacked(row["shot_data"], len(ids), row["dims"]), row["most"])
                found += [part for n, (anchor, whole) in enumerate(zip(row["ids"], _unpacked(row["data"], row["n"], row["dims"]).tolist()))
                          for part in choose(row, n, anchor, packed.scores(whole), ids)]
            if found:
                best = _best_of([np.concatenate(c) for c in zip(*found)], group, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best], names)

    return pairs.mapInArrow(run, schema)


def mine_hard_negatives(shots: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                        block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: shots that look like an anchor but are lit in another key.

    ``shots``: shot_id bigint, lighting_key (any orderable type), features array of numbers; other columns are ignored.
    ``anchors``: shot_id of the shots to mine for. Components become floor(256 * x) and a score is the integer inner
    product, which must fit a long; higher comes first, ties by smaller shot_id. An anchor's positives are its first ``positives``
    other shots of the same lighting_key (all, if fewer). For each of them the first ``negatives`` (all, if fewer) shots of another
    lighting_key follow whose score lies between ``low`` and ``high`` hundredths of the positive's, both included; a
    positive that has none gives no row. Only shots with equally many components are compared.

    Method: the components of a block of shots are packed into fields of one wide integer each
    (Kronecker's substitution). A block takes one multiplication per anchor component, and the fields of the sum are the
    exact scores. Blocks hold shots of one lighting_key, cut at ``block`` shots however common the key is; anchors, in
    blocks of their own, meet the blocks of their key for positives and those of other keys for negatives. Each pair of blocks
    gives its best only, and a window per anchor and positive ranks these. Anchors are a stated set that meets all shots.

    Shots whose lighting_key, features or a component is null, whose features are empty, or that hold a
    non-finite component take no part, as anchor, positive or negative. Of rows with one shot_id the
    one with the smallest lighting_key, then features, counts. Rows with a null shot_id take no part. Empty tables give no rows.
    """
    whole = shots.select("shot_id", "lighting_key", whole_features(F.col("features")).alias("whole")).where("shot_id is not null and lighting_key is not null and whole is not null")
    one = whole.groupBy("shot_id").agg(F.min(F.struct("lighting_key", "whole")).alias("s"))
    table = stored(one.select("shot_id", "s.*", F.size("s.whole").alias("dims")))
    blocks = _blocks(table, block)
    asked = stored(table.join(anchors.select("shot_id").distinct(), "shot_id", "left_semi"))

    def alike(row: dict, n: int, anchor: int, scores: np.ndarray, ids: np.ndarray) -> list:
        others = np.flatnonzero(ids != anchor)
        best = others[_first(scores[others], ids[others], positives)]
        return [(np.full(len(best), anchor), ids[best], scores[best])]

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = _scored(_met(_blocks(asked, anchor_block), blocks, True), alike, "anchor_id bigint, positive_id bigint, positive_score bigint", 1, positives)
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = stored(near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("near")))

    mined = _blocks(asked.join(near.select(F.col("anchor_id").alias("shot_id")), "shot_id", "left_semi"), anchor_block)
    bounds = mined.select(F.xxhash64("ids").alias("block"), F.posexplode("ids").alias("n", "anchor_id")).join(near, "anchor_id")
    bounds = stored(bounds.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "near"))), lambda s: s["near"]).alias("near")))
    mined = mined.withColumn("block", F.xxhash64("ids")).join(bounds, "block").drop("block")

    def unlike(row: dict, n: int, anchor: int, scores: np.ndarray, ids: np.ndarray) -> list:
        out = []
        for p in row["near"][n]:
            fits = np.flatnonzero((100 * scores >= low * p["positive_score"]) & (100 * scores <= high * p["positive_score"]))
            best = fits[_first(scores[fits], ids[fits], negatives)]
            size = len(best)
            out.append((np.full(size, anchor), np.full(size, p["positive_id"]), ids[best], np.full(size, p["positive_score"]), scores[best]))
        return out

    found = _scored(_met(mined, blocks, False), unlike, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint", 2, negatives)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
