"""Exact best matches among shot feature vectors through pivots and sorted annuli."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmgrain.llm.batches import list_column
from filmgrain.llm.shared import hash_sample, stored

TOP = 5
PIVOTS = 32
SAMPLE = 4096
BLOCK = 2048
QUERY_BLOCK = 512
# Of the largest length: what rounding may put on a distance, with room to spare.
SLACK = 4e-6


def whole_features(features: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null unless all components are finite numbers."""
    good = F.forall(features, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(features) > 0), F.transform(features, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Points of the sample far from each other: each is the farthest from those before."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((points ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * points @ pivots.T, 0))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scores(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products; in floating point where every sum stays below 2^53."""
    if top < 2 ** 52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dims)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` neighbours in (pivot, distance) order as one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            where, dist, ids, vectors = held[0][0], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            return pa.RecordBatch.from_arrays([
                pa.array([where[0]], pa.int32()), pa.array([where[1]], pa.int32()), pa.array([dist.min()]), pa.array([dist.max()]), pa.array([len(ids)], pa.int32()),
                list_column([ids], pa.int64()), pa.array([vectors.tobytes()], pa.binary())],
                ["dims", "pivot", "low", "high", "n", "ids", "vectors"])

        held, count = [], 0
        for batch in batches:
            dims, pivot = batch.column("dims").to_numpy(), batch.column("pivot").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(pivot) != 0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[0][0] != (dims[a], pivot[a]):
                    yield out(held)
                    held, count = [], 0
                while a < b:
                    end = min(b, a + size - count)
                    part = batch.slice(a, end - a)
                    held.append(((dims[a], pivot[a]), part.column("distance").to_numpy(), part.column("shot_id").to_numpy(), _rows(part.column("whole"))))
                    count, a = count + end - a, end
                    if count == size:
                        yield out(held)
                        held, count = [], 0
        if held:
            yield out(held)

    made = rows.mapInArrow(run, "dims int, pivot int, low double, high double, n int, ids array<bigint>, vectors binary")
    return stored(made.withColumn("block", F.xxhash64("dims", "pivot", "low", "high", "ids")))


def _searched(pairs: DataFrame, k: int, with_bound: bool) -> DataFrame:
    """query_id, shot_id, score: the best k of each query in each block it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                qs, xs = _unpack(row["q_vectors"], dims), _unpack(row["vectors"], dims)
                qi, xi = (np.array(row[c], np.int64) for c in ("q_ids", "ids"))
                used = np.arange(len(qi))
                if with_bound:
                    at, reach = (np.frombuffer(row[c], np.float64) for c in ("q_at", "q_reach"))
                    used = np.flatnonzero((at - reach <= row["high"]) & (at + reach >= row["low"]))
                if not len(used):
                    continue
                top = float(np.abs(qs).max()) * float(np.abs(xs).max()) * dims
                scores = _scores(qs[used], xs, top)
                found = []
                for n, q in enumerate(used):
                    others = np.flatnonzero(xi != qi[q])
                    best = others[_best(scores[n, others], xi[others], k)]
                    found.append((np.full(len(best), qi[q]), xi[best], scores[n, best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "shot_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, shot_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "shot_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_shots(shots: DataFrame, queries: DataFrame, top: int = TOP, pivots: int = PIVOTS, sample: int = SAMPLE,
                  block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, shot_id, score: the ``top`` shots by integer inner product of features.

    ``shots``: shot_id bigint, features array of numbers; other columns are ignored. ``queries``:
    shot_id of the shots to search for. Components become floor(256 * x); sums of products must fit a long. All other rows are
    candidates (rows that share the query's id are the query itself); ties go to the smaller
    shot_id. Only vectors of equal length are compared.

    Method: one more component, sqrt(M - |x|^2) with M the largest squared length, turns the
    largest product into the least distance. Vectors are keyed by (nearest pivot, distance to it)
    and cut into sorted annuli of ``block`` rows. Blocks of queries search the annuli of
    their own pivot around them first, which bounds their fifth best; then they search just those annuli
    of all pivots that the triangle inequality can't exclude at that bound. Pivots come from
    a sample of ``sample`` vectors (the smallest hashes of the ids), which decides speed only: every row
    is indexed and the result is exact. Queries meet annuli in blocks; nothing is collected but
    the pivots.

    Vectors that are null or empty or hold a null or non-finite component take no part, as query or
    candidate. Fewer than ``top`` candidates give fewer rows. Repeated rows give one candidate an id
    and vector. Empty tables give no rows.
    """
    shots = shots.select("shot_id", whole_features(F.col("features")).alias("whole")).where("shot_id is not null and whole is not null").dropDuplicates()
    shots = shots.withColumns({"dims": F.size("whole"), "length": F.aggregate("whole", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))})
    heads = {r.dims: r.most for r in shots.groupBy("dims").agg(F.max("length").alias("most")).collect()}
    by_dims: dict[int, list] = {}
    for r in hash_sample(shots.select("shot_id", "dims", "whole"), sample, "shot_id").collect():
        by_dims.setdefault(r.dims, []).append(r.whole)

    def lifted(whole: np.ndarray) -> np.ndarray:
        plain = whole.astype(np.float64)
        rest = np.sqrt(np.maximum(heads[whole.shape[1]] - (plain ** 2).sum(1), 0))
        return np.hstack([plain, rest[:, None]])

    points = {d: _pivots(lifted(np.array(by_dims.get(d, [[0] * d]), np.int64)), pivots) for d in heads}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in np.unique(batch.column("dims").to_numpy()):
                rows = batch.filter(pa.array(batch.column("dims").to_numpy() == d))
                whole = _rows(rows.column("whole"))
                away = _distances(lifted(whole), points[d])
                pivot = away.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("shot_id"), rows.column("dims"), rows.column("whole"), pa.array(pivot), pa.array(away[np.arange(len(pivot)), pivot])],
                                                 ["shot_id", "dims", "whole", "pivot", "distance"])

    index = stored(shots.select("shot_id", "dims", "whole").mapInArrow(keyed, "shot_id bigint, dims int, whole array<bigint>, pivot int, distance double"))
    asked = index.join(queries.select("shot_id").distinct(), "shot_id", "left_semi")
    order = ["dims", "pivot", "distance", "shot_id"]
    blocks = _packed(index.repartitionByRange(*order).sortWithinPartitions(*order), block)
    searches = _packed(asked.repartitionByRange(*order).sortWithinPartitions(*order), query_block).select(
        "dims", F.col("pivot").alias("q_pivot"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    # First round: the annuli of the own pivot that hold the queries themselves.
    home = searches.withColumn("pivot", F.col("q_pivot")).join(blocks.select("dims", "pivot", "low", "high", "ids", "vectors"), ["dims", "pivot"])
    first = stored(_ranked(_searched(home.where("low <= q_high and high >= q_low"), top, False), top))
    fifth = first.where(F.col("rank") == top).select("query_id", F.col("score").alias("bound"))
    known = stored(searches.select("q_block", F.posexplode("q_ids").alias("place", "query_id")).join(fifth, "query_id", "left").groupBy("q_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "bound"))), lambda s: s["bound"]).alias("bounds")))

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dims"]
                whole = _unpack(row["q_vectors"], d)
                # The query lies in the plane of the plain components, so |q - x|^2 = |q|^2 + M - 2 q.x.
                flat = np.hstack([whole.astype(np.float64), np.zeros((len(whole), 1))])
                bounds = np.array([np.nan if b is None else b for b in row["bounds"]], np.float64)
                most = (flat ** 2).sum(1) + heads[d]
                reach = np.sqrt(np.maximum(most - 2 * bounds, 0)) + SLACK * np.sqrt(most)
                reach[np.isnan(bounds)] = np.inf
                away = _distances(flat, points[d])
                n = len(points[d])
                yield pa.RecordBatch.from_arrays([
                    pa.array([d] * n, pa.int32()), pa.array([row["q_block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array((away - reach[:, None]).min(0)), pa.array((away + reach[:, None]).max(0)),
                    pa.array([away[:, p].tobytes() for p in range(n)], pa.binary()), pa.array([reach.tobytes()] * n, pa.binary())],
                    ["dims", "q_block", "pivot", "ring_low", "ring_high", "q_at", "q_reach"])

    rings = searches.join(known, "q_block").select("dims", "q_block", "q_vectors", "bounds").mapInArrow(
        ringed, "dims int, q_block bigint, pivot int, ring_low double, ring_high double, q_at binary, q_reach binary")
    hit = rings.join(blocks.select("dims", "pivot", "low", "high", "block"), ["dims", "pivot"]).where("low <= ring_high and high >= ring_low")
    pairs = hit.select("q_block", "block", "q_at", "q_reach").join(
        searches.select("q_block", "q_ids", "q_vectors"), "q_block").join(blocks.select("block", "dims", "low", "high", "ids", "vectors"), "block")
    found = _searched(pairs, top, True).union(first.select("query_id", "shot_id", "score"))
    return _ranked(found, top).select("query_id", "rank", "shot_id", "score")

