"""Near copies among critique texts: MinHash signatures joined through inverted postings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmgrain.llm.batches import free_name, list_column, lowered, mix, shingle_hashes, slices, span_hashes, text_bytes, word_spans
from filmgrain.llm.shared import connected, stored

WORDS = 5
PERCENT = 85
COORDINATES = 64
# Of 64 coordinates a pair at 85 % agrees in 54.4 on average (deviation 2.9); under 40
# agree for about one such pair in a million, so this bound costs no link in practice.
MATCHES = 40
BLOCK_BYTES = 16 << 20
_FACTORS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    data = lowered(data)
    starts, ends, bounds = word_spans(data, offsets)
    return shingle_hashes(span_hashes(data, starts, ends), bounds, size)


def _digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """uint32 matrix: the least hash of each non-empty set under each coordinate."""
    offsets = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat((flat * _FACTORS[k]) >> np.uint64(32), offsets)
    return out


def signed_sets(critiques: DataFrame, words: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """critique_run_id, n_shingles, digest of the shingle set (null when empty) and its
    signature, coordinate number in the high half of each value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(coordinates, dtype=np.int64) << 32
        for batch in slices(batches, "text"):
            sets = _sets(batch, words)
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full, coordinates).astype(np.int64) | high) if full else iter(())
            yield pa.RecordBatch.from_arrays([
                batch.column("critique_run_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_digests(sets), pa.binary()),
                list_column([next(rows) if len(s) else np.zeros(0, np.int64) for s in sets], pa.int64())], ["critique_run_id", "n_shingles", "digest", "signature"])

    kind = critiques.schema["critique_run_id"].dataType.simpleString()
    return critiques.select("critique_run_id", "text").mapInArrow(
        run, f"critique_run_id {kind}, n_shingles bigint, digest binary, signature array<bigint>")


def posted(sets: DataFrame, matches: int = MATCHES) -> DataFrame:
    """digest, prefix: the rarest postings of each set that still may have a partner.

    A posting is one coordinate-value pair. Postings with a single member can't match, so a
    set with fewer than ``matches`` others is out. Two sets that agree in ``matches`` of their
    remaining postings share one among the rarest ``count - matches + 1`` of either.
    """
    posts = sets.select("digest", F.explode("signature").alias("post"))
    sizes = posts.groupBy("post").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    own = posts.join(sizes, "post").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("members", "post"))).alias("own"))
    return own.where(F.size("own") >= matches).select(
        "digest", F.slice(F.col("own.post"), 1, F.size("own") - (matches - 1)).alias("prefix"))


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def links_in(side: list[int], digests: list[bytes], marks: np.ndarray, prefixes: list[np.ndarray], sets: list[np.ndarray],
             matches: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Confirmed links of one block, or between two blocks, as a spanning forest.

    Each set merges the postings of its prefix into candidates, the long postings are not
    merged but probed per candidate, and pairs with enough collisions are compared on full
    sets. Pairs that are joined already by confirmed links are skipped.
    """
    across = len(set(side)) > 1
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.cumsum([0, *(len(s) for s in sets)])
    sizes = np.diff(bounds)
    flag, root = np.zeros(local.max() + 1, bool), np.arange(len(sets))
    lists: dict[int, list[int]] = {}
    sides, out = np.array(side), []
    for x in range(len(sets)):
        found = [lists.setdefault(p, []) for p in prefixes[x].tolist()]
        near = np.unique(np.concatenate([np.array(f, np.int64) for f in found])) if found else np.zeros(0, np.int64)
        for f in found:
            f.append(x)
        if across:
            near = near[sides[near] != side[x]]
        near = near[(100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x]))]
        for at in range(0, len(near), 4096):
            part = near[at:at + 4096]
            part = part[(marks[part] == marks[x]).sum(1) >= matches]
            mine = _find(root, x)
            part = np.array([y for y in part.tolist() if _find(root, y) != mine], np.int64)
            if not len(part):
                continue
            flag[local[bounds[x]:bounds[x + 1]]] = True
            hits = np.concatenate([flag[local[bounds[y]:bounds[y + 1]]] for y in part])
            common = np.add.reduceat(hits, np.cumsum([0, *sizes[part]])[:-1], dtype=np.int64)
            flag[local[bounds[x]:bounds[x + 1]]] = False
            for y in part[100 * common >= percent * (sizes[part] + sizes[x] - common)].tolist():
                a, b = _find(root, x), _find(root, y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((digests[x], digests[y]))
    return out


def confirmed_links(members: DataFrame, matches: int = MATCHES, percent: int = PERCENT) -> DataFrame:
    """Links a, b between digests. ``members``: one row per set and block pair it takes part in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def done() -> pa.RecordBatch:
            kept = list(rows.values())
            found = links_in([r[0] for r in kept], [*rows], np.array([r[1] for r in kept]), [r[2] for r in kept], [r[3] for r in kept], matches, percent) if len(kept) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c) for c in ("root", "i", "j", "block", "digest", "signature", "prefix", "shingles")]
            lists = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in cols[5:]]
            heads = list(zip(*(c.to_pylist() for c in cols[:5])))
            for r, (group, i, j, block, digest) in enumerate(heads):
                if key != (group, i, j):
                    if len(rows) > 1:
                        yield done()
                    key, rows = (group, i, j), {}
                mark, prefix, shingles = (v[o[r]:o[r + 1]].copy() for v, o in lists)
                rows[digest] = (block, mark.astype(np.uint32), prefix, shingles.view(np.uint64))
        if len(rows) > 1:
            yield done()

    dealt = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "digest")
    return dealt.mapInArrow(run, "a binary, b binary")


def link_near_copies(critiques: DataFrame, words: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES,
                     matches: int = MATCHES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """critique_run_id, n_shingles, component_id, kept: groups of near-copied critiques.

    ``critiques``: critique_run_id (any orderable type), text; other columns are ignored. Words
    are runs without ASCII white space, A-Z lower-cased; a text's set is its distinct
    ``words``-word shingles (a shorter text: its whole sequence). Two sets are linked when
    ``100 * common >= percent * union``.

    Method: equal sets become one member. Every member is posted under each coordinate-value
    pair of its MinHash signature. The rarest postings of a member (its prefix) draw its
    candidates, further collisions are probed without merging the long postings, and pairs
    with at least ``matches`` of ``coordinates`` collisions are confirmed on full sets.
    Members whose prefixes meet form a candidate group. A group above ``block_bytes`` of
    shingles is cut into blocks that meet pairwise, so no task holds an unbounded group, and
    a block returns a spanning forest of its links, never all pairs.

    Null or empty texts and texts of white space have an empty set: n_shingles 0, linked with
    nothing. Rows with a null id take part, but the smallest id of a group ignores nulls; a
    group of null ids only has a null component_id. Repeated rows are copies of each other.
    An empty table gives an empty table.
    """
    critiques = critiques.select("critique_run_id", "text")
    signed = stored(signed_sets(critiques, words, coordinates))
    sets = stored(signed.where("digest is not null").groupBy("digest").agg(
        F.min("critique_run_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    prefixes = stored(posted(sets, matches))
    posts = prefixes.select("digest", F.explode("prefix").alias("post"))
    stars = posts.groupBy("post").agg(F.min("digest").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = connected(posts.join(stars, "post").select(F.col("digest").alias("a"), "b"))

    members = sets.join(prefixes, "digest").join(groups.withColumnRenamed("node", "digest"), "digest")
    weight = members.groupBy("root").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + 1024) / F.lit(block_bytes)).cast("int").alias("blocks"))
    members = members.join(weight, "root").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _sets(batch, words)
            kept = pa.array([d == e for d, e in zip(_digests(found), batch.column("digest").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), list_column([s.view(np.int64) for s in found], pa.int64())], [*names, "shingles"]).filter(kept)

    names = ["root", "blocks", "block", "digest", "signature", "prefix"]
    texts = critiques.join(members, F.col("critique_run_id").eqNullSafe(F.col("first_id"))).select("text", *names)
    texts = texts.mapInArrow(run, "root binary, blocks int, block int, digest binary, signature array<bigint>, prefix array<bigint>, shingles array<bigint>")
    other = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = stored(confirmed_links(other.select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "signature", "prefix", "shingles"), matches, percent))

    linked = connected(links)
    labels = sets.select("digest", "first_id").join(linked.withColumnRenamed("node", "digest"), "digest", "left")
    labels = labels.withColumn("root", F.coalesce("root", "digest"))
    least = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(least, "root").select("digest", "component_id")
    component = F.when(F.col("digest").isNull(), F.col("critique_run_id")).otherwise(F.col("component_id"))
    return signed.select("critique_run_id", "n_shingles", "digest").join(labels, "digest", "left").select(
        "critique_run_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("critique_run_id") == component, F.lit(True)).alias("kept"))


def keep_first_copies(critiques: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """``critiques`` with one row of each group of near copies (the smallest id), all columns kept, whatever their names.

    ``percent``: the similarity from which texts are copies; ``matches``: collisions a pair needs to be
    compared, to be lowered with ``percent``.
    Rows without words, and rows of a group that has null ids only, all stay. Of rows that repeat both id and text
    one stays. Cases and method are those of ``link_near_copies``.
    """
    own, rows = free_name("_id", critiques.columns), free_name("_rows", critiques.columns)
    kept = stored(link_near_copies(critiques, percent=percent, matches=matches).where("kept").groupBy(F.col("critique_run_id").alias(own)).agg(
        F.sum((F.col("n_shingles") > 0).cast("int")).alias(rows)))
    first = critiques.join(kept.select(own), F.col("critique_run_id").eqNullSafe(F.col(own)), "left_semi")
    if kept.where((F.col(rows) > 1) & F.col(own).isNotNull()).limit(1).count():
        first = first.dropDuplicates(["critique_run_id", "text"])
    return first
