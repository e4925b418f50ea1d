"""Repeated substrings of critique texts, by intervals of a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmgrain.llm.batches import _BASE, _BYTE_CODE, mix, slices, span_hashes, text_bytes
from filmgrain.llm.shared import stored

MIN_BYTES = 200
ANCHOR_BYTES = 48
INDEX_BYTES = 1 << 20
MAX_VARIANTS = 2_048
_RUN = "key bigint, piece bigint, digest binary, low int, high int"


# --- the index of one batch -----------------------------------------------------
def _suffix_order(codes: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by the ``length`` (or more) codes from there on; equal ones in any order."""
    n = len(codes)

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, x.dtype)
        out[:n - by] = x[by:] if by < n else 0
        return out

    key, seen = codes.astype(np.uint64), 4
    for by in (1, 2, 3):
        key = key << np.uint64(16) | ahead(codes.astype(np.uint64), by)
    while True:
        order = np.argsort(key)
        new = np.zeros(n, np.uint64)
        new[1:] = key[order][1:] != key[order][:-1]
        place = np.cumsum(new)
        if seen >= length or place[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = place + np.uint64(1)
        key, seen = rank << np.uint64(32) | ahead(rank, seen), seen * 2


def repeated_starts(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the texts in ``data`` (text i is bounds[i]:bounds[i + 1]), whether a string of
    ``length`` bytes starts there that also starts at another place.

    Common prefixes of suffix neighbours come from the Burrows-Wheeler transform alone: all
    strings of length 0, 1, 2, ... that occur are held as suffix intervals. A string is extended
    backwards by the transform's letters; where the longer string's interval ends and no common prefix is known yet, it is the
    current length, and only then the longer string is extended again. After ``length`` rounds the
    places still unknown are neighbours with ``length`` or more bytes in common.
    """
    texts = len(bounds) - 1
    n = len(data) + texts
    ends = bounds[1:] + np.arange(texts)
    codes = np.empty(n, np.int64)
    real = np.ones(n, bool)
    real[ends] = False
    codes[real], codes[ends] = data.astype(np.int64) + texts + 1, np.arange(1, texts + 1)
    order = _suffix_order(codes, length)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    before = order - 1
    letter = np.where(before >= 0, codes[before], 0)
    letter[letter <= texts] = 0
    back = at[before]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    # Length 1: each end mark is a string of its own, each byte value one interval.
    sorted_codes = codes[order]
    cut = np.flatnonzero(np.diff(sorted_codes)) + 1
    known[cut] = True
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    owner = np.full(n + 3, -1, np.int64)
    base = 0
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(which)) + np.repeat(low - np.cumsum(size) + size, size)
        here = letter[place]
        some = here > 0
        # Equal strings lie side by side, so a place ends its interval when the next one has another owner.
        image, mark = back[place[some]], base + which[some] * 70_000 + here[some]
        base += len(low) * 70_000
        owner[image + 1] = mark
        first, last = np.sort(image[owner[image] != mark]), np.sort(image[owner[image + 2] != mark])
        new = ~known[last + 1]
        known[last[new] + 1] = True
        low, high = first[new], last[new] + 1
    shared = np.flatnonzero(~known)
    hit = np.zeros(n, bool)
    hit[order[shared]] = hit[order[shared - 1]] = True
    return hit[real]



# --- pieces that may share a string ---------------------------------------------
def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on, by doubling; positions too near the end are left out."""
    out, done, part, width = None, 0, _BYTE_CODE[data], 1
    while True:
        if size & width:
            # The bits of ``size`` are taken from the left of the window, lowest first.
            piece = part[done:] if done else part
            out = piece if out is None else out[:len(piece)] * np.uint64(pow(_BASE, width, 1 << 64)) + piece[:len(out)]
            done += width
        if done == size:
            return mix(out)
        if len(part) <= width:
            return np.zeros(0, np.uint64)
        part, width = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:], width * 2


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values."""
    width = 1
    while width * 2 <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(key, piece hash, text number, low, high): runs of starts whose windows have one anchor.

    A window's anchor is its ``anchor``-byte string of least hash, the leftmost of equal ones, so equal
    windows have equal anchors at equal distance. ``low`` to ``high`` are starts in the text,
    both inclusive; the piece is the text from low to high + length.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none.view(np.uint64), none.view(np.uint64), none, none, none)
    hashes = _rolled(data, anchor)
    place = np.arange(len(hashes), dtype=np.uint64)
    best = _least(hashes >> np.uint64(32) << np.uint64(32) | place, length - anchor + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(best)]
    valid = np.flatnonzero(np.arange(len(best)) + length <= offsets[1:][text])
    if not len(valid):
        return (none.view(np.uint64), none.view(np.uint64), none, none, none)
    held = (best[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(held) != 0) | (np.diff(valid) != 1)) + 1
    low, high = valid[np.concatenate([[0], cut])], valid[np.concatenate([cut, [len(valid)]]) - 1]
    home = text[low]
    return hashes[held[np.concatenate([[0], cut])]], span_hashes(data, low, high + length), home, low - offsets[home], high - offsets[home]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _digests(texts: pa.Array) -> list[bytes]:
    return [_digest(t or "") for t in texts.to_pylist()]


def _runs(critiques: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", INDEX_BYTES):
            key, piece, text, low, high = anchored_runs(*text_bytes(batch.column("text")), length, anchor)
            digests = pa.array(_digests(batch.column("text")), pa.binary()).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), digests, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["key", "piece", "digest", "low", "high"])

    return critiques.select("text").mapInArrow(run, _RUN)


def _with_digest(critiques: DataFrame, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(_digests(batch.column("text")), pa.binary())], [*names, "digest"])

    df = critiques.select(*names)
    return df.mapInArrow(run, f"{df.schema.toDDL()}, digest binary")


# --- repeated starts of each piece ----------------------------------------------
def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """key, piece, spans: repeated starts of pieces, from an index over batches of whole keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}

        def done() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(held.values()), np.uint8)
            bounds = np.cumsum([0, *map(len, held.values())])
            hit = np.concatenate([[False], repeated_starts(data, bounds, length), [False]]).astype(np.int8)
            rise, fall = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1) - 1
            rows, home = list(held), np.searchsorted(bounds, rise, "right") - 1
            # A hit never reaches a piece's end, so no run crosses from one piece to the next.
            return pa.RecordBatch.from_arrays([
                pa.array([rows[h][0] for h in home], pa.int64()), pa.array([rows[h][1] for h in home], pa.int64()),
                pa.array((rise - bounds[home]).astype(np.int32)), pa.array((fall - bounds[home]).astype(np.int32))], ["key", "piece", "first", "last"])

        size, last = 0, None
        for batch in batches:
            for key, piece, data in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "data"))):
                if size >= INDEX_BYTES and key != last:
                    yield done()
                    held.clear()
                    size = 0
                if (key, piece) not in held:
                    held[key, piece] = data
                    size += len(data)
                last = key
        if held:
            yield done()

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "key bigint, piece bigint, first int, last int")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """key, piece, first, last: the same for keys with very many different pieces, where
    every window is counted by itself, so no task needs a whole key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, piece, data in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "data"))):
                n = len(data) - length + 1
                marks = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([piece] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(marks, pa.binary())], ["key", "piece", "first", "mark"])

    windows = stored(pieces.select("key", "piece", "data").mapInArrow(run, "key bigint, piece bigint, first int, mark binary"))
    often = windows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    return windows.join(often, "mark").select("key", "piece", "first", F.col("first").alias("last"))


def repeated_spans(critiques: DataFrame, min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """digest, spans: byte ranges [start, end) of each different text that ``min_bytes``-byte strings
    cover which also start anywhere else. Texts without any are left out."""
    critiques = critiques.select("text").where(F.octet_length("text") >= min_bytes)
    runs = stored(_runs(critiques, min_bytes, anchor_bytes))
    # Stored before the join, so a hot key's runs come from an exchange that the skew join may split.
    shared = stored(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    runs = stored(runs.join(shared, "key"))
    counts = stored(runs.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("digest", "low", "high")).alias("from")))
    keys = counts.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.min("times").alias("least"))

    # A piece that occurs twice is repeated as a whole; where a key has pieces that occur once, its different pieces are indexed.
    open_keys = stored(keys.where("variants > 1 and least = 1").select("key", (F.col("variants") > max_variants).alias("many")))
    wanted = counts.join(open_keys, "key").select("key", "piece", "many", "from.*")
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("key", "piece", "many", "low", "high")).alias("pieces"))
    texts = _with_digest(critiques, ["text"]).groupBy("digest").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(p["key"], p["piece"], p["many"], data[p["low"]:p["high"] + min_bytes])
                    for text, found in zip(batch.column("text").to_pylist(), batch.column("pieces").to_pylist())
                    for data in [text.encode()] for p in found]
            key, piece, many, data = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int64()), pa.array(many, pa.bool_()), pa.array(data, pa.binary())], ["key", "piece", "many", "data"])

    pieces = stored(texts.join(lists, "digest").select("text", "pieces").mapInArrow(cut, "key bigint, piece bigint, many boolean, data binary"))
    hits = _indexed(pieces.where("not many"), min_bytes)
    if open_keys.where("many").limit(1).count():
        hits = hits.union(_counted(pieces.where("many"), min_bytes))
    hits = stored(hits)

    places = runs.distinct()
    whole = counts.where("times > 1").select("key", "piece")
    covered = places.join(whole, ["key", "piece"]).select("digest", "low", "high").union(
        places.join(hits, ["key", "piece"]).select("digest", F.col("low") + F.col("first"), F.col("low") + F.col("last")))
    return covered.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("starts"))


def remove_repeats(critiques: DataFrame, min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """critique_run_id, n_bytes, n_removed, n_spans, kept: each text without its repeated strings.

    ``critiques``: critique_run_id, text; other columns are ignored. Texts are UTF-8 bytes. Every byte
    goes that a string of ``min_bytes`` bytes covers which also starts anywhere else, in the same
    text or another, judged on the input; matches never cross texts. ``kept`` holds the remaining bytes
    (binary, as a cut may part a character), n_spans counts maximal removed runs.

    Method: windows of ``min_bytes`` bytes are grouped by their anchor, the ``anchor_bytes``-byte string of least hash
    in them, and runs of windows with one anchor form pieces, so equal windows meet under one key. Keys that
    occur once are left out. Different pieces of a key are indexed together, in batches of whole keys:
    backward extension on the Burrows-Wheeler transform expands suffix intervals breadth-first, giving
    common prefixes by increasing value, and stops at ``min_bytes``; what is still open then is
    repeated. Equal pieces are one piece that counts as repeated. A key with more than
    ``max_variants`` different pieces (a passage with very many surroundings) has its windows
    counted one by one, so no task holds a whole such key.

    Null texts count as empty. Texts below ``min_bytes`` keep everything. Equal texts of at least that size
    lose everything. Repeated rows and null ids each get a row; no critiques give no rows.
    """
    kind = critiques.schema["critique_run_id"].dataType.simpleString()
    spans = repeated_spans(critiques, min_bytes, anchor_bytes, max_variants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                data, kept, spans, end = (text or "").encode(), [], 0, 0
                reach = -1
                for s in starts or ():
                    if s["low"] > reach:
                        kept.append(data[end:s["low"]])
                        spans += 1
                    reach = end = max(end, s["high"] + min_bytes)
                kept = b"".join(kept) + data[end:]
                out.append((len(data), len(data) - len(kept), spans, kept))
            n, gone, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column("critique_run_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             ["critique_run_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _with_digest(critiques, ["critique_run_id", "text"]).join(spans, "digest", "left").select("critique_run_id", "text", "starts")
    return joined.mapInArrow(run, f"critique_run_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
