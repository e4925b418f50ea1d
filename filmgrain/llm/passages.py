"""Passages that critiques take over from earlier ones: a compacted de Bruijn graph of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmgrain.llm.batches import _BASE, _INVERSE, _powers, list_column, mix, slices, span_hashes, text_bytes, word_spans
from filmgrain.llm.shared import stored

WORDS = 13
ANCHOR_WORDS = 4


# --- windows of one slice of texts ----------------------------------------------
def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; places too near the end are left out."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0xB5026F5AA96619E9) + words[k:len(out) + k]
    return mix(out)


def stretch_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each stretch of words; equal stretches hash alike wherever they stand."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * _powers(_BASE, len(words)), out=total[1:])
    return mix((total[high] - total[low]) * _powers(_INVERSE, len(words) + 1)[low] + (high - low).astype(np.uint64))


def anchored_windows(words: np.ndarray, bounds: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, key, piece, first, count): windows of ``size`` words in runs that share one anchor.

    A window's anchor is the ``anchor`` words of least hash in it, the leftmost of equal ones, so an equal window
    elsewhere has an equal anchor and meets it under the key, the anchor's hash. A run is ``count`` windows from word
    ``first`` of its text on; piece is the hash of all its words.
    """
    grams = window_hashes(words, anchor)
    spread = size - anchor + 1
    held = np.zeros(0, np.int64)
    if len(grams) >= spread:
        order = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
        least = order[:len(order) - spread + 1]
        for k in range(1, spread):
            least = np.minimum(least, order[k:len(least) + k])
        held = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(held)]
    whole = np.flatnonzero(np.arange(len(held)) + size <= bounds[1:][text])
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    cut = np.concatenate([[0], np.flatnonzero((np.diff(held[whole]) != 0) | (np.diff(whole) != 1)) + 1, [len(whole)]])
    low, count = whole[cut[:-1]], np.diff(cut)
    home = text[low]
    return home, grams[held[low]].view(np.int64), stretch_hashes(words, low, low + count + size - 1).view(np.int64), low - bounds[home], count


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends), bounds


def _digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


# --- the graph ------------------------------------------------------------------
def _runs(critiques: DataFrame, size: int, anchor: int) -> DataFrame:
    """key, piece, critique_run_id, first, count, lead: the runs of each text; lead marks a text's first run of a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, key, piece, first, count = anchored_windows(*_words(batch), size, anchor)
            lead = np.zeros(len(text), bool)
            order = np.lexsort((np.arange(len(text)), key, text))
            lead[order] = np.concatenate([[True], (np.diff(text[order]) != 0) | (np.diff(key[order]) != 0)])[:len(text)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(piece), batch.column("critique_run_id").take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(lead)],
                                             ["key", "piece", "critique_run_id", "first", "count", "lead"])

    kind = critiques.schema["critique_run_id"].dataType.simpleString()
    return critiques.where("critique_run_id is not null").mapInArrow(run, f"key bigint, piece bigint, critique_run_id {kind}, first int, count int, lead boolean")


def _read_at_source(critiques: DataFrame, sources: DataFrame, size: int) -> DataFrame:
    """The pieces with their nodes (hashes of ``size - 1`` words, one more than windows) and a digest of
    their words, both read from the text at the source's place."""
    kind = critiques.schema["critique_run_id"].dataType.simpleString()
    names = ["key", "piece", "branched", "first", "count", "last_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, bounds = _words(batch)
            nodes = window_hashes(words, size - 1).view(np.int64)
            found = batch.column("pieces")
            home = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            rows = pa.RecordBatch.from_struct_array(found.flatten())
            first, count = (rows.column(c).to_numpy().astype(np.int64) for c in ("first", "count"))
            low = bounds[home] + first
            high = low + count + size - 1
            # Of several texts with the source's id only those count that have the piece there.
            fits = np.flatnonzero(high <= bounds[home + 1])
            fits = fits[stretch_hashes(words, low[fits], high[fits]).view(np.int64) == rows.column("piece").to_numpy()[fits]]
            said = {i: (batch.column("text")[i].as_py() or "").encode().split() for i in np.unique(home[fits]).tolist()}
            checks = [_digest(said[h][a:b]) for h, a, b in zip(home[fits].tolist(), first[fits].tolist(), (first + count + size - 1)[fits].tolist())]
            kept = rows.take(pa.array(fits))
            yield pa.RecordBatch.from_arrays([
                *(kept.column(c) for c in names), batch.column("critique_run_id").take(pa.array(home[fits])), pa.array(checks, pa.int64()),
                list_column([nodes[a:b] for a, b in zip(low[fits].tolist(), (low + count + 1)[fits].tolist())], pa.int64())], [*names, "critique_run_id", "digest", "nodes"])

    lists = sources.groupBy("critique_run_id").agg(F.collect_list(F.struct(*names)).alias("pieces"))
    return critiques.join(lists, "critique_run_id").select("critique_run_id", "text", "pieces").mapInArrow(
        run, f"key bigint, piece bigint, branched boolean, first int, count int, last_id {kind}, critique_run_id {kind}, digest bigint, nodes array<bigint>")


def _glued(segments: DataFrame, through: DataFrame) -> DataFrame:
    """``segments`` with ``path``, the first word of the nonbranching path each belongs to: segments that follow each other
    in their source text are one path where the node between them has one edge in and one out."""
    order = Window.partitionBy("critique_run_id").orderBy("first")
    joined = segments.join(through.select(F.col("node").alias("left"), F.lit(True).alias("through")), "left", "left")
    follows = F.coalesce((F.lag(F.col("first") + F.col("count")).over(order) == F.col("first")) & F.col("through"), F.lit(False))
    marked = joined.withColumn("opens", F.when(~follows, F.col("first")))
    return marked.withColumn("path", F.max("opens").over(order)).drop("through", "opens")


def _range(low: Column, count: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), count.cast("int").alias("count"), F.col("critique_run_id").alias("source_id"), F.col("path"), (F.col("first") - F.col("path")).alias("offset"))


def repeated_pieces(critiques: DataFrame, size: int = WORDS, anchor: int = ANCHOR_WORDS) -> tuple[DataFrame, DataFrame]:
    """(places, pieces): where pieces stand, and which of their windows lie on repeated paths.

    places: key, piece, critique_run_id, first, count. pieces: key, piece, digest, ranges of (low, count, source_id, path, offset):
    ``count`` windows from ``low`` on are those from ``offset`` on of the path that starts at word ``path`` of the text
    ``source_id``, the smallest id with these windows.
    """
    critiques = critiques.select("critique_run_id", "text")
    runs = _runs(critiques, size, anchor)
    shared = stored(runs.where("lead").groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key"))
    places = stored(runs.join(shared, "key").select("key", "piece", "critique_run_id", "first", "count"))
    at = F.min(F.struct("critique_run_id", "first", "count")).alias("at")
    sources = stored(places.groupBy("key", "piece").agg(at, F.max("critique_run_id").alias("last_id")).select("key", "piece", "at.*", "last_id"))
    # Stored before the join, so a hot key's pieces come from an exchange that the skew join may split.
    keys = sources.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.min("critique_run_id").alias("low"), F.max("last_id").alias("high")).where("low < high")
    keys = stored(keys.select("key", (F.col("variants") > 1).alias("branched")))
    sources = sources.join(keys, "key")
    pieces = stored(_read_at_source(critiques, sources, size))

    # A key with one piece is a path already. Where a key has several, their windows are edges from node to node.
    plain = pieces.where("not branched and critique_run_id < last_id")
    sides = F.arrays_zip(F.slice("nodes", F.lit(1), F.col("count")).alias("left"), F.slice("nodes", F.lit(2), F.col("count")).alias("right"))
    edges = pieces.where("branched").select("key", "piece", "digest", "critique_run_id", "first", "last_id", F.posexplode(sides).alias("low", "side")).select(
        "key", "piece", "digest", "low", "critique_run_id", (F.col("first") + F.col("low")).alias("first"), "last_id", F.col("side.left").alias("left"), F.col("side.right").alias("right"))
    repeated = stored(edges.groupBy("left", "right").agg(F.min(F.struct("critique_run_id", "first")).alias("at"), F.max("last_id").alias("last_id")).where(
        "at.critique_run_id < last_id").select("left", "right", "at.*"))

    ends = plain.select(F.posexplode("nodes").alias("n", "node"), "count").select("node", (F.col("n") < F.col("count")).cast("int").alias("out"), (F.col("n") > 0).cast("int").alias("in"))
    ends = ends.union(repeated.select("left", F.lit(1), F.lit(0))).union(repeated.select("right", F.lit(0), F.lit(1)))
    through = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out = 1 and `in` = 1").select("node")
    segments = plain.select("key", "piece", "digest", "critique_run_id", "first", "count", F.col("nodes")[0].alias("left"), F.lit(None).cast("bigint").alias("right")).unionByName(
        repeated.withColumn("count", F.lit(1)), allowMissingColumns=True)
    paths = stored(_glued(segments, through))

    whole = paths.where("key is not null").select("key", "piece", "digest", F.array(_range(F.lit(0), F.col("count"))).alias("ranges")).dropDuplicates(["key", "piece"])
    of_edge = paths.where("key is null").select("left", "right", _range(F.lit(0), F.lit(1)).alias("r"))
    part = edges.select("key", "piece", "digest", "low", "left", "right").join(of_edge, ["left", "right"]).select("key", "piece", "digest", F.col("r").withField("low", F.col("low")).alias("r"))
    part = part.groupBy("key", "piece").agg(F.first("digest").alias("digest"), F.array_sort(F.collect_set("r")).alias("ranges"))
    return places, stored(whole.union(part.select("key", "piece", "digest", "ranges")))


def _verified(texts: list[list[bytes]], found: pa.ListArray, size: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, source code, path, offset, sources) of the ranges whose piece says in its text what the source says."""
    home = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    places = pa.RecordBatch.from_struct_array(found.flatten())
    first, end = (places.column(c).to_numpy().astype(np.int64) for c in ("first", "count"))
    end = first + end + size - 1
    true = np.fromiter((b <= len(texts[h]) and _digest(texts[h][a:b]) == d for h, a, b, d in zip(home.tolist(), first.tolist(), end.tolist(), places.column("digest").to_pylist())), bool, len(home))
    place = np.repeat(np.arange(len(home)), pc.list_value_length(places.column("ranges")).to_numpy())
    ranges = pa.RecordBatch.from_struct_array(places.column("ranges").flatten())
    low, count, path, offset = (ranges.column(c).to_numpy().astype(np.int64) for c in ("low", "count", "path", "offset"))
    source = ranges.column("source_id").dictionary_encode()
    kept = true[place]
    place = place[kept]
    return home[place], first[place] + low[kept], count[kept], source.indices.to_numpy().astype(np.int64)[kept], path[kept], offset[kept], source.dictionary


def long_spans(text: np.ndarray, start: np.ndarray, count: np.ndarray, source: np.ndarray, path: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, source, source start) of maximal spans, by text and start: ranges join where the same path goes on."""
    order = np.lexsort((start, text))
    text, start, count, source, path, offset = (x[order] for x in (text, start, count, source, path, offset))
    far = text * (int((start + count).max(initial=0)) + 1)
    reach = np.maximum.accumulate(far + start + count)
    opens = np.ones(len(text), bool)
    opens[1:] = (far + start)[1:] > reach[:-1]
    for x in (text, source, path, start - offset):
        opens[1:] |= np.diff(x) != 0
    at = np.flatnonzero(opens)
    end = np.maximum.reduceat(start + count, at) if len(at) else np.zeros(0, np.int64)
    return text[at], start[at], end - start[at], source[at], (path + offset)[at]


def keep_first_passages(critiques: DataFrame, words: int = WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """critique_run_id, n_words, n_removed, spans, kept: each critique without what an earlier one says already.

    ``critiques``: critique_run_id (any orderable type; smaller is earlier), text; other columns, of whatever name, are
    ignored. Words are runs without ASCII white space, compared as they are. A window is ``words``
    consecutive words of one text. Every word goes that a window covers which also starts in a text with a smaller
    id, judged on the input. ``kept`` holds the other words joined by one space. ``spans`` lists the long repeated
    spans: start (word number), words, source_id and source_start, where the text with the smallest
    id says the same; spans of different paths may overlap by less than a window.

    Method: windows are the edges of a de Bruijn graph whose nodes are ``words - 1`` words. Windows side by side that share an
    anchor, the ``anchor_words`` words of least hash in them, travel as one piece, so equal windows meet under
    their anchor and keys of one text go before anything else is moved. Pieces are read at their source, the smallest id and
    place. A key with one piece is a nonbranching path; where pieces of a key differ, their windows
    are counted as edges. Paths that follow each other in their source are glued where the node between has
    one edge in and one out, by joins on nodes. Every place of a piece is then compared with the digest of the words at the source's
    coordinates before any word goes, so a clash of hashes removes nothing. Counts are combined before each shuffle,
    and joins on hot keys may be split; no task holds all places of a passage.

    Null or empty texts have no words; texts shorter than a window keep all. Rows with a null id keep everything and
    are no source. Rows that share an id never remove each other, whether their texts are equal or not.
    No critiques give no rows.
    """
    kind = critiques.schema["critique_run_id"].dataType.simpleString()
    critiques = critiques.select("critique_run_id", "text")
    places, pieces = repeated_pieces(critiques, words, anchor_words)
    earlier = F.filter("ranges", lambda r: r["source_id"] < F.col("critique_run_id")).alias("ranges")
    found = places.join(pieces, ["key", "piece"]).select("critique_run_id", "first", "count", "digest", earlier).where(F.size("ranges") > 0)
    found = found.groupBy("critique_run_id").agg(F.collect_list(F.struct("first", "count", "digest", "ranges")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            said = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            *ranges, sources = _verified(said, batch.column("found"), words)
            text, start, count, source, source_start = long_spans(*ranges)
            base = np.cumsum([0, *map(len, said)])
            gone = np.zeros(base[-1] + 1, np.int64)
            np.add.at(gone, base[text] + start, 1)
            np.add.at(gone, base[text] + start + count + words - 1, -1)
            stays = np.cumsum(gone)[:-1] == 0
            n_removed = [int(b - a - stays[a:b].sum()) for a, b in zip(base[:-1], base[1:])]
            kept = [b" ".join([w for w, s in zip(t, stays[a:a + len(t)].tolist()) if s] if n else t).decode() for t, a, n in zip(said, base, n_removed)]
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(count + words - 1), sources.take(pa.array(source)), pa.array(source_start)], ["start", "words", "source_id", "source_start"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([batch.column("critique_run_id"), pa.array(np.diff(base)), pa.array(n_removed, pa.int64()), spans, pa.array(kept, pa.string())],
                                             ["critique_run_id", "n_words", "n_removed", "spans", "kept"])

    return critiques.join(found, "critique_run_id", "left").select("critique_run_id", "text", "found").mapInArrow(
        run, f"critique_run_id {kind}, n_words bigint, n_removed bigint, spans array<struct<start: bigint, words: bigint, source_id: {kind}, source_start: bigint>>, kept string")
