"""Critiques that loop: runs of words that repeat with a fixed period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filmgrain.llm.batches import slices, span_hashes, text_bytes, word_spans

LEAST_WORDS = 24
LEAST_TURNS = 3
_RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def frequent_segments(words: np.ndarray, text: np.ndarray, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment of each): the parts of the texts that may hold a run.

    Every word of a run occurs at least ``least_turns`` times in it. A word that occurs less often
    within its segment belongs to no run and splits the segment; the parts are counted again until no
    part splits, and parts below ``least_words`` go. A segment without a split is not counted again.
    """
    _, codes = np.unique(words, return_inverse=True)
    width = int(codes.max(initial=0)) + 1
    place, home, done, names = np.arange(len(words)), text.astype(np.int64), [], 0
    while len(place):
        cut = np.ones(len(place), bool)
        cut[1:] = (np.diff(place) != 1) | (np.diff(home) != 0)
        home = np.cumsum(cut) - 1
        long = (np.bincount(home) >= least_words)[home]
        place, home = place[long], home[long]
        if not len(place):
            break
        _, which, often = np.unique(home * width + codes[place], return_inverse=True, return_counts=True)
        rare = often[which] < least_turns
        split = (np.bincount(home, rare) > 0)[home]
        done.append((place[~split], home[~split] + names))
        names += int(home[-1]) + 1
        keep = split & ~rare
        place, home = place[keep], home[keep]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, home = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(place)
    return place[order], home[order]


def lag_scan(words: np.ndarray, segment: np.ndarray, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, period): all runs within segments, positions as in ``words``.

    A window of k words inside a run of smallest period q <= k comes again exactly q words on and
    not before. So for k = 1, 2, 4, ... each window's lag to its next equal one is taken, and windows side by side
    with one lag between k / 2 and k are a run. Windows that occur once are dropped before k
    doubles, as no longer window around them comes again.
    """
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    name = np.full(n, -1, np.int64)
    at = np.arange(n)
    _, codes = np.unique(words, return_inverse=True)
    pair = segment * (int(codes.max(initial=0)) + 1) + codes
    k = 1
    while len(at):
        _, names, often = np.unique(pair, return_inverse=True, return_counts=True)
        again = often[names] > 1
        at, names = at[again], names[again]
        name[:] = -1
        name[at] = names
        order = np.argsort(names, kind="stable")
        lag = np.zeros(len(at), np.int64)
        same = names[order][1:] == names[order][:-1]
        lag[order[:-1][same]] = (at[order][1:] - at[order][:-1])[same]
        hit = np.flatnonzero((2 * lag > k) & (lag <= k))
        if len(hit):
            first, q = at[hit], lag[hit]
            cut = np.concatenate([[0], np.flatnonzero((np.diff(first) != 1) | (np.diff(q) != 0)) + 1, [len(hit)]])
            low, period = first[cut[:-1]], q[cut[:-1]]
            length = first[cut[1:] - 1] - low + period + k
            good = length >= np.maximum(least_words, least_turns * period)
            found.append((low[good], length[good], period[good]))
        reach = at[at + k < n]
        reach = reach[(name[reach + k] >= 0) & (segment[reach] == segment[np.minimum(reach + k, n - 1)])]
        pair = name[reach] * (int(names.max(initial=0)) + 1) + name[reach + k]
        at, k = reach, 2 * k
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most turns, compared as whole numbers; runs come by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_loops(critiques: DataFrame, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """critique_run_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed: where each critique
    says the same again and again, and its text without the repetition.

    ``critiques``: critique_run_id (any type), text; other columns, of whatever name, are ignored. Words
    are runs without ASCII white space, compared as they are and numbered from 0. A run is a stretch with smallest period
    q (words q apart are equal) of at least ``least_words`` and ``least_turns * q`` words
    that no neighbouring word extends with period q; ``least_turns`` is 2 or more. ``runs`` holds every run by start, then
    period; start, length and period are those of the run with the greatest length / period (ties: smallest start, then
    period) and exponent_milli is floor(1000 * length / period). ``collapsed`` is the text
    without the words that follow the first q of any run, words joined by one space.

    Method: recursive frequency splitting, then a lag scan of what is left (``frequent_segments``, ``lag_scan``).
    Each critique is judged by itself and whole: no shuffle, no hot key; a task holds about a megabyte of texts
    or one longer text. Words are told apart by 64-bit hashes.

    Null texts count as empty: no words, no runs, four nulls and an empty ``collapsed``. Null ids and repeated
    rows each get a row. No critiques give no rows.
    """
    kind = critiques.schema["critique_run_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, bounds = word_spans(data, offsets)
            words = span_hashes(data, starts, ends)
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            place, segment = frequent_segments(words, text, least_words, least_turns)
            first, length, period = lag_scan(words[place], segment, least_words, least_turns)
            first = place[first]
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, first + period, 1)
            np.add.at(gone, first + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            own = text[first]
            cuts = np.searchsorted(own, np.arange(batch.num_rows + 1))
            triples = list(zip((first - bounds[own]).tolist(), length.tolist(), period.tolist()))
            runs = [triples[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            best = [_greatest(r) for r in runs]
            collapsed = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                said = (t or "").encode().split()
                if runs[i]:
                    said = [w for w, k in zip(said, kept[bounds[i]:bounds[i + 1]].tolist()) if k]
                collapsed.append(b" ".join(said).decode())
            of_best = [[b and b[n] for b in best] for n in range(3)]
            yield pa.RecordBatch.from_arrays([
                batch.column("critique_run_id"), pa.array(np.diff(bounds)), pa.array([len(r) for r in runs], pa.int64()), *(pa.array(c, pa.int64()) for c in of_best),
                pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array(collapsed, pa.string())],
                ["critique_run_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    return critiques.select("critique_run_id", "text").mapInArrow(
        run, f"critique_run_id {kind}, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs {_RUN}, collapsed string")
