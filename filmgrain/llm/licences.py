"""Licence notices in critique texts: a trained classifier of lines and windows, confirmed by templates."""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmgrain.llm.batches import lowered, mix, slices, span_hashes, text_bytes, word_spans
from filmgrain.llm.shared import hash_sample

# Notices by which licences are commonly given, as (family, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "This software is released under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
)
NONE, UNKNOWN = "none", "unknown"
FEATURE_BITS = 16
GRAMS = 3
COPIES = 40
NEGATIVES = 4_000
CONFIRM = 0.8
SEED = 7
# Words whose windows are scored at one go.
CHUNK_WORDS = 1 << 16
# A dash at the end of a line, with the comment marks that the next line begins with.
_WRAPPED_DASH = re.compile(r"(?<=\w)-\s*\n\W*(?=\w)")
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, ends, words before each paragraph, feature numbers of the 1- to 3-word runs by their first word)."""
    data = lowered(data)
    # Anything in ASCII that is neither letter, digit, dot nor dash parts words.
    keep = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data == 45) | (data == 46)
    starts, ends, bounds = word_spans(np.where(keep, data, 32).astype(np.uint8), offsets)
    ends = ends - (data[ends - 1] == 46) if len(ends) else ends
    ends = np.maximum(ends, starts)
    rolled = words = span_hashes(data, starts, ends)
    parts = [words]
    for n in range(1, GRAMS):
        rolled = mix(rolled[:-1] * np.uint64(0x9FB21C651E98DF25) + words[n:])
        parts.append(rolled)
    return starts, ends, bounds, [(p >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) for p in parts]


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, bounds per paragraph) of the 1- to 3-word runs of each paragraph, as far
    as they don't cross its ends."""
    _, _, bounds, runs = _runs(data, offsets)
    home = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    parts, homes = [runs[0]], [home]
    for n in range(1, GRAMS):
        inside = home[n:] == home[:-n] if len(home) > n else np.zeros(0, bool)
        parts.append(runs[n][inside] if len(home) > n else runs[n][:0])
        homes.append(home[:-n][inside] if len(home) > n else home[:0])
    marks, homes = np.concatenate(parts), np.concatenate(homes)
    order = np.argsort(homes, kind="stable")
    return marks[order], np.searchsorted(homes[order], np.arange(len(bounds)))


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive bounds; empty runs give zeros."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, 0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _sums_between(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` from each ``first`` up to its ``end``."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, 0, out=total[1:])
    # A run that would begin past the last row is empty.
    return total[np.minimum(end, len(values))] - total[np.minimum(first, len(values))]


def _window_sizes(templates: tuple[tuple[str, str], ...]) -> list[int]:
    """Words of a window, ascending: those of the longest template, halved as long as the shortest one fits."""
    words = [len(_WORD.findall(text.lower())) for _, text in templates]
    sizes = [max(words, default=1) or 1]
    while sizes[0] // 2 >= max(min(words, default=1), 1):
        sizes.insert(0, sizes[0] // 2)
    return sizes


def _pair_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text, hash of each word and the next): words as in
    ``word_pairs``, but cut at dashes, where lines may end."""
    data = lowered(data)
    plain = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    inner = data == 46
    inner[1:] &= plain[:-1]
    inner[:-1] &= plain[1:]
    # A dot at either end of a text is outside its words.
    full = offsets[1:] > offsets[:-1]
    inner[offsets[:-1][full]] = inner[offsets[1:][full] - 1] = False
    starts, ends, bounds = word_spans(np.where(plain | inner, data, 32).astype(np.uint8), offsets)
    words = span_hashes(data, starts, ends)
    return starts, ends, bounds, mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])


def _fullest(at: list[int], pairs: list[int], need: float, reach: int) -> list[tuple[int, int, int]]:
    """(different pairs, first, last) of the shortest runs within ``reach`` words that hold ``need`` different pairs."""
    out, left, seen = [], 0, {}
    for right, pair in enumerate(pairs):
        seen[pair] = seen.get(pair, 0) + 1
        while at[right] - at[left] >= reach or seen[pairs[left]] > 1:
            seen[pairs[left]] -= 1
            if not seen[pairs[left]]:
                del seen[pairs[left]]
            left += 1
        if len(seen) >= need:
            out.append((len(seen), at[left], at[right]))
    return out


def passages(data: np.ndarray, offsets: np.ndarray, templates: tuple[tuple[str, str], ...], confirm: float) -> list[tuple[int, int, str]]:
    """(first byte, end, family) wherever a stretch of a block holds ``confirm`` of a template's word pairs within
    twice the template's words. Of stretches that overlap the one held most fully stays, then the longest template's."""
    starts, ends, bounds, pairs = _pair_hashes(data, offsets)
    own = [_pair_hashes(*_packed([text]))[3] for _, text in templates]
    table = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
    if not len(pairs) or not len(table):
        return []
    home = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.minimum(np.searchsorted(table, pairs), len(table) - 1)
    hits = np.flatnonzero((table[place] == pairs) & (home[1:] == home[:-1]))
    # Blocks are set apart, so no stretch crosses their ends.
    apart = 2 * max(len(p) for p in own) + 8
    where, place = hits + home[hits] * apart, place[hits]
    found = []
    for (family, _), mine in zip(templates, own):
        total, reach = len(np.unique(mine)), 2 * (len(mine) + 1)
        some = np.isin(place, np.searchsorted(table, mine))
        at, need = where[some], int(np.ceil(confirm * total - 1e-9))
        if not need or len(at) < need or (at[need - 1:] - at[:len(at) - need + 1]).min() >= reach:
            continue
        for n, first, last in _fullest(at.tolist(), place[some].tolist(), need, reach):
            found.append((n / total, total, first - last, first, last, family))
    taken, firsts, out = [], [], []
    for _, _, _, first, last, family in sorted(found, reverse=True):
        k = bisect.bisect_left(firsts, first)
        if (k and taken[k - 1][1] >= first - 1) or (k < len(taken) and taken[k][0] <= last + 1):
            continue
        firsts.insert(k, first)
        taken.insert(k, (first, last))
        a, b = (int(hits[np.searchsorted(where, x)]) for x in (first, last))
        out.append((int(starts[a]), int(ends[b + 1]), family))
    return sorted(out)


def word_pairs(text: str) -> set[tuple[str, ...]]:
    words = _WORD.findall(text.lower())
    return set(zip(words, words[1:])) or {tuple(words)} if words else set()


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    heat: float
    bound: float
    templates: tuple[tuple[str, str], ...]

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A calibrated probability for each paragraph and class."""
        marks, bounds = _grams(data, offsets)
        out = np.empty((len(bounds) - 1, len(self.classes)))
        for at in range(0, len(out), 2048):
            some = bounds[at:at + 2049]
            logits = _sums(self.weights[marks[some[0]:some[-1]]], some - some[0])
            logits = (logits / np.sqrt(np.maximum(np.diff(some), 1))[:, None] + self.bias) / self.heat
            grown = np.exp(logits - logits.max(1, keepdims=True))
            out[at:at + 2048] = grown / grown.sum(1, keepdims=True)
        return out

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, first byte, end, probability of no licence) of overlapping windows over each block.

        The longest window has the words of the longest template, each shorter one half as many, as long as the
        shortest template fits. Windows start every half window and the last one ends with the block, so all words are covered.
        """
        starts, ends, bounds, runs = _runs(data, offsets)
        size, sizes = np.diff(bounds), _window_sizes(self.templates)
        parts = []
        for below, n in zip([0, *sizes], sizes):
            some = np.flatnonzero(size > below)
            spare, step = np.maximum(size[some] - n, 0), max(n // 2, 1)
            count = -(-spare // step) + 1
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            first = np.repeat(bounds[some], count) + np.minimum(turn * step, np.repeat(spare, count))
            parts.append((np.repeat(some, count), first, first + np.repeat(np.minimum(size[some], n), count)))
        block, first, last = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(first, kind="stable")
        block, first, last = block[order], first[order], last[order]
        none = np.empty(len(first))
        for at in range(0, len(starts), CHUNK_WORDS):
            a, b = np.searchsorted(first, (at, at + CHUNK_WORDS))
            until = at + CHUNK_WORDS + max(sizes)
            logits, grams = np.zeros((b - a, len(self.classes))), np.zeros(b - a, np.int64)
            for n, marks in enumerate(runs):
                end = np.maximum(last[a:b] - n, first[a:b])
                logits += _sums_between(self.weights[marks[at:until]], first[a:b] - at, end - at)
                grams += end - first[a:b]
            logits = (logits / np.sqrt(np.maximum(grams, 1))[:, None] + self.bias) / self.heat
            grown = np.exp(logits - logits.max(1, keepdims=True)) if b > a else logits
            none[a:b] = grown[:, 0] / grown.sum(1)
        return block, starts[first], ends[last - 1], none


def _variants(templates: tuple[tuple[str, str], ...], fillers: list[str], rng: random.Random) -> list[tuple[str, str]]:
    """Each template as it is and in disturbed copies: words lost or doubled, other case, text
    of the corpus before or behind."""
    out = []
    for family, text in templates:
        out.append((family, text))
        for _ in range(COPIES):
            words = [w for w in text.split() if rng.random() > 0.06] or text.split()
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words) + 1), rng.choice(words))
            if fillers and rng.random() < 0.4:
                extra = rng.choice(fillers).split()[:rng.randrange(1, 9)]
                words = extra + words if rng.random() < 0.5 else words + extra
            copy = " ".join(words)
            out.append((family, rng.choice((copy, copy, copy.lower(), copy.upper()))))
    return out


def train_licences(critiques: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, negatives: int = NEGATIVES, seed: int = SEED) -> LicenceModel:
    """A model of the templates' families against ordinary paragraphs.

    Positive rows are disturbed copies of the templates. Negative rows are at most ``negatives``
    lines from as many of ``critiques`` (smallest hashes) that share under half of every template's word pairs, and a window of words
    of each. Three
    quarters fit a logistic regression on hashed 1- to 3-word runs; the rest set the
    temperature of the probabilities and the bound under which a notice counts as unknown:
    half way from the highest family probability of an ordinary paragraph to 1, and 0.5 at least.
    """
    some = hash_sample(critiques.where("text is not null").select("critique_run_id", "text"), negatives, "critique_run_id", "text")
    lines = some.select("critique_run_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    found = sorted({r.line for r in lines.orderBy(F.xxhash64("critique_run_id", "line"), "line").select("line").limit(negatives).collect()})
    pairs = [word_pairs(t) for _, t in templates]
    plain = [x for x in found if all(2 * len(p & mine) < len(p) for mine in [word_pairs(x)] for p in pairs)]
    rng = random.Random(seed)
    classes = (NONE, *sorted({f for f, _ in templates}))
    rows = _variants(templates, plain, rng) + [(NONE, x) for x in plain] + [(NONE, "")]
    # Windows of ordinary text, across the ends of lines too.
    for line in plain:
        words, n = f"{line} {rng.choice(plain)}".split(), rng.choice(_window_sizes(templates))
        first = rng.randrange(max(len(words) - n, 0) + 1)
        rows.append((NONE, " ".join(words[first:first + n])))
    rng.shuffle(rows)
    cut = len(rows) * 3 // 4
    kinds = np.array([classes.index(f) for f, _ in rows])
    marks, bounds = _grams(*_packed([t for _, t in rows]))
    scale = 1 / np.sqrt(np.maximum(np.diff(bounds), 1))
    model = LicenceModel(classes, np.zeros((1 << FEATURE_BITS, len(classes))), np.zeros(len(classes)), 1.0, 0.5, tuple(templates))
    own, last = marks[:bounds[cut]], bounds[:cut + 1]
    used, local = np.unique(own, return_inverse=True)
    target = np.eye(len(classes))[kinds[:cut]]
    w, b = np.zeros((len(used), len(classes))), np.zeros(len(classes))
    seen_w, seen_b = np.full(w.shape, 1e-6), np.full(b.shape, 1e-6)
    home = np.repeat(np.arange(cut), np.diff(last))
    order = np.argsort(local, kind="stable")
    ends = np.searchsorted(local[order], np.arange(len(used) + 1))
    for _ in range(60):
        logits = _sums(w[local], last) * scale[:cut, None] + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        miss = p / p.sum(1, keepdims=True) - target
        grad_w = _sums((miss * scale[:cut, None])[home][order], ends) + 1e-3 * w
        grad_b = miss.sum(0)
        seen_w += grad_w ** 2
        seen_b += grad_b ** 2
        w -= 0.5 * grad_w / np.sqrt(seen_w)
        b -= 0.5 * grad_b / np.sqrt(seen_b)
    model.weights[used] = w
    rest, truth = [t for _, t in rows[cut:]], kinds[cut:]
    heats = (0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.5)
    losses = []
    for heat in heats:
        chances = LicenceModel(classes, model.weights, b, heat, 0.5, model.templates).chances(*_packed(rest))
        losses.append(-np.log(np.maximum(chances[np.arange(len(truth)), truth], 1e-12)).mean())
    heat = heats[int(np.argmin(losses))]
    chances = LicenceModel(classes, model.weights, b, heat, 0.5, model.templates).chances(*_packed(rest))
    top = float(chances[truth == 0][:, 1:].max(initial=0.0))
    return LicenceModel(classes, model.weights, b, heat, max(0.5, (1 + min(top, 1.0)) / 2 if top > 0.5 else 0.5), model.templates)


def scan_licences(critiques: DataFrame, model: LicenceModel, confirm: float = CONFIRM) -> DataFrame:
    """critique_run_id, n_paragraphs, licences, n_unknown, score: the licence notices of each text.

    ``critiques``: critique_run_id, text; other columns are ignored. n_paragraphs counts the lines that aren't
    blank; lines without a blank one between them make a block. The classifier gives each line, and overlapping windows over the words of each
    block, a probability for every family and for no licence. A notice may stand on one line, run across several, or
    stand inside a longer line:

    * A line with the highest probability for a family, at or above the model's bound, is confirmed when it holds
      ``confirm`` of the word pairs of one of the family's templates.
    * A stretch of a block that holds as much of a template within twice its words is scored by itself and
      confirmed in the same way (``passages``).

    Of several such templates the one that is held most fully decides, then the longest, so a short notice inside
    a longer one of another family can't win. What looks like a licence but isn't confirmed counts as unknown unless it
    overlaps a confirmed notice: each such line, and each run of overlapping windows away from those lines.
    ``licences`` is sorted and distinct; ``score`` is the highest probability of any licence in the text (0 without paragraphs).

    Nothing is shuffled; the model's size is fixed by its feature table. Null, empty and blank
    texts have no paragraphs. Repeated rows and null ids each get a row; whole texts are read.
    """
    kind = critiques.schema["critique_run_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(family, word_pairs(text)) for family, text in model.templates]

        def confirmed(text: str, chances: np.ndarray) -> str | None:
            pairs, best = word_pairs(text), int(chances[1:].argmax()) + 1
            held = [(len(p & pairs) / len(p), len(p), family) for family, p in known if len(p & pairs) >= confirm * len(p)]
            return model.classes[best] if held and max(held)[2] == model.classes[best] and chances[best] >= model.bound else None

        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            lines, blocks, block_of, text_of = [], [], [], []
            n, families, unknown, score = [0] * len(texts), [set() for _ in texts], [0] * len(texts), [0.0] * len(texts)
            for row, text in enumerate(texts):
                for filled, group in groupby((text or "").split("\n"), lambda x: bool(x.strip())):
                    if filled:
                        own = list(group)
                        lines += own
                        block_of += [len(blocks)] * len(own)
                        text_of.append(row)
                        blocks.append("\n".join(own))
                        n[row] += len(own)
            # All places below are bytes of the joined blocks; a block has a line end between its lines only.
            _, ends = packed = _packed(lines)
            starts = ends[:-1] + np.arange(len(lines)) - np.array(block_of, np.int64)
            joined = _packed(blocks)
            chances = model.chances(*packed)
            for i, p in enumerate((1 - chances[:, 0]).tolist()):
                row = text_of[block_of[i]]
                score[row] = max(score[row], p)
            sure, likely = [], []
            for i in np.flatnonzero(chances[:, 0] < 0.5).tolist():
                row, place = text_of[block_of[i]], (int(starts[i]), int(starts[i] + ends[i + 1] - ends[i]))
                family = confirmed(lines[i], chances[i])
                if family:
                    families[row].add(family)
                    sure.append(place)
                else:
                    likely.append((*place, row))
            stretches = passages(*joined, model.templates, confirm)
            held = [_WRAPPED_DASH.sub("-", joined[0][a:b].tobytes().decode()) for a, b, _ in stretches]
            homes = np.searchsorted(joined[1], [a for a, _, _ in stretches], "right") - 1
            doubtful = []
            for (a, b, family), p, home in zip(stretches, model.chances(*_packed(held)), homes.tolist()):
                row, best = text_of[home], int(p[1:].argmax()) + 1
                score[row] = max(score[row], float(1 - p[0]))
                if p[0] < 0.5 and model.classes[best] == family and p[best] >= model.bound:
                    families[row].add(family)
                    sure.append((a, b))
                elif p[0] < 0.5:
                    doubtful.append((a, b, row))
            home, first, last, none = model.windows(*joined)
            for k in np.flatnonzero(none < 0.5).tolist():
                doubtful.append((int(first[k]), int(last[k]), text_of[home[k]]))
            for row, p in zip(np.array(text_of, np.int64)[home].tolist(), (1 - none).tolist()):
                score[row] = max(score[row], p)
            sure = _Places(sure)
            likely = [x for x in likely if not sure.meet(*x[:2])]
            for _, _, row in likely:
                unknown[row] += 1
            near, end = _Places([x[:2] for x in likely]), -1
            for a, b, row in sorted(doubtful):
                if not sure.meet(a, b) and not near.meet(a, b):
                    unknown[row] += a >= end
                    end = max(end, b)
            yield pa.RecordBatch.from_arrays([batch.column("critique_run_id"), pa.array(n, pa.int32()), pa.array([sorted(f) for f in families], pa.list_(pa.string())), pa.array(unknown, pa.int32()), pa.array(score, pa.float64())],
                                             ["critique_run_id", "n_paragraphs", "licences", "n_unknown", "score"])

    return critiques.select("critique_run_id", "text").mapInArrow(run, f"critique_run_id {kind}, n_paragraphs int, licences array<string>, n_unknown int, score double")


class _Places:
    """Spans of bytes, merged where they overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meet(self, a: int, b: int) -> bool:
        """Whether one of the spans overlaps a to b."""
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b
