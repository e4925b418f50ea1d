"""Toxicity of critique texts: a learned lexicon met through Levenshtein automata, in context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmgrain.llm.batches import lowered, passed_on, shingle_hashes, slices, span_hashes, text_bytes, word_spans
from filmgrain.llm.shared import hash_sample, stored

SAMPLE = 20_000
MAX_TERMS = 2_000
STEM_CHARS = (3, 4, 5, 6)
WHOLE_CHARS = (4, 24)
MIN_SHARE = 0.004
MIN_CLEAR = 2.5
MIN_EVIDENCE = 18.0
WINDOW = 16
# Words and automaton states that a task remembers; both start over beyond that.
MEMO_SIZE = 100_000
MAX_STATES = 20_000
FEATURES = 8
# A word may hold signs that stand in for letters.
_TOKEN = re.compile(r"[@$]?\w+(?:[@$!]+\w+)*")
_SIGNS = re.compile(r"[@$!]+")
_QUOTES = re.compile("[\"“”«»„]")
# Digits and signs that stand in for letters inside a word.
_FOLD = str.maketrans("013457@$!", "oieastasi")
# Clean words whose likeness to a term means nothing.
MAX_KNOWN = 20_000


def words_of(text: str) -> list[str]:
    """Lower-cased words; digits inside a word that has letters are read as the letters they mimic.
    Signs stay: a word that holds some may be one word or several (``_Values`` tries both)."""
    return [_folded(w) if not _SIGNS.search(w) else w for w in _TOKEN.findall(text.lower())]


def _folded(word: str) -> str:
    return word.translate(_FOLD) if not word.isalpha() and not word.isdigit() else word


def _parts(word: str) -> list[str]:
    """The words between the signs of a word."""
    return [_folded(w) for w in _SIGNS.split(word) if w]


# --- lexicon and automaton ----------------------------------------------------
@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        """Edits a word may be away: one from 4 letters (a stem: from 6, as many words begin almost like
        a shorter one), two from 10."""
        return 0 if len(self.text) < (6 if self.stem else 4) else 1 if len(self.text) < 10 else 2


class Lexicon:
    """A trie of terms walked together with the Levenshtein automaton of the word.

    A state holds (trie node, edits so far) pairs. States and their transitions are made when a
    word first needs them, which turns the product of trie and automata into one
    deterministic automaton: a lookup costs one table access a character. A stem matches a word
    that starts with it. Without ``slips`` the first letter of a word must be right; with them
    it may be edited as any other, and two neighbours swapped are one edit.
    """

    def __init__(self, terms: list[Term], slips: bool = False):
        self.slips = slips
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        self.reach = [0]
        for term in terms:
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(term)
        self.forget()

    def forget(self) -> None:
        """Drops the states made so far; they are made again when needed."""
        # State 0 stands before the first letter; its own number keeps it apart from the dead state.
        self.ids: dict[frozenset, int] = {}
        self.states = [self._closed({0: 0}) if self.slips else frozenset([(0, 0)])]
        self.moves: list[dict[str, int]] = [{}]
        self.stems: list[tuple[float, int]] = [(0.0, 0)]

    def _closed(self, held: dict[int, int]) -> frozenset:
        """Skipping a term's letter costs an edit and no character of the word."""
        todo = [node for node in held if not isinstance(node, tuple)]
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = held[node] + 1
                if edits <= self.reach[child] and edits < held.get(child, 9):
                    held[child] = edits
                    todo.append(child)
        return frozenset(held.items())

    def _move(self, state: int, c: str, first: bool) -> int:
        # (node, letter) stands before the second of two swapped letters.
        held: dict[int | tuple[int, str], int] = {}

        def keep(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < held.get(node, 9):
                held[node] = edits

        if first and not self.slips:
            if c in self.children[0]:
                keep(self.children[0][c], 0)
        else:
            for node, edits in self.states[state]:
                if isinstance(node, tuple):
                    if node[1] == c:
                        keep(node[0], edits)
                    continue
                keep(node, edits + 1)
                for letter, child in self.children[node].items():
                    keep(child, edits + (letter != c))
                    swapped = self.children[child].get(c) if self.slips and letter != c else None
                    if swapped is not None and edits + 1 <= self.reach[swapped]:
                        held[swapped, letter] = min(edits + 1, held.get((swapped, letter), 9))
        made = self._closed(held)
        if made not in self.ids:
            self.ids[made] = len(self.states)
            self.states.append(made)
            self.moves.append({})
            self.stems.append(self._value(made, True))
        return self.ids[made]

    def _value(self, state: frozenset, stem: bool) -> tuple[float, int]:
        """(weight, edits) of the best term that ends in the state; (0, 0) for none."""
        found = [(t.weight / (1 + e), -e) for node, e in state if not isinstance(node, tuple) for t in self.ends[node] if t.stem == stem and e <= t.edits]
        weight, edits = max(found, default=(0.0, 0))
        return weight, -edits

    def value(self, word: str) -> tuple[float, int]:
        if len(self.states) > MAX_STATES:
            self.forget()
        state, best = 0, (0.0, 0)
        for i, c in enumerate(word):
            moves = self.moves[state]
            state = moves[c] if c in moves else moves.setdefault(c, self._move(state, c, not i))
            if not self.states[state]:
                return best
            best = max(best, self.stems[state])
        return max(best, self._value(self.states[state], False))


class _Values(dict):
    """word to its value, remembered up to a bound. A ``known`` clean word isn't a misspelt term."""

    def __init__(self, lexicon: Lexicon, known: frozenset[str] = frozenset()):
        super().__init__()
        self.lexicon, self.known = lexicon, known

    def _found(self, word: str) -> tuple[float, int]:
        weight, edits = self.lexicon.value(word)
        return (0.0, 0) if edits and word in self.known else (weight, edits)

    def __missing__(self, word: str) -> tuple[float, int]:
        if len(self) >= MEMO_SIZE:
            self.clear()
        tried = [word] if not _SIGNS.search(word) else [_folded(word), *_parts(word)]
        self[word] = found = max(map(self._found, tried))
        return found


def features(text: str, values: _Values) -> list[float]:
    """What the classifier sees of a text: how many terms it holds and how heavy they are,
    inside and outside quotations, exact or misspelled, how dense they get in a window of words."""
    words = words_of(text)
    hits = [(i, *v) for i, v in enumerate(map(values.__getitem__, words)) if v[0]]
    if not hits:
        return [0.0] * FEATURES
    quoted = _quoted(text, {i for i, _, _ in hits}) if _QUOTES.search(text) else set()
    plain = [(i, w, e) for i, w, e in hits if i not in quoted]
    exact, close = sum(w for _, w, e in plain if not e), sum(w for _, w, e in plain if e)
    dense, run, left = 0.0, 0.0, 0
    for right, (i, w, _) in enumerate(plain):
        run += w
        while i - plain[left][0] >= WINDOW:
            run -= plain[left][1]
            left += 1
        dense = max(dense, run)
    return [np.log1p(exact), np.log1p(close), max((w for _, w, e in plain if not e), default=0.0), np.log1p(dense), np.log1p(len({words[i] for i, _, _ in plain})),
            np.log1p(sum(w for i, w, _ in hits if i in quoted)), np.log1p(100 * len(plain) / len(words)), float(any(not e for _, _, e in plain))]


def _quoted(text: str, wanted: set[int]) -> set[int]:
    """Which words stand between quotation marks of one line."""
    found, at = set(), 0
    for line in text.lower().split("\n"):
        marks = [m.start() for m in _QUOTES.finditer(line)]
        spans = list(zip(marks[::2], marks[1::2]))
        for m in _TOKEN.finditer(line):
            if at in wanted and any(a < m.start() < b for a, b in spans):
                found.add(at)
            at += 1
    return found


# --- training ---------------------------------------------------------------
@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]
    bias: float
    known: frozenset[str] = frozenset()

    def values(self) -> _Values:
        return _Values(Lexicon(list(self.terms), slips=True), self.known)


def _sampled(critiques: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """text, toxic of at most ``size`` labelled critiques; of a group of copies (equal least
    shingle hash) and label one text stays, so near copies don't pass for evidence either. Texts that share the
    passage with the least shingle fall together too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            data = lowered(data)
            starts, ends, bounds = word_spans(data, offsets)
            least = [int(s.view(np.int64)[0]) if len(s) else 0 for s in shingle_hashes(span_hashes(data, starts, ends), bounds, 5)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(least, pa.int64())], ["text", "toxic", "least"])

    # The sample's size bounds this broadcast.
    wanted = labels.where("toxic is not null and critique_run_id is not null").groupBy("critique_run_id").agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = F.broadcast(hash_sample(wanted, size, "critique_run_id"))
    rows = critiques.where("text is not null").select("critique_run_id", "text").join(wanted, "critique_run_id").select("text", "toxic")
    return stored(rows.mapInArrow(run, "text string, toxic int, least bigint").groupBy("least", "toxic").agg(F.min("text").alias("text")).drop("least"))


def _learned_terms(sample: DataFrame, max_terms: int) -> tuple[Term, ...]:
    """Stems and words that mark toxic texts: found in at least ``MIN_SHARE`` of them (three at
    least), far more often than in others and beyond chance. A word or longer stem whose own stem is as clear is left out
    unless it is long enough to be met misspelled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w for x in words_of(text) for w in _parts(x) if w.isalpha()}
                terms = {w[:n] for w in words for n in STEM_CHARS if len(w) >= n}
                terms |= {w + "$" for w in words if WHOLE_CHARS[0] <= len(w) <= WHOLE_CHARS[1]}
                seen[int(toxic > 0)].update(terms)
        for toxic, found in seen.items():
            rows = [pa.array(list(found), pa.string()), pa.array([n * toxic for n in found.values()], pa.int64()), pa.array([n * (1 - toxic) for n in found.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["term", "bad", "good"])

    total = {r.toxic > 0: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    if not bad or not good:
        return ()
    clear = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counts = sample.mapInArrow(run, "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Twice the log-likelihood ratio against chance: few sightings are no evidence however one-sided.
    share, seen = bad / (bad + good), F.col("bad") + F.col("good")
    gain = lambda n, p: F.when(n > 0, n * F.log(n / (seen * p))).otherwise(0.0)
    evidence = 2 * (gain(F.col("bad"), share) + gain(F.col("good"), 1 - share))
    strong = counts.where(F.col("bad") >= max(3, MIN_SHARE * bad)).where(evidence >= MIN_EVIDENCE).withColumn("clear", clear).where(F.col("clear") >= MIN_CLEAR)
    rows = strong.orderBy(F.desc(F.col("clear") * F.sqrt("bad")), "term").limit(max_terms).collect()
    found = {r.term: r.clear for r in rows}
    kept = []
    for term, weight in found.items():
        text = term.rstrip("$")
        covered = any(found.get(text[:n], 0) >= weight - 0.7 for n in STEM_CHARS if n < len(text))
        if not covered or (term.endswith("$") and len(text) >= WHOLE_CHARS[0]):
            kept.append(Term(text, not term.endswith("$"), float(weight)))
    return tuple(kept)


def _known_words(sample: DataFrame, terms: tuple[Term, ...]) -> frozenset[str]:
    """Words of at least two clean texts that are close to a term and mark toxic texts hardly more than others; at
    most ``MAX_KNOWN``, the most frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _Values(Lexicon(list(terms), slips=True))
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[int(toxic > 0)].update({w for x in words_of(text) for w in _parts(x) if values[w][1]})
        words = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["word", "bad", "good"])

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("bad")).first()
    counts = sample.mapInArrow(run, "word string, bad bigint, good bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    clear = F.log((F.col("bad") + 0.5) / (total.bad + 1)) - F.log((F.col("good") + 0.5) / (total.n - total.bad + 1))
    return frozenset(r.word for r in counts.where("good >= 2").where(clear < 1.0).orderBy(F.desc("good"), "word").limit(MAX_KNOWN).collect())


def _misspelt(text: str, values: _Values) -> str | None:
    """``text`` with two middle letters of each exact term swapped; none when it holds no such word."""
    changed = False

    def swap(m: re.Match) -> str:
        nonlocal changed
        word, k = m[0], len(m[0]) // 2
        if len(word) < WHOLE_CHARS[0] or values[_folded(word)][1] or not values[_folded(word)][0]:
            return word
        changed = True
        return word[:k - 1] + word[k] + word[k - 1] + word[k + 1:]

    text = _TOKEN.sub(swap, text.lower())
    return text if changed else None


def _fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with a squared penalty on the weights."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(full.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train_toxicity(critiques: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """A model learned from at most ``sample`` labelled critiques (those with the smallest hash of the id).

    ``critiques``: critique_run_id, text; ``labels``: critique_run_id, toxic (0 or 1; null: no label).
    The lexicon is counted on the cluster; only its ``max_terms`` terms and the sample's
    feature rows come back. Without labels of both kinds the model has no terms and scores every
    text alike, by the share of toxic labels.
    """
    rows = _sampled(critiques, labels, sample)
    terms = _learned_terms(rows, max_terms)
    if not terms:
        share = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
        p = (share.bad + 0.5) / (share.n + 1)
        return ToxicityModel((), (0.0,) * FEATURES, float(np.log(p / (1 - p))) if share.n else -5.0)

    known = _known_words(rows, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = ToxicityModel(terms, (), 0.0, known).values()
        for batch in batches:
            toxic, found = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                # A row with terms counts once more with them misspelt, so close hits get a weight of their own.
                for t in (text, _misspelt(text, values)):
                    if t is not None:
                        toxic.append(label)
                        found.append(features(t, values))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    seen = rows.mapInArrow(run, "toxic int, x array<double>").groupBy("toxic", "x").count().orderBy("toxic", "x").collect()
    times = [r["count"] for r in seen]
    x, y = np.repeat(np.array([r.x for r in seen]), times, 0), np.repeat(np.array([float(r.toxic > 0) for r in seen]), times)
    weights, bias = _fitted(x, y)
    return ToxicityModel(terms, tuple(weights.tolist()), bias, known)


def score_toxicity(critiques: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """critique_run_id, score, predicted, n_terms: how likely each text is labelled toxic.

    ``critiques``: critique_run_id, text; other columns are ignored. Words are met with the
    model's lexicon by Levenshtein automata over its trie, so misspelled terms count (at a
    lower weight), a wrong first letter and swapped neighbours too; clean words that the training rows know don't.
    Signs inside a word are read as the letters they mimic. Terms inside quotation marks are weighed apart from the others, and the
    densest window of words counts by itself; a logistic regression turns this into a score from 0
    to 1. predicted is 1 from 0.5 on.

    Nothing is shuffled; the model travels with the task and is bounded by its ``max_terms``.
    Null and empty texts have no hits and get the score of a text without any. Repeated rows and null ids each get a row; no critiques give no rows. Columns named in ``carry``
    pass through; one named like a column of the result is replaced by it.
    """
    names = ["critique_run_id", *passed_on(carry, ("critique_run_id", "score", "predicted", "n_terms"))]
    ddl = critiques.select(*names).schema.toDDL()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, weights = model.values(), np.array(model.weights)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            x = np.array([features(t or "", values) for t in texts])
            score = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -30, 30)))
            hits = pa.array([0 if not v[4] else int(round(np.expm1(v[4]))) for v in x.tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), hits], [*names, "score", "predicted", "n_terms"])

    used = critiques.select(*dict.fromkeys([*names, "text"]))
    return used.mapInArrow(run, f"{ddl}, score double, predicted int, n_terms int")
