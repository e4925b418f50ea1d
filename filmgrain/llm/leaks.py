"""Benchmark passages inside critique texts: pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmgrain.llm.batches import free_name, passed_on, slices

PERCENT = 5
# Below so many characters an item is found exactly and between word ends only.
WORD_CHARS = 12
BLOCK_CHARS = 8 << 20


def plain(text: str | None) -> str:
    """Lower case with every run of white space as one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in ``budget + 1`` near-equal pieces. With at most ``budget``
    edits one piece stays whole."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance_within(item: str, text: str) -> int:
    """The least edit distance between ``item`` and any part of ``text``, a bit per character
    of the item (Myers 1999)."""
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score = full, 0, len(item)
    least = score
    for c in text:
        same = places.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        score += bool(rise & last) - bool(fall & last)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        if score < least:
            least = score
            if not least:
                break
    return least


class Searcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, str]], percent: int, word_chars: int = WORD_CHARS):
        self.items = [(item_id, item, len(item) * percent // 100 if len(item) >= word_chars else None) for item_id, item in items]
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, budget) in enumerate(self.items):
            for offset, piece in pieces(item, budget or 0):
                held.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item_id to its least distance, for items within their budget."""
        windows: dict[int, list[list[int]]] = {}
        found: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                _, item, budget = self.items[n]
                start = end + 1 - length - offset
                if budget is None:
                    if not (start and text[start - 1].isalnum() and item[0].isalnum() or text[end + 1:end + 2].isalnum() and item[-1].isalnum()):
                        found[self.items[n][0]] = 0
                    continue
                low, high = max(0, start - budget), start + len(item) + budget
                runs = windows.setdefault(n, [])
                # Hits come in text order by their ends, so overlapping windows merge into the last one.
                if runs and low <= runs[-1][1]:
                    runs[-1] = [min(low, runs[-1][0]), max(high, runs[-1][1])]
                else:
                    runs.append([low, high])
        for n, runs in windows.items():
            item_id, item, budget = self.items[n]
            for low, high in runs:
                least = distance_within(item, text[low:high])
                if least <= budget:
                    found[item_id] = min(least, found.get(item_id, least))
                    if not least:
                        break
        return found


def find_leaks(critiques: DataFrame, benchmark: DataFrame, percent: int = PERCENT, word_chars: int = WORD_CHARS,
               block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """critique_run_id, item_ids, least_distance, leaked: the benchmark passages in each text.

    ``critiques``: critique_run_id, text; ``benchmark``: item_id bigint, text; other columns are
    ignored. Both are lower-cased and white space is folded. A text holds an item when some
    part of it is within ``percent`` of a hundredth of the item's characters in edits (insert, delete,
    replace; rounded down, so an item below 20 characters is found exactly at the default). An item with fewer than ``word_chars`` folded
    characters is found exactly where it doesn't begin or end inside a longer word. ``item_ids`` is sorted; ``least_distance`` is null when nothing leaked.

    Method: an item with budget k is cut into k + 1 pieces, so one piece of a true match is
    untouched; one automaton finds all exact piece hits in one pass over the text, and the
    window around a hit is verified by Myers' bit-parallel distance. Items travel with the
    task in blocks of ``block_chars`` characters, a measured bound; a larger benchmark takes several passes.
    Texts are not shuffled, so no key is hot.

    Items that are null or blank name no passage. Null or
    empty texts hold nothing. Repeated items of one id count once, repeated texts and null ids
    each get a row. Every text is searched whole. Columns named in ``carry`` pass through; one named like
    a column of the result is replaced by it. No critiques give no rows, no items give no leaks.
    """
    carry = passed_on(carry, ("critique_run_id", "item_ids", "least_distance", "leaked"))
    folded = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    total = folded.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // block_chars))
    critiques = critiques.select("critique_run_id", "text", *(c for c in carry if c != "text"))
    names = critiques.columns
    held = free_name("_found", names)
    ddl = critiques.schema.toDDL()

    def one(part: int) -> list[tuple[int, str]]:
        rows = folded.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == part).collect()
        return [(r.item_id, p) for r in rows if (p := plain(r.text))]

    def searched(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        """The rows with what this block adds to their items so far."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items, percent, word_chars)
            for batch in slices(batches, "text"):
                out = []
                for text, old in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist()):
                    found = dict(old)
                    for item, least in searcher.find(plain(text)).items():
                        found[item] = min(least, found.get(item, least))
                    out.append(sorted(found.items()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.map_(pa.int64(), pa.int32()))], [*names, held])

        return rows.mapInArrow(run, f"{ddl}, {held} map<bigint,int>")

    rows = critiques.withColumn(held, F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<int>")))
    for part in range(blocks):
        items = one(part)
        if items:
            rows = searched(rows, items)
    found = F.map_keys(held)
    return rows.select("critique_run_id", *carry, F.array_sort(found).alias("item_ids"), F.array_min(F.map_values(held)).alias("least_distance"), (F.size(found) > 0).alias("leaked"))
