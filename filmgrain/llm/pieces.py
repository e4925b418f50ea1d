"""SentencePiece encoding and decoding: an automaton over the pieces drives one Viterbi pass."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filmgrain.llm.batches import list_column, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed value: an unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0
MEMO_CHARS = 64
MEMO_SIZE = 100_000


def load_pieces(path: str = MODEL) -> tuple[dict[str, tuple[int, float]], list[int]]:
    """(piece to id and score, ids of the 256 byte pieces) of a model file. Control and unknown
    pieces are left out: text never turns into them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known, raw = {}, [-1] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            known[piece] = (i, model.get_score(i))
    if min(raw) < 0:
        raise ValueError("the model has no byte pieces, so not every text could be decoded again")
    return known, raw


class Encoder:
    """Best-scoring segmentation of texts into pieces."""

    def __init__(self, known: dict[str, tuple[int, float]], raw: list[int]):
        self.raw, self.unknown = raw, min(score for _, score in known.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in known.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        # A blank mark starts a piece or fills it, so texts may be cut before one that follows other characters.
        cut = not any(SPACE in p.lstrip(SPACE) for p in known)
        lone = not any("\n" in p for p in known)
        self.cutter = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if cut and lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cut else "(?s).+")
        self.singles = {p for p in known if len(p) == 1}
        self.memo: dict[str, array] = {}

    def _segments(self, text: str) -> array:
        """``_best`` for a text whose characters all are pieces, where no unknown one has to be weighed."""
        n = len(text)
        score, back, ids = [0.0] + [-1e300] * n, [0] * (n + 1), [0] * (n + 1)
        for end, (length, i, gain) in self.automaton.iter(text):
            end += 1
            total = score[end - length] + gain
            if total > score[end]:
                score[end], back[end], ids[end] = total, end - length, i
        out = []
        while n:
            out.append(ids[n])
            n = back[n]
        out.reverse()
        return array("i", out)

    def _best(self, text: str) -> array:
        """One pass: each match the automaton reports at a position relaxes that position."""
        n = len(text)
        score, back = [-1e300] * (n + 1), [(0, -1)] * (n + 1)
        score[0], at = 0.0, 0
        matches = self.automaton.iter(text)
        coming = next(matches, None)
        for at in range(n):
            single = False
            while coming is not None and coming[0] == at:
                length, i, gain = coming[1]
                single |= length == 1
                total = score[at + 1 - length] + gain
                if total > score[at + 1]:
                    score[at + 1], back[at + 1] = total, (at + 1 - length, i)
                coming = next(matches, None)
            if not single and score[at] + self.unknown > score[at + 1]:
                score[at + 1], back[at + 1] = score[at] + self.unknown, (at, -1)
        parts, at = [], n
        while at:
            start, i = back[at]
            parts.append([i] if i >= 0 else self._bytes(text[start:at]))
            at = start
        return array("i", [i for part in reversed(parts) for i in part])

    def _bytes(self, text: str) -> list[int]:
        return [self.raw[b] for b in text.encode()]

    def encode(self, text: str) -> array:
        """Piece ids. A blank goes in front of a text that isn't empty, as the model's own rule has it; a blank mark
        that stands in the text itself is spelled in bytes, so decoding gives it back."""
        out = array("i")
        if not text:
            return out
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.extend(self._bytes(SPACE))
            for piece in self.cutter.findall((SPACE if not k else "") + part.replace(" ", SPACE)):
                ids = self.memo.get(piece)
                if ids is None:
                    ids = self._segments(piece) if self.singles.issuperset(piece) else self._best(piece)
                    if len(piece) <= MEMO_CHARS:
                        if len(self.memo) >= MEMO_SIZE:
                            self.memo.clear()
                        self.memo[piece] = ids
                out.extend(ids)
        return out


def encode_texts(critiques: DataFrame, vocabulary: tuple[dict[str, tuple[int, float]], list[int]]) -> DataFrame:
    """``critiques`` with piece_ids array<int> added (one of that name is replaced).

    ``critiques``: critique_run_id, text and further columns, which pass through. ``vocabulary``
    comes from ``load_pieces``; its size is that of the model file, so it travels with the task.

    Method: an Aho-Corasick automaton over all pieces reads the text once and reports, through
    its output links, every piece that ends at a position; each relaxes the best score there
    (longest first, so ties go to the longer last piece). A character without a piece of its
    own may be spelled in byte pieces at a score below every piece. Scores are the model's;
    for a merge-ranked vocabulary the result is the best-scoring segmentation, not the merge
    order's. Texts are cut where no piece can reach across, and results for short cuts are remembered in a
    table of bounded size.

    Null and empty texts give an empty list. Every text is encoded whole.
    """
    wide = [c for c in critiques.columns if c != "piece_ids"]
    known, raw = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(known, raw)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(encoder.encode(t or ""), np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in wide), list_column(ids, pa.int32())], [*wide, "piece_ids"])

    df = critiques.select(*wide)
    return df.mapInArrow(run, f"{df.schema.toDDL()}, piece_ids array<int>")


def decode_texts(encoded: DataFrame, vocabulary: tuple[dict[str, tuple[int, float]], list[int]], column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece_ids in ``column``: pieces joined, byte pieces put
    together to characters, blank marks turned to blanks and the blank in front taken off. Null lists give empty
    texts; an id that is no piece of the vocabulary is an error."""
    wide = [c for c in encoded.columns if c != column]
    known, raw = vocabulary
    spelled = {i: piece.replace(SPACE, " ").encode() for piece, (i, _) in known.items()} | {i: bytes([b]) for b, i in enumerate(raw)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = spelled.__getitem__
        for batch in batches:
            lists = batch.column("piece_ids")
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [b"".join(map(get, flat[a:b].tolist()))[1:].decode() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in wide), pa.array(texts, pa.string())], [*wide, column])

    df = encoded.select(*wide)
    return df.mapInArrow(run, f"{df.schema.toDDL()}, {column} string")
