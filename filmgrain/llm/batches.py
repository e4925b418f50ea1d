"""Texts of one Arrow batch as one byte array, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs stay equal, close ones spread."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BASE = 0x8EBC6AF09C88C6E3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so the texts of each hold about ``chunk_bytes``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text): runs without ASCII white space, cut at text ends."""
    inside = ~SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash alike wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers(_BASE, n), out=total[1:])
    back = _powers(_INVERSE, n + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text. A text with fewer
    words is one shingle; a text without words has none."""
    n, out = len(words), []
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size if n >= size else 0):
        rolled = rolled * np.uint64(0xB5026F5AA96619E9) + words[k:n - size + 1 + k]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = mix(whole * np.uint64(3) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def free_name(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to be none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def passed_on(carry: tuple[str, ...], made: tuple[str, ...]) -> list[str]:
    """The columns of ``carry`` once each, without those that an operator makes itself."""
    taken = {c.lower() for c in made}
    return [c for c in dict.fromkeys(carry) if c.lower() not in taken]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
