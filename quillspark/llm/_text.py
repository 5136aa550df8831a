"""Vectorised words and hashes of whole UTF-8 texts, for use inside Arrow tasks.

A text column is taken as the bytes it already is: a batch is walked in slices
of about ``SLICE_BYTES`` so that the numpy arrays of a task stay small however
long the texts or the Arrow batches are. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words of digits, ASCII lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE = seeds(256, 11)
_GRAM = seeds(64, 12)
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 256), _BASE)
        full[0] = 1
        _powers = np.cumprod(full)
    return _powers


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of rows of about ``size`` bytes; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses a row's end."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    lens = ends - starts
    out = np.zeros(len(starts), dtype=np.uint64)
    # about ``SLICE_BYTES`` of words at a time: a long text stands alone in its slice
    edges = np.searchsorted(np.cumsum(lens), np.arange(SLICE_BYTES, int(lens.sum()), SLICE_BYTES)) if len(lens) else []
    for low, high in zip([0, *edges], [*edges, len(lens)], strict=True):
        if low == high:
            continue
        own = lens[low:high]
        first = np.concatenate(([0], np.cumsum(own)[:-1]))
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        taken = data[place + np.repeat(starts[low:high], own)]
        sums = np.add.reduceat(_BYTE[taken] * powers(int(own.max()))[place], first)
        out[low:high] = mix(sums + own.astype(np.uint64))
    return out


def gram_hashes(hashes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of each run of ``k`` consecutive hashes; one for each start that has ``k``, or for each of the starts ``at``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    run = (lambda j: hashes[j : j + n]) if at is None else (lambda j: hashes[at + j])
    total = run(0) * _GRAM[0]
    for j in range(1, k):
        total = total + run(j) * _GRAM[j]
    return mix(total + np.uint64(k))


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[start : start + len] of each, one after another."""
    total = int(lens.sum())
    shift = starts - (np.cumsum(lens) - lens)
    return values[np.repeat(shift, lens) + np.arange(total)] if total else values[:0]


def distinct_words(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence of each distinct word, which of them each occurrence is)."""
    _, entry, which = np.unique(word_hashes(data, starts, starts + lens), return_index=True, return_inverse=True)
    wrong = np.flatnonzero(lens != lens[entry][which])
    rest = np.flatnonzero(lens == lens[entry][which])
    # equal hashes are not yet equal words: compare, a few megabytes at a time
    ends = np.cumsum(lens[rest])
    edges = np.append(np.searchsorted(ends, np.arange(0, int(lens[rest].sum()), 4 * SLICE_BYTES)), len(rest))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        part = rest[low:high]
        if len(part):
            same = gather(data, starts[part], lens[part]) == gather(data, starts[entry[which[part]]], lens[part])
            if not same.all():
                bad = np.unique(np.searchsorted(np.cumsum(lens[part]), np.flatnonzero(~same), side="right"))
                wrong = np.append(wrong, part[bad])
    if len(wrong):  # each of them stands for itself
        which[wrong] = len(entry) + np.arange(len(wrong))
        entry = np.append(entry, wrong)
    return entry, which
