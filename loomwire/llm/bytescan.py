"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than the six ASCII blanks, with A-Z lower-cased. A word's hash is a
polynomial over random 64-bit values of its bytes, finished by a mixing step; a shingle's hash mixes
its words' hashes in order. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes scanned at a time; temporaries take about 40 times that.
CHUNK = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _VALUE[LOWER]
_VALUE[BLANK] = 0
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _R_INVERSE)):
            p = np.full(max(n, CHUNK * 2), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _scan(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = BLANK[b]
    edge = np.empty(len(b), bool)
    edge[0] = not blank[0]
    np.logical_and(blank[:-1], ~blank[1:], out=edge[1:])
    starts = np.flatnonzero(edge)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power(len(b))
    h = np.add.reduceat(_VALUE[b] * up[: len(b)], starts) * down[starts]
    return starts, mix(h + np.uint64(_R & 0x7FFFFFFFFFFFFFFF))


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and hash of each word of the bytes b."""
    if len(b) <= CHUNK:
        return _scan(b) if len(b) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    at, starts, hashes = 0, [], []
    while at < len(b):
        end = min(len(b), at + CHUNK)
        while end < len(b) and not BLANK[b[end]]:  # never inside a word
            step = np.flatnonzero(BLANK[b[end : end + CHUNK]])
            end = end + int(step[0]) if len(step) else min(len(b), end + CHUNK)
        s, h = _scan(b[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence as one if it has fewer; empty without words."""
    if not len(h):
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mix(out + h[j : j + n]) * np.uint64(_R)
    return mix(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, end offsets, bytes) of groups of about CHUNK bytes; every text is followed by one blank. Null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.binary_join_element_wise(pc.fill_null(array.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, offsets[row + 1 : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def doc_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text."""
    for row, ends, data in texts_of(column):
        starts, hashes = words_of(data)
        cuts = np.searchsorted(starts, ends)
        begin = 0
        for i, cut in enumerate(cuts):
            yield row + i, hashes[begin:cut]
            begin = cut
