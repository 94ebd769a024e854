"""Words and hashes of whole Arrow batches with numpy: no loop over documents or words.

A word is a run of bytes other than ASCII white space.  The hash of a run takes eight bytes at a time through
a bijection of 64-bit integers, so runs of up to eight bytes and equal length never share one, and others do by chance alone;
runs of more than ``SHORT`` bytes are hashed by XXH3.  Equal words have equal hashes in every process.

Beside the arrays for each word nothing grows with the bytes but masks of one byte each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd constants of the hashes (fixed values, so that they agree between workers and runs).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Runs up to this many bytes are hashed in numpy.
SHORT = 64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Blocks:
    """Eight bytes from any place of a buffer as integers, cut off where a run ends."""

    def __init__(self, data: np.ndarray) -> None:
        self.padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=self.padded, strides=(1,))

    def at(self, place: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes of runs at ``place`` that have ``left`` (at least one) bytes to go."""
        missing = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
        return self.words[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> missing)


def run_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, blocks: Blocks | None = None) -> np.ndarray:
    """Hashes of data[start[i]:stop[i]]."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    blocks = blocks or Blocks(data)
    size = stop - start
    h = mix(size.astype(np.uint64) * np.uint64(MULTIPLIERS[1]))
    long = np.flatnonzero(size > SHORT)
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    for at in range(0, SHORT, 8):
        if not len(live):
            break
        h[live] = mix(h[live] ^ blocks.at(start[live] + at, size[live] - at))
        live = live[size[live] > at + 8]
    for i in long.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]])
    return h


def equal_runs(data: np.ndarray, start: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray, blocks: Blocks) -> np.ndarray:
    """Which runs a[i] and b[i] (indexes of start and stop) have the same bytes."""
    size = stop[a] - start[a]
    same = size == stop[b] - start[b]
    live = np.flatnonzero(same & (size > 0) & (size <= SHORT))
    for at in range(0, SHORT, 8):
        if not len(live):
            break
        left = size[live] - at
        fits = blocks.at(start[a[live]] + at, left) == blocks.at(start[b[live]] + at, left)
        same[live[~fits]] = False
        live = live[fits & (left > 8)]
    for i in np.flatnonzero(same & (size > SHORT)).tolist():
        x, y = start[a[i]], start[b[i]]
        same[i] = np.array_equal(data[x : x + size[i]], data[y : y + size[i]])
    return same


class Words:
    """The words of the texts of an Arrow string array, as places in one buffer of bytes.

    ``first[d]`` to ``first[d + 1]`` are the words of document d; a null text has none.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = int(offsets[0]) if len(offsets) else 0
        size = int(offsets[-1]) - base if len(offsets) else 0
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[base : base + size] if raw is not None and size else np.zeros(0, np.uint8)
        offsets = offsets - base
        self._find(LOWER[data] if lower else data, offsets)

    @classmethod
    def of(cls, data: np.ndarray) -> "Words":
        """The words of one text, given as its bytes."""
        out = cls.__new__(cls)
        out._find(data, np.array([0, len(data)]))
        return out

    def _find(self, data: np.ndarray, offsets: np.ndarray) -> None:
        size = len(data)
        self.data = data
        inside = self.inside = ~SPACE[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < size]
        edge = edge[inside[edge]] if len(edge) else edge
        starts[edge] = True
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        last = last[inside[last]] if len(last) else last
        stops[last] = True
        self.start = np.flatnonzero(starts)
        self.stop = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data, self.start, self.stop)

    def __len__(self) -> int:
        return len(self.start)

    def spaced(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the words (or of those to keep) with one space after each, and where each begins in them."""
        size = self.stop - self.start
        letters = self.data[self.inside]
        if keep is not None:
            letters, size = letters[np.repeat(keep, size)], size[keep]
        off = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.full(off[-1], 0x20, dtype=np.uint8)
        filled = np.ones(off[-1], dtype=bool)
        filled[off[1:] - 1] = False
        flat[filled] = letters
        return flat, off


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (the last n - 1 entries are not used: there the run is short)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        # the shift keeps the sum from being a polynomial, which would fall in with itself on regular sequences
        out ^= out >> np.uint64(32)
        out *= np.uint64(MULTIPLIERS[0])
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def chunks(batch: pa.RecordBatch, text: int, size: int = 2 << 20):
    """Cut a batch so that the texts of each piece take about ``size`` bytes, or are one."""
    column = batch.column(text).cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


#: Bytes of a long text that are looked at together.
SECTION = 4 << 20


def sections(text: np.ndarray, overlap: int, size: int = SECTION):
    """Cut one text (its bytes) into parts of about ``size`` bytes that begin and end between words.

    Yields (number of words before the part, its bytes).  A part takes along the next ``overlap`` words, so
    every run of ``overlap + 1`` words begins in exactly one part, which holds all of it.
    """
    if len(text) <= size:
        yield 0, text
        return
    space = SPACE[text]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    del space
    at = 0
    while at < len(starts):
        after = max(at + 1, int(np.searchsorted(starts, starts[at] + size)))
        last = min(after + overlap, len(starts))
        yield at, text[starts[at] : starts[last] if last < len(starts) else len(text)]
        at = after
