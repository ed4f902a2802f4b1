"""Words and character counts of a batch of texts, on their UTF-8 bytes, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of bytes outside these (space, and tab to carriage return).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


class Words:
    """Byte ranges of the words of each text; null is the empty text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "")
        _, offsets, data = column.buffers()
        wide = np.dtype("<i8" if pa.types.is_large_string(column.type) else "<i4")
        offsets = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.padded = np.zeros(len(raw) + 8, np.uint8)
        self.padded[:len(raw)] = LOWER[raw] if lower else raw
        self.data = self.padded[:len(raw)]
        begin, end = self.bounds[:-1], self.bounds[1:]
        inner = begin < end
        word = ~SPACE[self.data]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[begin[inner]] = False
        after[end[inner] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(column)), self.counts)
        self.inside = word

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as a number; bytes after the end are zero or of the next word."""
        view = np.ndarray((len(self.data) + 1,), "<u8", self.padded.data, strides=(1,))
        return view[at]

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each byte range."""
        starts = self.starts if starts is None else starts
        left = (self.ends if ends is None else ends) - starts
        h = mix(left.astype(np.uint64) * M1 + np.uint64(1))
        which = np.flatnonzero(left > 0)
        step = 0
        while len(which):
            rest = left[which] - step
            chunk = self.eight(starts[which] + step)
            short = rest < 8
            chunk[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[which] = mix((h[which] ^ chunk) * M1)
            step += 8
            which = which[rest > 8]
        return h

    def per_text(self, of_bytes: np.ndarray) -> np.ndarray:
        """Sum over each text's bytes."""
        total = np.zeros(len(of_bytes) + 1, np.int64)
        np.cumsum(of_bytes, out=total[1:])
        return np.diff(total[self.bounds])

    def per_words(self, of_words: np.ndarray) -> np.ndarray:
        """Sum over each text's words."""
        total = np.zeros(len(of_words) + 1, np.int64)
        np.cumsum(of_words, out=total[1:])
        return np.diff(total[self.first])

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words inside one text."""
        count = max(0, len(hashes) - n + 1)
        h = np.zeros(count, np.uint64)
        for j in range(n):
            h = h * M1 + hashes[j:j + count]
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1:n - 1 + count]) if count else np.zeros(0, np.int64)
        return at, mix(h[at])
