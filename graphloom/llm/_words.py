"""Whole columns of texts as words, word hashes and hashes of runs of words.

Words are ``[^\\x20\\x09-\\x0D]+`` in UTF-8. A word's hash is XXH3 with 128 bits of
its bytes, kept as two independent halves (``lane`` 0 and 1): candidates are found
by the first, what they say is verified by the second. Runs of words are hashed by
joining the hashes of their parts with a mixing function that is not linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text hashed at a time, unless one text is longer.
BLOCK = 1 << 19
SEED = 0x5EED


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def join(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two parts that follow one another, from their hashes."""
    h = mix(second + np.uint64(0x9E3779B97F4A7C15))
    h += first
    return mix(h)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. The offsets begin at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind, bytes_ = (np.int64, 8) if wide else (np.int32, 4)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * bytes_).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes in all, at least one text each."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


class Words:
    """The words of a run of texts: ``words``, their ``hashes`` (``lanes`` has both), and for text i the words ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, lane: int = 0):
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])].tobytes()
        raw = raw.lower() if lower else raw  # of bytes: A-Z only
        words: list[bytes] = []
        first = [0]
        at = (offsets - base).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            words += raw[a:b].split()  # of bytes: the six ASCII white spaces only
            first.append(len(words))
        self.words, self.first = words, np.array(first, np.int64)
        digests = bytearray().join(map(xxhash.xxh3_128_digest, words, repeat(SEED)))
        self.lanes = np.frombuffer(digests, np.uint64).reshape(-1, 2) if words else np.zeros((0, 2), np.uint64)
        self.hashes = self.lanes[:, lane].copy()

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words, joined by one space, and where each begins and ends."""
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        end = np.cumsum(size + 1) - 1
        return b" ".join(self.words), end - size, end

    def inside(self, length: int) -> np.ndarray:
        """Whether the ``length`` words from each word on lie in one text."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        good = np.ones(n + length, bool)
        text_end = self.first[1:]
        for k in range(1, length):
            at = text_end - k
            good[at[(at >= 0) & (at < n)]] = False
        return good[:n]


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` successive word hashes, by doubling."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, words, 1
    while True:
        if length & size:
            out = power[:n] if out is None else join(out[:n], power[have : have + n])
            have += size
        if have == length:
            return out.copy() if out is power or out.base is not None else out
        power = join(power[:-size], power[size:])
        size *= 2


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a short run of any length, its length included."""
    h = np.array([len(words)], np.uint64)
    for k in range(len(words)):
        h = join(h, words[k : k + 1])
    return h[0]
