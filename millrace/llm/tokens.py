"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes other than space and 9 to 13, A-Z lower-cased. A word's
hash is a sum of its bytes under fixed pseudo-random weights by position, mixed; a
shingle's is such a sum of its words' hashes. Equal words always get equal hashes;
different ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is cut between words.
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WEIGHTS = np.empty(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator (fixed constants)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(count: int) -> np.ndarray:
    global _WEIGHTS
    if len(_WEIGHTS) < count:
        _WEIGHTS = mix(np.arange(max(count, 1024), dtype=np.uint64)) | np.uint64(1)
    return _WEIGHTS


def _hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data; a word also begins at every break."""
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = breaks[breaks < len(data)]
    start[inner] = solid[inner]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(start[at])  # of each word, among the solid bytes
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    value = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * weights(int(sizes.max()))[place]
    sums = np.add.reduceat(value, first)
    return mix(sums ^ (sizes.astype(np.uint64) << np.uint64(40))), at[first]


def _views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins and ends."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, ends.astype(np.int64)


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slice by slice, cut at white space."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        while hi < len(data):
            gap = np.flatnonzero(_SPACE[data[hi : hi + SLICE]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(hi + SLICE, len(data))
        out.append(_hash_words(data[lo:hi], np.zeros(1, dtype=np.int64))[0])
        lo = hi
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, bounds): bounds[i] to bounds[i + 1] are the words of text
    first + i. Texts come in groups of about SLICE bytes; a longer text comes alone."""
    raw, ends = _views(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, ends[lo] + SLICE, side="right")) - 1
        if hi <= lo:
            found = _long(raw[ends[lo] : ends[lo + 1]])
            yield lo, found, np.array([0, len(found)])
            lo += 1
            continue
        hi = min(hi, len(texts))
        inner = ends[lo : hi + 1] - ends[lo]
        found, starts = _hash_words(raw[ends[lo] : ends[hi]], inner)
        yield lo, found, np.searchsorted(starts, inner)
        lo = hi


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size words, by its first word."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    scale = weights(size)
    total = words[:count] * scale[0]
    for i in range(1, size):
        total = total + words[i : i + count] * scale[i]
    return mix(total ^ np.uint64(size))


def shingle_sets(
    texts: pa.Array, size: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct shingles). With fewer words: the whole sequence as one."""
    for first, words, bounds in word_hashes(texts):
        every = shingle_hashes(words, size)
        for i in range(len(bounds) - 1):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= size:
                yield first + i, np.unique(every[lo : hi - size + 1])
            else:
                yield first + i, shingle_hashes(words[lo:hi], int(hi - lo)) if hi > lo else every[:0]
