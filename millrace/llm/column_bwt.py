"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

Strings are inserted from their ends, one symbol per string each round. The transform and
the array of longest common prefixes are sequential arrays that every round reads once in
order and writes anew: the suffixes that a round adds take their places by the rank of their
first symbol in the transform so far, and their common prefixes with their neighbours are one
more than the least value between that symbol's neighbouring occurrences. No suffix is
compared with another one.
"""

from __future__ import annotations

import numpy as np


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first:last] for each pair; first < last. Pairs go from right to left,
    so that reduceat does nothing between them."""
    order = np.argsort(-first, kind="stable")
    pairs = np.empty(2 * order.size, np.int64)
    pairs[::2], pairs[1::2] = first[order], last[order]
    out = np.empty(order.size, values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values[:1]), pairs)[::2]
    return out


def collection(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of all strings in order: (string, length, common prefix with the one
    before). symbols: a row per string, its last byte first, each byte plus one so that 0
    stands for the end (UTF-8 has no byte 255); lengths: at most the row's width, under 256
    so that a length fits a byte. Ends of strings sort by string and are never equal."""
    count = lengths.size
    symbols = np.column_stack([symbols, np.zeros(count, symbols.dtype)])
    # A suffix is its string's number << 8 | its length.
    suffix = np.arange(count, dtype=np.uint32) << np.uint32(8)
    common = np.zeros(count, np.uint8)
    transform = np.where(lengths > 0, symbols[:, 0], 0).astype(np.uint8)
    newest = np.arange(count)  # places of the suffixes that the last round added
    for size in range(1, int(lengths.max(initial=0)) + 1):
        newest = newest[transform[newest] > 0]
        order = np.argsort(transform, kind="stable")
        ended = int(np.count_nonzero(transform == 0))
        grew = np.zeros(transform.size, bool)
        grew[newest] = True
        at = np.flatnonzero(grew[order])  # ranks of the new suffixes, in order
        before, here = order[np.maximum(at - 1, 0)], order[at]
        after = order[np.minimum(at + 1, order.size - 1)]
        symbol = transform[here]
        joined = (at > 0) & (transform[before] == symbol)
        follows = (at + 1 < order.size) & (transform[after] == symbol)
        prefix = np.zeros(at.size, np.uint8)
        prefix[joined] = _range_minima(common, before[joined] + 1, here[joined] + 1) + 1
        behind = _range_minima(common, here[follows] + 1, after[follows] + 1) + 1

        strings = (suffix[here] >> np.uint32(8)).astype(np.int64)
        # The ends of all strings come first, then suffixes in the order of their symbols.
        spot = count + at - ended
        old = np.ones(transform.size + at.size, bool)
        old[spot] = False

        def merged(kept: np.ndarray, added: np.ndarray) -> np.ndarray:
            out = np.empty(old.size, kept.dtype)
            out[old] = kept
            out[spot] = added
            return out

        suffix = merged(suffix, (strings << 8 | size).astype(np.uint32))
        common = merged(common, prefix)
        common[spot[follows] + 1] = behind
        following = np.where(lengths[strings] > size, symbols[strings, size], 0)
        transform = merged(transform, following.astype(np.uint8))
        newest = spot
    return (suffix >> np.uint32(8)).astype(np.int64), (suffix & np.uint32(255)).astype(np.int64), common
