"""Substring deduplication by sliding sentence spans (operator 6).

A run starts at every sentence and is the shortest that has at least SPAN sentences and
MIN_WORDS words; every run is hashed (lower-cased, white space collapsed) to 128 bits. Runs
are joined over the whole corpus by hash. A run's first place (first document, then
sentence) stays; sentences covered by any run at another place are removed.

A sentence ends behind a word that ends in a stop, and at line breaks. A sentence of more
than CUT_ABOVE words is cut in units, which take a sentence's place in all that follows,
results included. Cuts are the places whose neighbouring words have the least hash in some
window of WINDOW places, so units have at most WINDOW words but at the ends, and equal
passages are cut alike but near theirs. Hence 4 * WINDOW + MIN_WORDS - 2 words (49) without a
stop that stand in two places always share a run, whatever stands around them. A lone sentence
of at most CUT_ABOVE words that repeats is no run of several sentences and stays.

Tasks hash all texts of a block at once, in numpy, and drop runs that stand earlier in the
same batch; the others meet by hash, and only the place of the first goes back to its
document. So a run that many documents share costs a row per batch, not per document, and no
task gathers its places. A document's list is bounded by its sentences. The runs of a text
are hashed once to be joined and once when it is cut; both are cheaper than to keep them.

Defined results: null text stays null and empty text empty, both without sentences; a
document too short for a run loses nothing; documents are ordered by id, null first, those
that share an id by a hash of the text; equal rows are one document, and each gets its result;
other columns are ignored. Words are what ASCII white space parts: a script written without
it has few words, and so few runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ship
from millrace.llm.keyed import KEYS, first_places, keyed, lists_of, order_of, with_lists
from millrace.llm.tokens import mix, weights

SPAN = 2
MIN_WORDS = 15

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Longest sentence, in words, that stays whole; places per window of the cuts in others.
CUT_ABOVE = 32
WINDOW = 9
#: Bytes of text looked at at once, and windows.
SLICE = 1 << 20
WINDOWS = 1 << 16
#: Runs held in a task before those that stand earlier in it are dropped.
HELD = 400_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and whether a line break stands behind it; no word
    reaches over a break."""
    solid = ~_SPACE[data]
    inner = breaks[(breaks > 0) & (breaks < data.size)]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    start[inner], stop[inner - 1] = solid[inner], solid[inner - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not first.size:
        return np.empty(0, np.uint64), first, last, np.empty(0, bool)
    sizes = last - first
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    value = (_LOWER[data[solid]].astype(np.uint64) + np.uint64(1)) * weights(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(value, before) ^ (sizes.astype(np.uint64) << np.uint64(40)))
    lines = np.cumsum(data == 10, dtype=np.int32)
    behind = lines[np.append(first[1:], data.size) - 1] > lines[last - 1]
    return hashes, first, last, behind


def _sliced(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same slice by slice, cut at white space, where a text is longer than a slice."""
    parts, lo = [], 0
    while lo < data.size or not parts:
        hi = min(lo + SLICE, data.size)
        while hi < data.size and not _SPACE[data[hi]]:
            gap = np.flatnonzero(_SPACE[data[hi : hi + SLICE]])
            hi = hi + int(gap[0]) if gap.size else min(hi + SLICE, data.size)
        hashes, first, last, behind = _words(data[lo:hi], breaks[(breaks >= lo) & (breaks <= hi)] - lo)
        # A slice begins with white space, which may hold the line break behind the last word.
        if parts and parts[-1][3].size:
            head = data[lo : lo + int(first[0])] if first.size else data[lo:hi]
            parts[-1][3][-1] |= bool((head == 10).any())
        parts.append((hashes, first + lo, last + lo, behind))
        lo = hi
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _cuts(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Numbers of the words before which long sentences are cut: in each window of places
    between two words of a sentence, the one with the least hash, the last one of equals."""
    if hashes.size <= WINDOW:
        return np.empty(0, np.int64)
    long = np.bincount(sentence)[sentence] > CUT_ABOVE
    begins = np.flatnonzero(long[:-WINDOW] & (sentence[WINDOW:] == sentence[:-WINDOW]))
    if not begins.size:
        return begins
    places = mix(hashes[:-1] * BASES[0] + hashes[1:])
    windows = np.lib.stride_tricks.sliding_window_view(places, WINDOW)[:, ::-1]
    found = [
        np.unique(some + WINDOW - windows[some].argmin(axis=1))
        for lo in range(0, begins.size, WINDOWS)
        for some in (begins[lo : lo + WINDOWS],)
    ]
    return np.unique(np.concatenate(found))


def cuts_of(words: list[bytes]) -> np.ndarray:
    """Numbers of the words before which one sentence is cut."""
    hashes = _words(np.frombuffer(b" ".join(words), np.uint8), np.zeros(1, np.int64))[0]
    return _cuts(hashes, np.zeros(hashes.size, np.int64))


@dataclass
class Units:
    """Sentences, long ones in units, of texts that stand behind each other: where each
    begins and ends in the bytes, its text, its words' number, two hashes; and per text its
    first unit (with one more at the end)."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    words: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]
    of_text: np.ndarray

    def runs(self, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First unit and end (exclusive) of every run, and its two hashes."""
        count = self.first.size
        begin = np.append(0, np.cumsum(self.words))
        end = np.maximum(np.searchsorted(begin, begin[:-1] + min_words), np.arange(count) + span)
        whole = np.flatnonzero(end <= self.of_text[self.text + 1])
        end = end[whole]
        sizes = end - whole
        out = []
        for base, own in zip(BASES, self.hashes):
            total = np.zeros(whole.size, np.uint64)
            for step in range(int(sizes.max(initial=0))):
                more = np.flatnonzero(sizes > step)
                total[more] = total[more] * base + own[whole[more] + step]
            out.append(mix(total ^ sizes.astype(np.uint64)))
        return whole, end, *out


def units_of(data: np.ndarray, bounds: np.ndarray) -> Units:
    """bounds[i] to bounds[i + 1] are the bytes of text i."""
    texts = bounds.size - 1
    hashes, first, last, line = _sliced(data, bounds[:-1])
    text = np.searchsorted(bounds, first, "right") - 1
    # Of texts that begin at one place only the last has bytes.
    if not first.size:
        empty = np.empty(0, np.int64)
        return Units(empty, empty, empty, empty, (empty.astype(np.uint64),) * 2, np.zeros(texts + 1, np.int64))
    ends = _STOP[data[last - 1]] | line
    ends[:-1] |= text[1:] != text[:-1]
    new = np.append(True, ends[:-1])
    new[_cuts(hashes, np.cumsum(new) - 1)] = True
    begin = np.flatnonzero(new)
    words = np.diff(np.append(begin, first.size))
    place = np.arange(first.size) - np.repeat(begin, words)
    own = tuple(
        mix(np.add.reduceat(hashes * weights(shift + int(words.max()))[shift + place], begin) ^ words.astype(np.uint64))
        for shift in (0, 4096)
    )
    return Units(
        first[begin],
        last[np.append(begin[1:], first.size) - 1],
        text[begin],
        words,
        own,
        np.searchsorted(text[begin], np.arange(texts + 1)),
    )


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Start and end (exclusive, in code points) of the sentences of one text."""
    raw = text.encode()
    units = units_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in zip(units.first, units.last)]


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of groups of about SLICE bytes; a longer text comes alone."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1)
        yield lo, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def _runs(span: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag = np.asarray(batch["tag"])
            rank = order_of(batch["doc_id"], tag)
            held: list[tuple[np.ndarray, ...]] = []

            def firsts(batch=batch, tag=tag, rank=rank) -> pa.RecordBatch:
                row, place, m, c = map(np.concatenate, zip(*held, strict=True))
                order = np.lexsort((place, rank[row], c, m))
                m, c = m[order], c[order]
                fresh = np.ones(m.size, bool)
                fresh[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
                row, place = row[order[fresh]], place[order[fresh]]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(m[fresh].view(np.int64)),
                        pa.array(c[fresh].view(np.int64)),
                        batch["doc_id"].take(pa.array(row)),
                        pa.array(tag[row]),
                        pa.array(place),
                    ],
                    ["m", "c", "doc_id", "tag", "place"],
                )

            for row, data, bounds in blocks(batch["text"]):
                units = units_of(data, bounds)
                first, _, m, c = units.runs(span, min_words)
                text = units.text[first]
                held.append((text + row, first - units.of_text[text], m, c))
                if sum(h[0].size for h in held) >= HELD:
                    yield firsts()
                    held = []
            if held:
                yield firsts()

    return run


def first_runs(rows: DataFrame, span: int, min_words: int) -> DataFrame:
    """(doc_id, tag, places): per document the sentences that begin a run which stands nowhere
    before; rows as ``keyed`` gives them."""
    runs = rows.mapInArrow(_runs(span, min_words), f"m long, c long, {KEYS}, place long")
    return lists_of(first_places(runs), "place")


def _remove(span: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["places"]
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            bounds = np.append(0, np.cumsum(sizes))
            places = np.asarray(lists.flatten())
            texts, total, gone = batch["text"].to_pylist(), [], []
            for row, data, ends in blocks(batch["text"]):
                units = units_of(data, ends)
                first, end, _, _ = units.runs(span, min_words)
                here = np.arange(row, row + ends.size - 1)
                kept = np.zeros(units.first.size + 1, bool)
                of_text = np.repeat(units.of_text[:-1], sizes[here])
                kept[of_text + places[bounds[row] : bounds[row + ends.size - 1]]] = True
                again = ~kept[first]
                cover = np.zeros(units.first.size + 1, np.int64)
                np.add.at(cover, first[again], 1)
                np.add.at(cover, end[again], -1)
                dropped = np.cumsum(cover[:-1]) > 0
                total += np.diff(units.of_text).tolist()
                for number in range(ends.size - 1):
                    a, b = units.of_text[number], units.of_text[number + 1]
                    drop = np.flatnonzero(dropped[a:b])
                    gone.append(drop.tolist())
                    if drop.size:
                        # What separates sentences goes with the sentence before it.
                        cuts = [ends[number], *units.first[a + 1 : b], ends[number + 1]]
                        stay = np.flatnonzero(~dropped[a:b])
                        texts[row + number] = b"".join(data[cuts[i] : cuts[i + 1]].tobytes() for i in stay).decode()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(total, pa.int64()),
                    pa.array([len(g) for g in gone], pa.int64()),
                    pa.array(gone, pa.list_(pa.int32())),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_sentences", "n_removed", "removed", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text): one row per row of docs; removed
    holds sentence numbers from 0, text what is left."""
    ship(docs.sparkSession)
    rows, distinct = keyed(docs)
    lists = first_runs(distinct.filter(F.col("text").isNotNull()), span, min_words)
    return with_lists(rows, lists).mapInArrow(
        _remove(span, min_words),
        "doc_id long, n_sentences long, n_removed long, removed array<int>, text string",
    )
