"""Benchmark decontamination by greedy string tiling (operator 1).

Seeds: hashes of every run of MIN_MATCH words. Documents meet benchmark items where they
share a seed. For such a pair, running Karp-Rabin finds the longest common runs of words
that are not yet marked, marks them in both texts (longest first, none overlapping) and
goes on with shorter ones down to MIN_MATCH. Tiles may stand in any order, so reordered
passages count. An item leaks into a document if its tiles cover at least THRESHOLD of
the item's words.

The benchmark is taken in parts of about PART_WORDS words. A part's size does not depend
on the documents, and only a part is broadcast; the documents are scanned once per part,
without a shuffle, so no item or document can make a hot key. Matches of a pair lie where
seeds are shared, so tiling looks at those places only.

Defined results: null or empty texts match nothing; items of fewer than MIN_MATCH words
hold no seed and match nothing; rows with a null id take no part; repeated documents
repeat their rows; repeated items count once per id and text; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, ship
from millrace.llm.tokens import mix, shingle_hashes, weights, word_hashes

MIN_MATCH = 5
THRESHOLD = 0.5
#: Words of the benchmark broadcast at once: about 16 MB of hashes.
PART_WORDS = 1_000_000
#: Bits of the table that turns most runs away before the exact search.
SIEVE_BITS = 22

SCHEMA = (
    "doc_id {kind}, item_id {item}, matched_words int, item_words int, coverage double, "
    "tiles array<struct<item_start:int,doc_start:int,words:int>>"
)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of size words, in one pass over prefix sums."""
    power = np.cumprod(np.full(len(words) + 1, weights(2)[1], dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])
    # Runs at different places are brought to one scale by the last power.
    count = len(words) - size + 1
    return (sums[size:] - sums[:-size]) * power[::-1][:count]


def tiles_of(item: np.ndarray, doc: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in item, start in doc, words)."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(minimum, min(len(item), len(doc)))

    def runs(free: np.ndarray, count: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(sums[count:] - sums[:-count] == count)

    while size >= minimum:
        matches: list[tuple[int, int, int]] = []
        if size <= min(len(item), len(doc)):
            both = np.concatenate([item, doc])
            hashes = _windows(both, size)
            places = defaultdict(list)
            for i in runs(free_item, size):
                places[hashes[i]].append(int(i))
            starts = runs(free_doc, size)
            if places:
                keys = np.array(sorted(places), dtype=np.uint64)
                own = hashes[len(item) + starts]
                for j in starts[np.isin(own, keys)]:
                    for i in places[hashes[len(item) + j]]:
                        length, j = 0, int(j)
                        while (
                            i + length < len(item)
                            and j + length < len(doc)
                            and free_item[i + length]
                            and free_doc[j + length]
                            and item[i + length] == doc[j + length]
                        ):
                            length += 1
                        if length >= size:
                            matches.append((length, i, j))
        # Longest first; of an occluded match its free parts wait for their turn.
        queue = sorted((-length, i, j) for length, i, j in matches)
        seen = set(queue)
        while queue:
            length, i, j = heapq.heappop(queue)
            length = -length
            free = free_item[i : i + length] & free_doc[j : j + length]
            if free.all():
                free_item[i : i + length] = free_doc[j : j + length] = False
                tiles.append((i, j, length))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
                part = (lo - hi, i + lo, j + lo)
                if hi - lo >= size and part not in seen:
                    seen.add(part)
                    heapq.heappush(queue, part)
        if size == minimum:
            break
        size = max(minimum, size // 2)
    return sorted(tiles)


class Part:
    """Seeds and words of some benchmark items; what a task holds of the benchmark."""

    def __init__(self, items: list[tuple], minimum: int):
        self.ids = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        self.words: list[np.ndarray] = []
        for _, words, bounds in word_hashes(texts):
            self.words += [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        seeds = [shingle_hashes(w, minimum) for w in self.words]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        every = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], owner[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.slot(self.seeds)] = True

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that are seeds."""
        at = np.flatnonzero(self.sieve[self.slot(hashes)])
        low = np.searchsorted(self.seeds, hashes[at])
        low[low == len(self.seeds)] = 0
        return at[self.seeds[low] == hashes[at]] if len(self.seeds) else at[:0]

    def owners(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        low = np.searchsorted(self.seeds, hashes, "left")
        high = np.searchsorted(self.seeds, hashes, "right")
        found = defaultdict(list)
        for place, (a, b) in enumerate(zip(low, high)):
            for item in set(self.owner[a:b].tolist()):
                found[item].append(place)
        for item, places in sorted(found.items()):
            yield item, np.array(places)


def _around(words: np.ndarray, starts: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """The words under shared seeds with a unique filler in each gap; their places."""
    cover = np.unique((starts[:, None] + np.arange(minimum)).ravel())
    gaps = np.flatnonzero(np.diff(cover) > 1) + 1
    kept = np.insert(words[cover], gaps, mix(np.arange(len(gaps), dtype=np.uint64)))
    return kept, np.insert(cover, gaps, -1)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    minimum: int = MIN_MATCH,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, coverage, tiles) of leaked pairs; tiles
    count words from 0."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select("item_id", "text").dropna().distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    parts = max(1, math.ceil(total / part_words))
    rows = docs.select("doc_id", "text").dropna()
    kind, item = (
        f.schema[n].dataType.simpleString() for f, n in ((docs, "doc_id"), (benchmark, "item_id"))
    )
    schema = SCHEMA.format(kind=kind, item=item)
    found = None
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        data = [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast(data)
        some = rows.mapInArrow(_search(shared, threshold, minimum, schema), schema)
        found = some if found is None else found.unionByName(some)
    return found


def _search(shared, threshold: float, minimum: int, schema: str):
    names = ["doc_id", "item_id", "matched_words", "item_words", "coverage", "tiles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Part(shared.value, minimum)
        tile = pa.struct([(n, pa.int32()) for n in ("item_start", "doc_start", "words")])
        items = pa.array(part.ids) if part.ids else pa.array([], pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for first, words, bounds in word_hashes(batch.column(1)):
                hashes = shingle_hashes(words, minimum)
                at = part.shared(hashes)
                text = np.searchsorted(bounds, at, side="right") - 1
                at = at[at + minimum <= bounds[text + 1]] if len(at) else at
                text = np.searchsorted(bounds, at, side="right") - 1
                for i in np.unique(text):
                    own = at[text == i]
                    for item, places in part.owners(hashes[own]):
                        starts = own[places] - bounds[i]
                        near, place = _around(words[bounds[i] : bounds[i + 1]], starts, minimum)
                        wanted = part.words[item]
                        tiles = tiles_of(wanted, near, minimum)
                        matched = sum(t[2] for t in tiles)
                        if matched >= threshold * len(wanted):
                            spans = [(a, int(place[b]), n) for a, b, n in tiles]
                            out.append((first + int(i), item, matched, len(wanted), spans))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([o[0] for o in out])),
                        items.take(pa.array([o[1] for o in out])),
                        pa.array([o[2] for o in out], pa.int32()),
                        pa.array([o[3] for o in out], pa.int32()),
                        pa.array([o[2] / o[3] for o in out], pa.float64()),
                        pa.array(
                            [[dict(zip(("item_start", "doc_start", "words"), t)) for t in o[4]] for o in out],
                            pa.list_(tile),
                        ),
                    ],
                    names=names,
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no item leaks into, with all their columns. Rows are told apart by id and
    text, so a null or repeated id neither saves nor condemns another row."""
    tag = F.xxhash64("text")
    rows = docs.select(F.struct("doc_id", tag.alias("tag")).alias("doc_id"), "text")
    dirty = leaks(rows, benchmark).select(F.col("doc_id.doc_id").alias("__d"), F.col("doc_id.tag").alias("__t"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (tag == F.col("__t"))
    return docs.join(dirty.distinct(), same, "left_anti").select(*docs.columns)
