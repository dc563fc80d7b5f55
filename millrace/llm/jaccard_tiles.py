"""N-gram Jaccard join by size-banded tiles with bitmap signatures (operator 9).

A document's set is its distinct SHINGLE-word shingles, as 64-bit hashes. Documents link
when 100 * intersection >= PERCENT * union.

1. A sketch of fixed size counts shingles over all documents. It only gives an order of
   shingles, frequent ones last; any order that is the same for all documents is right.
2. Each document gets its set's size and fingerprint, a bitmap signature of about two bits
   per shingle, and its prefix: the shingles that come first in that order, as many that
   two linked documents must share one. Equal sets form a class; one member goes on.
3. Classes that share a prefix shingle meet in a tile. Within it they are banded by size
   and compared band by band: a shingle whose bit the other's bitmap lacks is not in the
   other set, so bit counts bound the overlap from above. Pairs that the bound rules out
   are not linked. The rest, as a spanning forest per tile, give candidate groups.
4. The documents of a candidate group meet once, with whole texts: banded tiles again,
   the bitmap bound, then exact intersection of the sorted sets. Pairs already connected
   are skipped, as they change no component. The links found, as a spanning forest, are
   put together over all tiles.

Prefix groups and candidate groups of any size are dealt in blocks of about BLOCK members
(2 * BLOCK at most, but for the chance of the deal), and every pair of blocks is a tile, so
no tile has more than two blocks. The classes of each prefix shingle are counted exactly, and
the members of a frequent one are dealt by that count before they meet, so no row or task
gathers them, whatever the sketch says. Nothing is capped: the work of a large group grows, its
tiles do not. The sketch is 2**SKETCH_BITS cells; with more text than suits them (four million
suit tens of GB) fewer frequent shingles come last, which costs pairs to compare, not links.

Defined results: null or empty text, or text without words, is an empty set and links with
nothing; with fewer words than SHINGLE the whole sequence is the one shingle; rows with a
null id have no component; rows with equal id are one node, which has the links of all its
texts; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks_of, in_two_stages, ship, staged
from millrace.llm.components import components
from millrace.llm.tokens import mix, shingle_sets

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 22
SLICES = 64
BLOCK = 1_024
BLOCK_SHINGLES = 2_000_000
MIN_BITS, MAX_BITS = 64, 1 << 16
#: Frequent shingles that are broadcast, at most: 16 bytes each.
BROADCAST_ROWS = 1_000_000


def _slots(sets: np.ndarray, bits: int) -> np.ndarray:
    return (sets >> np.uint64(64 - bits)).astype(np.int64)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), SHINGLE):
                held.append(_slots(found, bits))
                size += len(found)
                if size > 1 << bits:
                    cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.uint64)
                    held, size = [], 0
        if held:
            cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.uint64)
            salt = int(mix(cells[:1] + np.uint64(size))[0] % np.uint64(SLICES))
            yield _slices({i: c for i, c in enumerate(np.split(cells, SLICES))}, salt)

    return run


def _slices(cells: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    packed = [zlib.compress(c.tobytes(), 1) for c in cells.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(cells), pa.int32()), pa.array([salt] * len(cells), pa.int32()), pa.array(packed, pa.binary())],
        names=["slice", "salt", "cells"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
            own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint64)
            total[i] = total[i] + own if i in total else own
    if total:
        yield _slices(total, 0)


def sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """log2 of each cell's count above the usual one: one byte per cell, whatever the corpus."""
    schema = "slice int, salt int, cells binary"
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(bits), schema)
    # A task's slices are put together in two steps, so that no slice is one task's work.
    for keys in (("slice", "salt"), ("slice",)):
        parts = parts.repartition(blocks_of(docs.sparkSession), *keys).mapInArrow(_merge, schema)
    cells = np.zeros((SLICES, (1 << bits) // SLICES), np.uint64)
    for row in parts.collect():
        cells[row["slice"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint64)
    flat = cells.ravel().astype(np.float64)
    usual = 2 * flat.mean()
    return np.floor(np.log2(np.maximum(flat - usual, 0) + 1)).astype(np.uint8)


def bitmap_bits(size: int) -> int:
    return min(max(1 << (2 * size - 1).bit_length(), MIN_BITS), MAX_BITS) if size else MIN_BITS


def bitmap(found: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, bool)
    flags[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def prefix_size(size: int) -> int:
    return size - (PERCENT * size + 99) // 100 + 1


def _describe(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                rows = []
                for _, found in shingle_sets(piece.column(1), SHINGLE):
                    size = len(found)
                    level = order[_slots(found, bits)]
                    key = (level.astype(np.uint64) << np.uint64(58)) | (mix(found) >> np.uint64(6))
                    first = np.argsort(key, kind="stable")[: prefix_size(size) if size else 0]
                    once, again = mix(found), mix(found ^ np.uint64(0xA5A5A5A5))
                    rows.append(
                        (
                            size,
                            once.sum(dtype=np.uint64).astype(np.int64) if size else 0,
                            again.sum(dtype=np.uint64).astype(np.int64) if size else 0,
                            bitmap(found, bitmap_bits(size)),
                            found[first].view(np.int64),
                        )
                    )
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                    names=["doc_id", "n", "f1", "f2", "bitmap", "prefix"],
                )

    return run


def describe(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n, f1, f2, bitmap, prefix): one row per row of docs with an id."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    return staged(
        rows.mapInArrow(
            _describe(shared, bits),
            "doc_id long, n long, f1 long, f2 long, bitmap binary, prefix array<long>",
        ),
        "sets",
    )


class Forest:
    """Which members are connected so far."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def possible_pairs(
    sizes: np.ndarray, bitmaps: list[bytes], sides: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): pairs of members whose sizes and bitmaps allow a link, band by band. With
    two sides (blocks), only pairs across them."""
    across = len(np.unique(sides)) > 1
    widths = np.array([len(b) // 8 for b in bitmaps])
    bands = {int(w): np.flatnonzero((widths == w) & (sizes > 0)) for w in np.unique(widths)}
    rows = {w: np.frombuffer(b"".join(bitmaps[i] for i in at), np.uint64).reshape(-1, w) for w, at in bands.items() if len(at)}
    for w in sorted(rows):
        for other in (w, 2 * w):
            if other not in rows:
                continue
            own, theirs = bands[w], bands[other]
            order = np.argsort(sizes[theirs], kind="stable")
            theirs = theirs[order]
            folded = _fold(rows[other], w)[order]
            for place, i in enumerate(own):
                size, bits = sizes[i], rows[w][place]
                # Larger or equal sets, up to the size that still allows a link.
                lo = np.searchsorted(sizes[theirs], size)
                hi = np.searchsorted(sizes[theirs], size * 100 // PERCENT, side="right")
                js = theirs[lo:hi]
                ok = (sizes[js] > size) | (js > i)
                if across:
                    ok &= sides[js] != sides[i]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                js, maps = js[at], folded[lo:hi][at]
                missing = np.bitwise_count(bits & ~maps).sum(axis=1, dtype=np.int64)
                extra = np.bitwise_count(maps & ~bits).sum(axis=1, dtype=np.int64)
                most = np.minimum(size - missing, sizes[js] - extra)
                fits = 100 * most >= PERCENT * (size + sizes[js] - most)
                if fits.any():
                    yield int(i), js[fits]


def _tiles(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """The rows of each tile, from rows sorted by tile (first column)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if len(rows) > 1:
                    yield list(zip(*rows))
                key, rows = row[0], []
            rows.append(row)
    if len(rows) > 1:
        yield list(zip(*rows))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"]
    )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for _, ids, sides, sizes, bitmaps in _tiles(batches, 5):
        forest = Forest(len(ids))
        for i, js in possible_pairs(np.array(sizes), list(bitmaps), np.array(sides)):
            out += [(ids[i], ids[j]) for j in js.tolist() if forest.join(i, j)]
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on sorted distinct shingles."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for _, ids, sides, texts in _tiles(_with_sets(batches), 4):
        sets = [np.frombuffer(t, np.uint64) for t in texts]
        sizes = np.array([len(s) for s in sets])
        bitmaps = [bitmap(s, bitmap_bits(len(s))) for s in sets]
        forest = Forest(len(ids))
        for i, js in possible_pairs(sizes, bitmaps, np.array(sides)):
            for j in js.tolist():
                if forest.find(i) != forest.find(j) and linked(sets[i], sets[j]):
                    forest.join(i, j)
                    out.append((ids[i], ids[j]))
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in place of the texts (last column), some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            sets = [found.tobytes() for _, found in shingle_sets(piece.column(3), SHINGLE)]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:3], pa.array(sets, pa.binary())], names=["tile", "a", "side", "set"]
            )


def _dealt(rows: DataFrame, tile: str = "tile") -> DataFrame:
    return rows.repartition(blocks_of(rows.sparkSession), tile).sortWithinPartitions(tile)


def prefix_groups(reps: DataFrame) -> DataFrame:
    """(shingle, blocks, side, members): the classes with a prefix shingle, those of a frequent
    one dealt in blocks; at most 2 * BLOCK members, but for the chance of the deal."""
    rows = reps.select("doc_id", F.explode("prefix").alias("shingle"))
    frequent = rows.groupBy("shingle").count().filter(F.col("count") > 2 * BLOCK)
    frequent = staged(frequent.select("shingle", F.ceil(F.col("count") / BLOCK).alias("blocks")), "frequent")
    few = frequent.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(frequent) if few else in_two_stages(frequent), "shingle", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("doc_id"), "blocks"))
    return rows.groupBy("shingle", "blocks", "side").agg(F.sort_array(F.collect_set("doc_id")).alias("members"))


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, per tile, of pairs that bitmaps do not rule out."""
    groups = prefix_groups(reps)
    # Most pairs share many shingles: equal groups are one tile.
    single = groups.filter("blocks = 1 and size(members) > 1").select("members").distinct()
    whole = single.select(
        F.xxhash64("members").alias("tile"), F.lit(0).cast("long").alias("side"), F.explode("members").alias("doc_id")
    )
    # Blocks of a larger group: each meets itself and every other one.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = groups.filter("blocks > 1").select("shingle", "blocks", "side", F.explode("members").alias("doc_id"))
    split = dealt.select("shingle", "side", "doc_id", other).select(
        F.xxhash64("shingle", F.least("side", "other"), F.greatest("side", "other")).alias("tile"),
        "side",
        "doc_id",
    )
    placed = whole.unionByName(split).join(reps.select("doc_id", "n", "bitmap"), "doc_id")
    tiles = _dealt(placed.select("tile", "doc_id", "side", "n", "bitmap"))
    return tiles.mapInArrow(_candidates, "a long, b long")


def verified_edges(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, per tile, of the links within candidate groups."""
    sized = groups.join(reps.select(F.col("doc_id").alias("node"), "n"), "node")
    share = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    counts = sized.groupBy("component").agg(share.alias("blocks"))
    placed = groups.join(in_two_stages(counts), "component").select(
        F.col("node").alias("doc_id"),
        "component",
        "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"),
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = texts.join(placed, "doc_id").select("doc_id", "component", "side", "text", other).select(
        F.xxhash64("component", F.least("side", "other"), F.greatest("side", "other")).alias("tile"),
        "doc_id", "side", "text",
    )
    return _dealt(rows).mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs with an id. component_id
    is the smallest id reachable by links, its own included."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = describe(docs, bits)
    full = sets.filter("n > 0")
    classes = staged(
        full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")),
        "classes",
    )
    # Rows with one id but different sets link their classes.
    members = staged(
        full.select("doc_id", "n", "f1", "f2").join(in_two_stages(classes.drop("last")), ["n", "f1", "f2"]).select("doc_id", "n", "rep"),
        "members",
    )
    same_id = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    candidates = components(candidate_edges(reps))
    links = verified_edges(docs, reps, candidates).union(same_id.filter("a <> b").select("a", "b"))
    found = components(links)
    labelled = members.join(
        in_two_stages(found.withColumnRenamed("node", "rep")), "rep", "left"
    )
    empty = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = labelled.select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    return every.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d
LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
