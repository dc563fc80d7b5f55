"""Removal of repeated byte strings by a column-wise suffix array of many texts (operator 13).

Every byte covered by a string of SPAN bytes that also starts earlier goes (earlier: in a
smaller document, or in the same one before). A window is a string of SPAN bytes.

The collection is dealt into small collections that share no window: each window belongs to
its minimiser, the least hash among its substrings of ANCHOR bytes, and consecutive windows
with one minimiser form a segment of at most SPAN windows. Equal windows have equal
minimisers, so a collection of whole minimisers can be sorted by itself. In each, the suffix
array is built column by column (``column_bwt``): one symbol per string each round, updating
the collection's Burrows-Wheeler transform and its common prefixes. Runs of suffixes with
SPAN bytes in common are equal windows; all but the first are removed. Segments are at most
2 * SPAN - 1 bytes, so the rounds do not depend on the length of documents. The sequential
files of each round are arrays: a collection is bounded to BATCH strings, and executors' own
disks must not be used.

Before that, segments are pre-aggregated by 121 bits of hash (minimiser and content), first
in each task: of equal segments only the first enters a collection, since the windows of the
others start earlier there; and segments whose minimiser no other segment has, and which hold
it once, can repeat no window and need no sorting. A minimiser with more than BATCH different segments has its
windows dealt one by one, by 128 bits of hash: exact as well, and a group is then one window
whose copies were pre-aggregated.

Only documents' keys and places travel between the steps; texts are shuffled twice, to cut
the strings to sort and to cut the result.

Defined results: null text counts as empty; documents are ordered by id, null first, and
those that share an id by a hash of the text; equal rows are one document, and each gets its
result; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.column_bwt import collection
from millrace.llm.common import ship, staged
from millrace.llm.keyed import KEYS, in_order, keyed, lists_of, order_of, with_lists

SPAN = 100
ANCHOR = 32
#: Strings of one minimiser that are sorted together, at most; others are gathered to so many.
BATCH = 8_192
GATHERED = 4_096
#: Bytes hashed at once: their hashes fit a core's cache.
CHUNK = 1 << 15
#: Segments held in a task before they are pre-aggregated and handed on.
HELD = 200_000
#: A place in a document is start << PLACE | number of windows << 1 | to be sorted.
PLACE = 9
#: Bits of a minimiser that tell its places apart: 2**LOW is more than a window's places.
LOW = 7



def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(values: np.ndarray, width: int, which: int) -> np.ndarray:
    """A hash of each substring of ``width`` bytes (along the last axis), from those of its halves."""
    power = np.uint64(_BASES[which])
    span, part = 1, _table(which)[values]
    out, covered = None, 0
    while True:
        if width & span:
            if out is None:
                out = part
            else:
                size = part.shape[-1] - covered
                out = out[..., :size] * power + part[..., covered:]
            covered += span
        if covered == width:
            return _mixed(out)
        part = part[..., :-span] * power + part[..., span:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        span *= 2


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, along the last axis."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[..., :-span], x[..., span:])
        span *= 2
    rest = width - span
    return np.minimum(x[..., :-rest], x[..., rest:]) if rest else x


class Sums:
    """Hashes of substrings of any length, from running sums."""

    def __init__(self, size: int) -> None:
        base = _BASES[1]
        self.table = _table(2)
        self.up, self.down = (
            np.append(np.uint64(1), np.cumprod(np.full(size, b, np.uint64)))
            for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
        )

    def __call__(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        sums = np.append(np.uint64(0), np.cumsum(self.table[values] * self.up[: values.size]))
        return _mixed((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def minimisers(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each window, and whether two of its places hold it: the low bits
    give way to the place, once rising and once falling, so that these differ."""
    low = np.uint64((1 << LOW) - 1)
    place = np.arange(hashes.shape[-1], dtype=np.uint64) & low
    rising = least_of(hashes & ~low | place, width)
    falling = least_of(hashes & ~low | (low - place), width)
    return rising & ~low, (rising & low) != low - (falling & low)


def segments(
    values: np.ndarray, ends: np.ndarray, span: int, anchor: int, sums: Sums, chunk: int
) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimiser, content, document, start, windows, twice) of the segments of texts that
    stand behind each other in values; ends: where each ends. In chunks; start counts in the
    text. twice: a window may repeat within the segment. For that its minimiser must stand in
    two places, either within one window or so far apart that the segment is longer than
    the windows around one place."""
    begins = np.append(0, ends[:-1])
    for at in range(0, values.size - span + 1, chunk):
        part = values[at : at + chunk + span - 1]
        size = part.size - span + 1
        least, double = minimisers(window_hashes(part, anchor, 0), span - anchor + 1)
        doubles = np.append(0, np.cumsum(double))
        # Windows of texts that meet this chunk: [from, to) of each.
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + size, "left")
        docs = np.arange(low, high)
        first = np.maximum(begins[docs] - at, 0)
        stop = np.minimum(ends[docs] - at - span + 1, size)
        docs, first, stop = (x[stop > first] for x in (docs, first, stop))
        if not docs.size:
            continue
        new = np.zeros(size + 1, bool)
        new[1:-1] = least[1:] != least[:-1]
        new[first] = new[stop] = True
        inside = np.zeros(size + 1, np.int8)
        inside[first] += 1
        inside[stop] -= 1
        starts = np.flatnonzero(new)
        within = np.cumsum(inside)[starts] > 0
        lengths = np.diff(np.append(starts, size))[within]
        starts = starts[within]
        pieces = -(-lengths // span)
        run = np.repeat(np.arange(starts.size), pieces)
        offset = span * (np.arange(run.size) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        start = starts[run] + offset
        windows = np.minimum(span, lengths[run] - offset)
        doc = docs[np.searchsorted(first, start, "right") - 1]
        content = sums(part, start, start + windows + span - 1)
        twice = (doubles[start + windows] > doubles[start]) | (windows > span - anchor + 1)
        yield least[start], content, doc, start + at - begins[doc], windows, twice.astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other and where each ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _rows(minimiser: np.ndarray, content: np.ndarray, doc_id: pa.Array, tag: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(minimiser.view(np.int64)),
            pa.array(content.view(np.int64)),
            doc_id,
            pa.array(tag),
            pa.array(place),
        ],
        ["m", "c", "doc_id", "tag", "place"],
    )


def first_segments(docs: DataFrame, span: int, anchor: int, chunk: int) -> DataFrame:
    """(m, c, doc_id, tag, place): of equal segments within a part of a task, the first."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(chunk + span)
        for batch in batches:
            values, ends = utf8(batch["text"])
            tag = np.asarray(batch["tag"])
            rank = order_of(batch["doc_id"], tag)
            held: list[tuple[np.ndarray, ...]] = []

            def firsts(batch=batch, tag=tag, rank=rank) -> pa.RecordBatch:
                m, c, doc, start, windows, twice = map(np.concatenate, zip(*held, strict=True))
                order = np.lexsort((start, rank[doc], c, m))
                m, c = m[order], c[order]
                fresh = np.ones(m.size, bool)
                fresh[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
                kept = order[fresh]
                place = (start[kept] << PLACE) | (windows[kept] << 1) | twice[kept]
                return _rows(m[fresh], c[fresh], batch["doc_id"].take(pa.array(doc[kept])), tag[doc[kept]], place)

            for part in segments(values, ends, span, anchor, sums, chunk):
                held.append(part)
                if sum(p[0].size for p in held) >= HELD:
                    yield firsts()
                    held = []
            if held:
                yield firsts()

    return docs.mapInArrow(found, f"m long, c long, {KEYS}, place long")


def collapsed(rows: DataFrame, batch: int) -> DataFrame:
    """(doc_id, tag, place, many): of equal rows by (m, c), the first. place says whether the
    minimiser has other segments; many, that it has more than ``batch`` different ones."""

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tag", "place"]
        held: list[pa.RecordBatch] = []  # of the minimiser that the last batch ended in
        last: tuple[int, int] | None = None
        size, open_m, many = 0, None, False

        def out(rows: pa.RecordBatch, shared: np.ndarray, many: bool) -> pa.RecordBatch:
            place = pa.array(np.asarray(rows["place"]) | shared)
            flags = pa.array(np.full(rows.num_rows, many))
            return pa.RecordBatch.from_arrays([rows["doc_id"], rows["tag"], place, flags], [*names, "many"])

        def close() -> Iterator[pa.RecordBatch]:
            for part in held:
                yield out(part, np.full(part.num_rows, int(size > 1)), many)

        for rows in batches:
            m, c = np.asarray(rows["m"]), np.asarray(rows["c"])
            if not m.size:
                continue
            fresh = np.ones(m.size, bool)
            fresh[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
            fresh[0] = last != (m[0], c[0])
            last = (m[-1], c[-1])
            rows = rows.select(names).filter(pa.array(fresh))
            m = m[fresh]
            # The batch's part of the minimiser that is open.
            head = int(np.searchsorted(m != open_m, True)) if open_m is not None else 0
            if head:
                held.append(rows.slice(0, head))
                size += head
                if size > batch:
                    many = True
                    yield from close()
                    held = []
            if head == m.size:
                continue
            yield from close()
            rows, m = rows.slice(head), m[head:]
            begins = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            sizes = np.diff(np.append(begins, m.size))
            whole = int(begins[-1])
            if whole:
                large = np.repeat(sizes[:-1] > batch, sizes[:-1])
                shared = np.repeat((sizes[:-1] > 1).astype(np.int64), sizes[:-1])
                done = rows.slice(0, whole)
                for flag in (False, True):
                    if (large == flag).any():
                        yield out(done.filter(pa.array(large == flag)), shared[large == flag], flag)
            held, open_m, size = [rows.slice(whole)], m[-1], m.size - whole
            many = size > batch
        yield from close()

    return in_order(rows, "m", "c").mapInArrow(pass_over, f"{KEYS}, place long, many boolean")


def cut(rows: DataFrame, span: int, anchor: int, windows: bool) -> DataFrame:
    """The strings at ``places`` of each text: whole segments with their minimiser, or the
    hashes of their windows one by one as (m, c, doc_id, tag, place)."""

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = utf8(batch["text"])
            begins = np.append(0, ends[:-1])
            lists = batch["places"]
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            places = np.asarray(lists.flatten())
            tag = np.asarray(batch["tag"])
            for some in range(0, doc.size, HELD // span):
                d, p = doc[some : some + HELD // span], places[some : some + HELD // span]
                start, count = p >> PLACE, (p & ((1 << PLACE) - 1)) >> 1
                index = begins[d][:, None] + start[:, None] + np.arange(2 * span - 1)
                parts = values[np.minimum(index, values.size - 1)]
                valid = np.arange(span) < count[:, None]
                hashes = [window_hashes(parts, span, which) for which in (0, 1)]
                row, offset = np.nonzero(valid)
                at = ((start[row] + offset) << PLACE) | (1 << 1)
                yield _rows(
                    hashes[0][row, offset],
                    hashes[1][row, offset],
                    batch["doc_id"].take(pa.array(d[row])),
                    tag[d[row]],
                    at,
                )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = utf8(batch["text"])
            begins = np.append(0, ends[:-1])
            lists = batch["places"]
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            places = np.asarray(lists.flatten())
            tag = np.asarray(batch["tag"])
            for some in range(0, doc.size, HELD // span):
                d, p = doc[some : some + HELD // span], places[some : some + HELD // span]
                start, count = p >> PLACE, (p & ((1 << PLACE) - 1)) >> 1
                first = begins[d] + start
                last = first + count + span - 1
                strings = [values[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
                heads = values[first[:, None] + np.arange(span)]
                least = minimisers(window_hashes(heads, anchor, 0), span - anchor + 1)[0][:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(least).view(np.int64)),
                        pa.array(strings, pa.binary()),
                        batch["doc_id"].take(pa.array(d)),
                        pa.array(tag[d]),
                        pa.array(start),
                    ],
                    ["m", "string", "doc_id", "tag", "start"],
                )

    if windows:
        return rows.mapInArrow(one_by_one, f"m long, c long, {KEYS}, place long")
    return rows.mapInArrow(whole, f"m long, string binary, {KEYS}, start long")


def repeated_windows(strings: list[bytes], rank: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to): runs of windows of the strings, whose like starts earlier, with
    from and to counted in the text that the string starts in at ``start``."""
    lengths = np.array([len(s) for s in strings])
    symbols = np.zeros((len(strings), int(lengths.max())), np.uint8)
    for row, s in zip(symbols, strings):
        row[: len(s)] = np.frombuffer(s, np.uint8)[::-1]
    symbols += np.arange(symbols.shape[1]) < lengths[:, None]
    string, length, common = collection(symbols, lengths)
    group = np.cumsum(common < span)
    whole = length >= span
    string, length, group = string[whole], length[whole], group[whole]
    alike = np.zeros(group.size, bool)
    same = group[1:] == group[:-1]
    alike[1:] |= same
    alike[:-1] |= same
    string, length, group = string[alike], length[alike], group[alike]
    at = start[string] + lengths[string] - length
    order = np.lexsort((at, rank[string], group))
    later = order[1:][group[order][1:] == group[order][:-1]]
    string, at = string[later], at[later]
    order = np.lexsort((at, string))
    string, at = string[order], at[order]
    fresh = np.ones(at.size, bool)
    fresh[1:] = (np.diff(string) != 0) | (np.diff(at) != 1)
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], at.size) - 1
    return string[begins], at[begins], at[ends[: begins.size]] + 1


def sorted_repeats(strings: DataFrame, span: int) -> DataFrame:
    """(doc_id, tag, from, to): runs of windows that start earlier in another string of
    their minimiser, or in the same."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            doc_id, tag = rows["doc_id"].combine_chunks(), np.asarray(rows["tag"])
            rank = order_of(doc_id, tag)
            found, first, last = repeated_windows(
                rows["string"].to_pylist(), rank, np.asarray(rows["place"]), span
            )
            return pa.RecordBatch.from_arrays(
                [doc_id.take(pa.array(found)), pa.array(tag[found]), pa.array(first), pa.array(last)],
                ["doc_id", "tag", "from", "to"],
            )

        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            # Whole minimisers only; one has at most BATCH strings.
            for at in range(0, rows.num_rows, GATHERED):
                held.append(rows.slice(at, GATHERED))
                size += held[-1].num_rows
                if size < GATHERED:
                    continue
                table = pa.Table.from_batches(held)
                m = np.asarray(table["m"])
                edge = int(np.flatnonzero(np.append(True, m[1:] != m[:-1]))[-1])
                if edge:
                    yield solved(table.slice(0, edge))
                    held, size = table.slice(edge).to_batches(), table.num_rows - edge
        if size:
            yield solved(pa.Table.from_batches(held))

    return in_order(strings.withColumnRenamed("start", "place"), "m").mapInArrow(sort, f"{KEYS}, `from` long, `to` long")


def _removed(places: np.ndarray, froms: np.ndarray, tos: np.ndarray, windows: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs to remove: those of windows that no place keeps, and of the runs given."""
    places = np.sort(places)
    start, count = places >> PLACE, (places & ((1 << PLACE) - 1)) >> 1
    gap_from = np.append(0, start + count)
    gap_to = np.append(start, windows)
    open_ = gap_to > gap_from
    first = np.append(gap_from[open_], froms)
    last = np.append(gap_to[open_], tos) + span - 1
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    fresh = np.ones(first.size, bool)
    fresh[1:] = first[1:] > last[:-1]
    begins = np.flatnonzero(fresh)
    return first[begins], last[np.append(begins[1:], first.size) - 1] if begins.size else last


def removed_runs(
    docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, batch: int = BATCH, chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, text, firsts, lasts): byte runs of each row's text that are removed."""
    if not 0 < anchor <= span <= 1 << LOW:
        raise ValueError(f"anchor must be at most span, and span at most {1 << LOW}")
    spark = docs.sparkSession
    ship(spark)
    rows, distinct = keyed(docs)

    found = staged(collapsed(first_segments(rows, span, anchor, chunk), batch), "suffix-segments")
    kept = found.filter(~F.col("many")).select("doc_id", "tag", "place")

    def texts_at(places: DataFrame) -> DataFrame:
        return with_lists(distinct, lists_of(places, "place")).filter(F.col("places").isNotNull())

    strings = cut(texts_at(kept.filter(F.col("place") % 2 == 1)), span, anchor, windows=False)
    runs = staged(sorted_repeats(strings, span), "suffix-runs")
    many = found.filter("many")
    if not many.isEmpty():
        single = cut(texts_at(many.select("doc_id", "tag", "place")), span, anchor, windows=True)
        kept = kept.unionByName(collapsed(single, batch).select("doc_id", "tag", "place"))

    lists = lists_of(kept, "place")
    joined = with_lists(rows, with_lists(lists, lists_of(runs, "from", "to")))
    none = np.zeros(0, np.int64)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes = np.diff(np.append(0, utf8(part["text"])[1]))
            firsts, lasts = [], []
            columns = [part[c] for c in ("places", "froms", "tos")]
            for number, size in enumerate(sizes.tolist()):
                if size < span:
                    first = last = none
                else:
                    lists = [c[number].values for c in columns]
                    lists = [none if x is None else np.asarray(x) for x in lists]
                    first, last = _removed(*lists, size - span + 1, span)
                firsts.append(first)
                lasts.append(last)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text"], *(pa.array(x, pa.list_(pa.int64())) for x in (firsts, lasts))],
                ["doc_id", "text", "firsts", "lasts"],
            )

    return joined.mapInArrow(runs_of, "doc_id long, text string, firsts array<long>, lasts array<long>")


def removal_digests(runs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of the rows of removed_runs."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = utf8(batch["text"])
            begins = np.append(0, ends[:-1])
            view = memoryview(values)
            sizes, removed, spans, kept = [], [], [], []
            for begin, end, firsts, lasts in zip(
                begins.tolist(), ends.tolist(), batch["firsts"].to_pylist(), batch["lasts"].to_pylist()
            ):
                digest, at, gone = hashlib.sha256(), begin, 0
                for first, last in zip(firsts, lasts):
                    digest.update(view[at : begin + first])
                    at = begin + last
                    gone += last - first
                digest.update(view[at:end])
                sizes.append(end - begin)
                removed.append(gone)
                spans.append(len(firsts))
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, (sizes, removed, spans)), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return runs.mapInArrow(
        digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (
    SELECT doc_id, length(h) // 2 AS n, k, substr(h, CAST(200 * k + 1 AS BIGINT), 398) AS part
    FROM texts, unnest(generate_series(0, length(h) // 200)) AS u(k)
),
windows AS (
    SELECT doc_id, n, 100 * k + j AS start, substr(part, CAST(2 * j + 1 AS BIGINT), 200) AS w
    FROM chunks, unnest(generate_series(0, 99)) AS v(j)
    WHERE 100 * k + j + 100 <= n
),
later AS (
    SELECT doc_id, start FROM windows
    QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, start) > 1
),
islands AS (
    SELECT doc_id, start, sum(CASE WHEN start - before <= 100 THEN 0 ELSE 1 END)
        OVER (PARTITION BY doc_id ORDER BY start) AS island
    FROM (SELECT doc_id, start, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM later)
),
runs AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM islands GROUP BY doc_id, island),
edges AS (
    SELECT doc_id, a, b FROM runs
    UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM texts
),
kept AS (
    SELECT e.doc_id, e.a AS pos, substr(h, CAST(2 * coalesce(lag(e.b) OVER o, 0) + 1 AS BIGINT),
        CAST(2 * (e.a - coalesce(lag(e.b) OVER o, 0)) AS BIGINT)) AS part
    FROM edges e JOIN texts USING (doc_id) WINDOW o AS (PARTITION BY e.doc_id ORDER BY e.a, e.b)
),
joined AS (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY pos))) AS kept_sha256 FROM kept GROUP BY doc_id),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
    coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM texts JOIN joined USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
