"""Ranked lexical search by presence masks (operator 11).

One pass over the documents keeps, per document, its number of terms and its counts of the
items' terms. Then each task takes its documents in blocks. A block holds one bitmap per
term; for an item, the bitmaps of its terms, turned on their side, give every document its
presence mask, and the documents are grouped by equal masks. A mask's maximum score is the
sum, over its terms, of the largest contribution that the term has anywhere in the block.
Masks are evaluated by descending maximum, exactly and in integers, until the maximum of the
next is below the k-th score found; equal maxima are still evaluated, since ties go to the
smaller id. Thresholds carry over from block to block of a task, and a shuffle moves at most
k rows per item and task.

Items are taken in passes of about PASS_TERMS different terms; a pass (terms, weights, term
lists) is all that is broadcast. Counts, lengths and document frequencies are of all
documents. A document of any length is one row of counts; no term or document is skipped.

Defined results: null text has no term; documents with a null id count in the statistics but
can't be listed; items are distinct pairs of id and set of terms, so equal rows count once
and rows that share an id are items of their own; items without a term and items that no
document matches give no row; documents that share an id are ranked each; a document's
text is ranked whole; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ship, staged

K = 10
PASS_TERMS = 20_000
#: Documents per block: bounds a task's bitmaps to terms x BLOCK bits.
BLOCK = 8_192
#: Documents evaluated between two looks at the threshold, but for larger masks.
STRIDE = 256
#: Fixed values of the score.
WEIGHT, GAIN, FLAT, SLOPE, LENGTH = 1_000, 1_000_000_000, 10, 90, 8
#: Bytes of terms stay, A-Z in lower case; all other ASCII bytes part terms.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["item_id"], pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"]
        )


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms): distinct items with their sorted different terms."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_item_terms, "item_id long, terms array<binary>")
    return found.filter(F.size("terms") > 0).distinct()


def passes(items: DataFrame, limit: int) -> Iterator[tuple[list[bytes], list[tuple[int | None, np.ndarray]]]]:
    """Parts of the items with their different terms: about ``limit`` terms a part."""
    places: dict[bytes, int] = {}
    part: list[tuple[int | None, np.ndarray]] = []
    for item_id, terms in items.toLocalIterator():
        part.append((item_id, np.array([places.setdefault(bytes(t), len(places)) for t in terms], np.int64)))
        if len(places) >= limit:
            yield list(places), part
            places, part = {}, []
    if part:
        yield list(places), part


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) per document with a term: all its terms' number, and the
    places in ``terms`` of those it holds with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            ids, totals, found, counts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                held = Counter(words)
                held = {places[t]: n for t, n in held.items() if t in places}
                ids.append(doc_id)
                totals.append(len(words))
                found.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")


def weights(documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array(
        [math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * f + 1))) for f in frequencies.tolist()],
        np.int64,
    )


def length_terms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each document: in Python integers where 64 bits would not hold the product."""
    if n.size and SLOPE * int(n.max()) * documents < 2**63:
        return FLAT + SLOPE * n * documents // total
    return np.array([FLAT + SLOPE * x * documents // total for x in n.tolist()], np.int64)


class Block:
    """Documents of a task with one bitmap and one posting list per term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, at: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> None:
        self.ids = ids
        order = np.argsort(terms, kind="stable")
        terms, self.at, counts = terms[order], at[order], counts[order]
        self.gain = weight[terms] * (GAIN * counts // (1_000 * counts + LENGTH * m[self.at]))
        self.terms, self.first = np.unique(terms, return_index=True)
        self.last = np.append(self.first[1:], terms.size)
        self.most = np.maximum.reduceat(self.gain, self.first) if terms.size else self.gain
        self.bitmaps = np.zeros((self.terms.size, -(-ids.size // 8)), np.uint8)
        rows = np.repeat(np.arange(self.terms.size), self.last - self.first)
        bits = np.uint8(128) >> (self.at & 7).astype(np.uint8)
        np.bitwise_or.at(self.bitmaps, (rows, self.at >> 3), bits)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct masks over the terms in ``rows`` as a boolean table, and each document's
        mask by its number."""
        present = np.unpackbits(self.bitmaps[rows], axis=1, count=self.ids.size)
        packed = np.packbits(present, axis=0)
        words = np.zeros((-(-rows.size // 64) * 8, self.ids.size), np.uint8)
        words[: packed.shape[0]] = packed
        keys = np.ascontiguousarray(words.T).view(np.uint64)
        if keys.shape[1] == 1:
            _, first, group = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, group = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        return present[:, first].astype(bool).T, group.reshape(-1)

    def best(self, item: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of documents that hold the block's k best, all that score at
        least ``floor``, and the number of documents evaluated."""
        rows = np.flatnonzero(np.isin(self.terms, item))
        none = np.zeros(0, np.int64)
        if not rows.size:
            return none, none, 0
        held, group = self.masks(rows)
        bound = held.astype(np.int64) @ self.most[rows]
        members = np.argsort(-bound[group], kind="stable")
        members = members[bound[group[members]] > 0]
        bounds = bound[group[members]]
        scores = np.zeros(self.ids.size, np.int64)
        kept, least, done = [none], max(floor, 1), 0
        while done < members.size and bounds[done] >= least:
            # Whole masks only: those that end within the stride, but one at least.
            stop = min(done + STRIDE, members.size)
            if stop < members.size:
                stop = int(np.searchsorted(-bounds, -bounds[stop], "left"))
            if stop <= done:
                stop = int(np.searchsorted(-bounds, -bounds[done], "right"))
            chosen = members[done:stop]
            wanted = np.zeros(self.ids.size, bool)
            wanted[chosen] = True
            for row in rows:
                part = slice(self.first[row], self.last[row])
                at = self.at[part]
                hit = wanted[at]
                scores[at[hit]] += self.gain[part][hit]  # a term has a document once
            kept.append(chosen[scores[chosen] >= least])
            done = stop
            found = np.concatenate(kept)
            if found.size >= k:
                least = max(least, int(np.partition(scores[found], found.size - k)[found.size - k]))
        found = np.concatenate(kept)
        found = found[scores[found] >= least]
        return found, scores[found], done


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    ship(spark)
    items = staged(items_of(benchmark), "rank-items")
    out = None
    for number, (terms, part) in enumerate(passes(items, pass_terms)):
        rows = staged(counted(docs, terms), "rank-counts")
        documents, total = rows.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        found = rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        frequencies = np.zeros(len(terms), np.int64)
        for t, n in found:  # at most as many as the pass has terms
            frequencies[t] = n
        shared = spark.sparkContext.broadcast(
            (weights(documents, frequencies), [t for _, t in part], documents, int(total))
        )

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weight, items, documents, total = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
            for ids, n, at, held, counts in _blocks(batches):
                block = Block(ids, length_terms(n, documents, total), at, held, counts, weight)
                for i, item in enumerate(items):
                    floor = int(best[i][1][-1]) if best[i][1].size == k else 1
                    places, scores, _ = block.best(item, k, floor)
                    if places.size:
                        best[i] = _merge(
                            np.append(best[i][0], ids[places]), np.append(best[i][1], scores), k
                        )
            sizes = [b[0].size for b in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(len(items)), sizes)),
                        pa.array(np.concatenate([b[0] for b in best])),
                        pa.array(np.concatenate([b[1] for b in best])),
                    ],
                    ["item", "doc_id", "score"],
                )

        listed = rows.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        found = listed.mapInArrow(search, "item long, doc_id long, score long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(part)], "i long, item_id long")
        found = found.join(names, F.col("item") == F.col("i")).select("item_id", "rank", "doc_id", "score")
        found = staged(found, f"rank-{number}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches gathered to BLOCK documents: ids, n, and the entries as (document, term, count)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[np.ndarray, ...]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["terms"].combine_chunks()
        lengths = np.asarray(lists.value_lengths())
        return (
            np.asarray(table["doc_id"]),
            np.asarray(table["n"]),
            np.repeat(np.arange(table.num_rows), lengths),
            np.asarray(lists.flatten()).astype(np.int64),
            np.asarray(table["counts"].combine_chunks().flatten()),
        )

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == BLOCK:
                yield block()
                held, size = [], 0
    if size:
        yield block()


SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths),
weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, total GROUP BY term, docs
),
queries AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
        // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l)))) AS BIGINT) AS score
    FROM queries JOIN weight USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), total
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0
)
WHERE rank <= 10
"""
