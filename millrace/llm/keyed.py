"""Rows told apart by (doc_id, tag), also where ids are null or shared, and what operators
that look for first places need of them.

tag is 0 while all ids differ, else a hash of the text. Documents are ordered by id, null
first, then tag; rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks_of

KEYS = "doc_id long, tag long"


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, text) of all rows, and of distinct documents; text as it is."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.select("doc_id", F.lit(0).cast("long").alias("tag"), "text")
        return rows, rows
    # A null text and an empty one are two documents.
    tag = F.coalesce(F.xxhash64("text"), F.lit(0)) + F.col("text").isNull().cast("long")
    rows = rows.select("doc_id", tag.alias("tag"), "text")
    return rows, rows.dropDuplicates(["doc_id", "tag"])


def order_of(doc_id: pa.Array, tag: np.ndarray) -> np.ndarray:
    """Rank of each row's document among the rows; equal documents rank equally."""
    known = np.asarray(doc_id.is_valid())
    ids = np.asarray(doc_id.fill_null(0))
    order = np.lexsort((tag, ids, known))
    fresh = np.ones(order.size, bool)
    fresh[1:] = (
        (np.diff(tag[order]) != 0) | (np.diff(ids[order]) != 0) | (known[order][1:] != known[order][:-1])
    )
    rank = np.empty(order.size, np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, dealt by the first of them, in the order of documents."""
    dealt = rows.repartition(blocks_of(rows.sparkSession), keys[0])
    return dealt.sortWithinPartitions(*keys, F.col("doc_id").asc_nulls_first(), "tag", "place")


def first_places(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, place): of the rows that are equal in (m, c), the first."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            m, c = np.asarray(batch["m"]), np.asarray(batch["c"])
            if not m.size:
                continue
            fresh = np.ones(m.size, bool)
            fresh[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
            fresh[0] = last != (m[0], c[0])
            last = (m[-1], c[-1])
            yield batch.select(["doc_id", "tag", "place"]).filter(pa.array(fresh))

    return in_order(rows, "m", "c").mapInArrow(firsts, f"{KEYS}, place long")


def same_document(d: str, t: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("tag") == F.col(t))


def with_lists(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with the columns of the one row that rows has of their document, or nulls."""
    rows = rows.withColumnsRenamed({"doc_id": "d", "tag": "t"})
    return docs.join(rows, same_document("d", "t"), "left").drop("d", "t")


def lists_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with its lists of the columns, named with an s. They hold places
    in its text, so they are bounded by the text's length."""
    return rows.groupBy("doc_id", "tag").agg(*[F.collect_list(c).alias(f"{c}s") for c in columns])
