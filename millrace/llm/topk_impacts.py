"""Exact top-k inner products by an impact-ordered index (operator 3).

Each block of vectors within a task gets one index for all queries: per dimension, components
fall into LEVELS quantised impacts, and each (dimension, impact) is a posting segment of the
vectors that have it. A query's segments are processed in descending order of what they can
contribute, score at a time. A vector's upper bound is a running number: what its processed
segments give at most, and for each other dimension what the best unprocessed segment there
gives. The bar is the query's k-th score so far, from earlier blocks and from the vectors with
the best bounds. Vectors whose bound is below the bar are out on that proof; once few others
are left they are rescored exactly in integers, and a block whose bounds are all below the bar
is left at once.

Queries are taken in passes of about PASS_QUERIES; a pass is all that is broadcast. Every
pass scans every vector; tasks keep their k best per query, so a shuffle moves k rows per
query and task, whatever the vectors are. Where queries grow with the vectors, as in the
registered query, the work grows with their product: bounds lower its factor, not its order.

Defined results: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part; a query meets vectors of its own length only, and never rows
with its own id; equal query rows are one query; equal candidate rows all count; ties go
to the smaller id; other columns are ignored. Components too large for exact products in
doubles are multiplied in whole numbers of any size instead; a score among the best that
64 bits can't hold raises OverflowError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ship

K = 10
SCALE = 1024
LEVELS = 128
#: Components per index: bounds a task's memory.
BLOCK_CELLS = 1 << 19
PASS_QUERIES = 4_096
#: Shares of a block's postings that are processed before each look at the bounds.
DEPTHS = (0.5, 0.65, 0.8, 1.0)
#: Rescoring starts when at most one in RESCORE vectors of the block is possible.
RESCORE = 4


def usable(vector: Column) -> Column:
    def fine(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))

    return vector.isNotNull() & F.forall(vector, fine)


def exact(values: np.ndarray) -> list[int]:
    """floor(SCALE * x) in whole numbers of any size; SCALE is a power of two."""
    return [math.floor(x * SCALE) if abs(x) < 2.0**60 else int(x) * SCALE for x in values.tolist()]


def narrow_limit(width: int) -> int:
    """Components up to this have inner products below 2**53, exact in doubles."""
    return math.isqrt((1 << 53) // max(width, 1)) - 1


class ImpactIndex:
    """Posting segments of a block of vectors of one length, whole numbers in doubles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        count, width = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        step = np.maximum(1, np.ceil((high - low + 1) / LEVELS))
        levels = ((vectors - low) // step).astype(np.int64)
        self.dims = []
        for dim in range(width):
            # Postings by rising impact; per segment its end and its extreme components.
            postings = np.argsort(levels[:, dim], kind="stable")
            values, level = vectors[postings, dim], levels[postings, dim]
            starts = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            sizes = np.diff(np.append(starts, count))
            self.dims.append(
                (postings, starts, sizes, np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts))
            )
        self.segment_dim = np.repeat(np.arange(width), [len(d[1]) for d in self.dims])
        self.sizes = np.concatenate([d[2] for d in self.dims])
        self.least = np.concatenate([d[3] for d in self.dims])
        self.most = np.concatenate([d[4] for d in self.dims])
        self.first = np.append(0, np.cumsum([len(d[1]) for d in self.dims]))

    def bounds(self, query: np.ndarray, gains: np.ndarray, order: np.ndarray, depth: float) -> tuple[np.ndarray, int]:
        """Upper bound of every vector's score when the leading ``depth`` of all postings, by
        gain, are processed; and how many postings those are."""
        total = np.cumsum(self.sizes[order])
        done = np.zeros(order.size, bool)
        done[order[: int(np.searchsorted(total, depth * total[-1])) + 1]] = True
        upper, touched = np.zeros(len(self.ids)), 0
        for dim, (postings, starts, sizes, _, _) in enumerate(self.dims):
            part = slice(self.first[dim], self.first[dim + 1])
            gain, closed = gains[part], done[part]
            rest = gain[~closed].max() if not closed.all() else gain.min()
            upper += rest
            if closed.any():
                # A dimension's segments close from its end of larger gains.
                some = np.flatnonzero(closed)
                span = slice(starts[some[0]], starts[some[-1]] + sizes[some[-1]])
                upper[postings[span]] += np.repeat(gain[some] - rest, sizes[some])
                touched += int(sizes[some].sum())
        return upper, touched

    def search(
        self, own: int, query: np.ndarray, k: int, floor: float = -math.inf, depth: float = DEPTHS[0]
    ) -> tuple[list[tuple[int, int]], float, int, int]:
        """The vectors among the k best that score at least ``floor`` as (score, id), best
        first; the depth that sufficed; the postings processed and the vectors rescored."""
        weight = query[self.segment_dim]
        gains = np.maximum(weight * self.least, weight * self.most)
        if np.maximum.reduceat(gains, self.first[:-1]).sum() < floor:
            return [], depth, 0, 0
        order = np.argsort(-gains, kind="stable")  # equal gains of a dimension: as its postings lie
        bar, touched, scored = floor, 0, 0
        for depth in [d for d in DEPTHS if d >= depth]:
            upper, more = self.bounds(query, gains, order, depth)
            touched += more
            upper[self.ids == own] = -math.inf
            if upper.size > 2 * k:
                some = np.argpartition(-upper, 2 * k)[: 2 * k]
                some = some[upper[some] > -math.inf]
                scored += some.size
                if some.size >= k:
                    bar = max(bar, np.partition(self.vectors[some] @ query, some.size - k)[some.size - k])
            possible = np.flatnonzero((upper >= bar) & (upper > -math.inf))
            if possible.size <= max(4 * k, len(self.ids) // RESCORE):
                break
        scored += possible.size
        scores = self.vectors[possible] @ query
        top = np.lexsort((self.ids[possible], -scores))[:k]
        found = [(int(scores[i]), int(self.ids[possible[i]])) for i in top if scores[i] >= floor]
        return found, depth, touched, scored


def _wide_scores(ids: np.ndarray, vectors: list[list[int]], own: int, query: list[int]) -> list[tuple[int, int]]:
    return [
        (sum(a * b for a, b in zip(v, query, strict=True)), i)
        for i, v in zip(ids.tolist(), vectors, strict=True)
        if i != own
    ]


class Searcher:
    """The k best of each query over all blocks of a task."""

    def __init__(self, queries: dict[int, tuple[int, list[float]]], k: int):
        self.k, self.touched, self.scored = k, 0, 0
        self.best: dict[int, list[tuple[int, int]]] = {key: [] for key in queries}
        self.depth = dict.fromkeys(queries, DEPTHS[0])
        self.queries = {}
        for key, (own, values) in queries.items():
            whole = exact(np.array(values, np.float64))
            wide = max(map(abs, whole), default=0) > narrow_limit(len(whole))
            self.queries[key] = (own, whole, None if wide else np.array(whole, np.float64))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width, k = vectors.shape[1], self.k
        limit = narrow_limit(width) / SCALE
        wide = (np.abs(vectors) > limit).any(axis=1)
        asked = {key: q for key, q in self.queries.items() if len(q[1]) == width}
        if not asked:
            return
        index = None
        if width and not wide.all():
            index = ImpactIndex(ids[~wide], np.floor(vectors[~wide] * SCALE))
        for key, (own, whole, query) in asked.items():
            known = self.best[key]
            floor = known[-1][0] if len(known) == k else -math.inf
            if index is not None and query is not None:
                found, self.depth[key], touched, scored = index.search(own, query, k, floor, self.depth[key])
                self.touched += touched
                self.scored += scored
                rest = wide
            else:
                found, rest = [], np.ones(len(ids), bool)
            if rest.any():
                found = found + _wide_scores(ids[rest], [exact(v) for v in vectors[rest]], own, whole)
            self.best[key] = sorted(known + found, key=lambda f: (-f[0], f[1]))[:k]


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value  # key -> (id, components)
        searcher = Searcher(queries, k)
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat, ids = lists.values.to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            widths = np.diff(ends)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                size = max(1, BLOCK_CELLS // max(1, int(width)))
                for lo in range(0, rows.size, size):
                    part = rows[lo : lo + size]
                    own_ids, own = held.setdefault(int(width), ([], []))
                    own_ids.append(ids[part])
                    own.append(flat[ends[part][:, None] + np.arange(width)].astype(np.float64))
                    if sum(map(len, own_ids)) >= size:
                        searcher.add(np.concatenate(own_ids), np.concatenate(own))
                        del held[int(width)]
        for own_ids, own in held.values():
            searcher.add(np.concatenate(own_ids), np.concatenate(own))
        rows = [(key, queries[key][0], i, s) for key, found in searcher.best.items() for s, i in found]
        if any(not -(1 << 63) <= row[3] < 1 << 63 for row in rows):
            raise OverflowError("a score among the best does not fit 64 bits")
        if rows:
            names = ("query_key", "query_id", "vec_id", "score")
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, pass_queries: int = PASS_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best among vectors; both frames
    hold vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(
            F.col("vec_id").isNotNull() & usable(F.col("embedding"))
        )

    asked, against = rows(queries).distinct(), rows(vectors)
    passes = max(1, math.ceil(asked.count() / pass_queries))
    found = None
    for number in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).collect()
        data = {
            i * passes + number: (r.vec_id, r.embedding)
            for i, r in enumerate(sorted(some, key=lambda r: (r.vec_id, r.embedding)))
        }
        shared = spark.sparkContext.broadcast(data)
        part = against.mapInArrow(
            _search(shared, k), "query_key long, query_id long, vec_id long, score long"
        )
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH usable AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
) WHERE rank <= 10
"""
