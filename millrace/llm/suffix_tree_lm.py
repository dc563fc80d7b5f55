"""Language-model scores by a probabilistic suffix tree (operator 5).

A text is its words, lower-cased (A-Z), with a mark before and behind each, and then an
end; symbols are bytes. The tree's states are contexts: the last 0 to DEPTH symbols. A
context is retained if its next symbols diverge from what its parent (the context without
its oldest symbol) foretells: their log-likelihood gain must reach MIN_GAIN nats. Every
observed context is tested, whether its parent is retained or not, and ancestors of retained
contexts stay too. Distributions are smoothed: a context's counts are mixed with WEIGHT times its parent's distribution, the root's with equal chances of all bytes. A
symbol is scored in its longest retained suffix state. The product over a text's symbols is
the model's probability of the text; the base scores are those of its words.

How it runs. One scan packs the documents in blocks (compressed, written to the shared
folder) with the distinct words of each block and the counts of its symbols by full
context. Words and contexts are counted over all blocks by Spark; divergence tests and
smoothing are joins and sums over contexts. A word's count goes back to the blocks that
hold the word, and each block adds up its documents. So the shuffles carry a word or
context once per block and not once per occurrence, and none makes a hot key. The tree is
broadcast in parts of about PART_ROWS rows, one pass over the blocks each; the driver and an
executor hold one part at a time, and the passes grow with the tree.

Defined results: null text counts as empty and is one end; documents with a null id are
learnt from; repeated rows count as often as they stand; if nothing can be learnt from, all
bytes are equally likely; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import held_out, lower_words, ship, staged

DEPTH = 5
MIN_GAIN = 8.0
WEIGHT = 4.0
#: Rows (context, symbol) of the tree that are broadcast at once: about 64 MB.
PART_ROWS = 3_000_000
#: Symbols per block, and words or contexts per row of a block's lists.
BLOCK_BYTES = 12_000_000
LIST_ROWS = 20_000

#: The mark around words, and the end of a text: neither occurs in words.
MARK, END = b" ", b"\n"
#: Symbols handled at once; a longer text is cut, with its context carried over.
SLICE = 1_500_000
LOW = np.uint64(0xFFFF)
SPREAD = 40_503
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return [*lower_words(text), END]


def stream(words: list[bytes]) -> bytes:
    """A text's symbols; the first mark is given, not scored."""
    return MARK + MARK.join(words[:-1]) + (MARK if words[1:] else b"") + END


def symbols(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every symbol: 8 * DEPTH bits of context and 8 of symbol; and its stream."""
    group: list[tuple[int, bytes, int]] = []
    size = 0
    for owner, data in enumerate(streams):
        for lo in range(0, len(data), SLICE):
            before = min(lo, DEPTH)
            part = data[lo - before : lo + SLICE]
            group.append((owner, part, max(before, 1)))
            size += len(part)
            if size >= SLICE:
                yield _keys(group)
                group, size = [], 0
    if group:
        yield _keys(group)


def _keys(group: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(part) for _, part, _ in group])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(part for _, part, _ in group), np.uint8).astype(np.uint64)
    keys = data.copy()
    for back in range(1, DEPTH + 1):
        keys[back:] |= data[:-back] << np.uint64(8 * back)
    # Near a piece's start the context is only as long as the piece so far.
    for place in range(DEPTH):
        near = starts[sizes > place] + place
        keys[near] &= np.uint64((1 << (8 * (place + 1))) - 1)
    scored = np.ones(len(data), bool)
    for place in range(DEPTH):
        scored[[s + place for s, (_, _, skip) in zip(starts, group) if skip > place]] = False
    owner = np.repeat([owner for owner, _, _ in group], sizes)
    return keys[scored], owner[scored]


def count_symbols(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(keys, return_counts=True) for keys, _ in symbols(streams)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)


def _pack(kind: pa.DataType):
    """Blocks of documents with their distinct words and contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        names = ["block", "ids", "held_out", "texts", "words", "keys", "counts"]
        longs = pa.list_(pa.int64())
        kinds = [pa.string(), pa.list_(kind), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.string()), longs, longs]
        ids: list = []
        flags: list = []
        streams: list[bytes] = []
        seen: set[bytes] = set()
        learnt: Counter = Counter()

        def row(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([values.get(n)], k) for n, k in zip(names, kinds)], names=names
            )

        def flush() -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().hex
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(streams))
            yield row(block=block, ids=ids, held_out=flags, texts=packed)
            every = sorted(seen)
            for lo in range(0, len(every), LIST_ROWS):
                some = every[lo : lo + LIST_ROWS]
                names_here = [w.decode() for w in some]
                yield row(block=block, words=names_here, counts=[learnt[w] for w in some])
            keys, n = count_symbols([t for t, held in zip(streams, flags) if not held])
            for lo in range(0, len(keys), LIST_ROWS):
                hi = lo + LIST_ROWS
                yield row(block=block, keys=keys[lo:hi].astype(np.int64), counts=n[lo:hi])

        size = 0
        for batch in batches:
            for key, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = words_of(text)
                seen.update(found)
                if not held:
                    learnt.update(found)
                ids.append(key)
                flags.append(held)
                streams.append(stream(found))
                size += len(streams[-1])
                if size >= BLOCK_BYTES:
                    yield from flush()
                    ids, flags, streams, size = [], [], [], 0
                    seen, learnt = set(), Counter()
        if ids:
            yield from flush()

    return run


def packed(docs: DataFrame) -> DataFrame:
    """Rows of three kinds, by block: the documents; some distinct words with their counts
    in the documents to learn from; some contexts with theirs."""
    rows = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = (
        f"block string, ids array<{kind.simpleString()}>, held_out array<boolean>, "
        "texts binary, words array<string>, keys array<long>, counts array<long>"
    )
    return staged(rows.mapInArrow(_pack(to_arrow_type(kind)), schema), "blocks")


def listed(blocks: DataFrame, column: str, name: str) -> DataFrame:
    """(block, name, n) of the words or contexts of all blocks."""
    rows = blocks.filter(F.col(column).isNotNull()).select(
        "block", F.explode(F.arrays_zip(column, "counts")).alias("x")
    )
    return rows.select("block", F.col(f"x.{column}").alias(name), F.col("x.counts").alias("n"))


def grow_tree(contexts: DataFrame) -> DataFrame:
    """(level, context, symbol, p, back): the retained states, from (key, n). back is what
    a state's unseen symbols take of its parent's distribution."""
    full = staged(contexts.groupBy("key").agg(F.sum("n").alias("n")), "contexts")
    key, symbol = F.col("key"), F.col("key").bitwiseAND(255)
    levels: list[DataFrame] = []
    for level in range(DEPTH + 1):
        context = F.shiftright(key, 8).bitwiseAND((1 << (8 * level)) - 1)
        # The top byte of a state of this level must be there, or it is a shorter one's copy.
        own = full if level == 0 else full.filter(F.shiftright(key, 8 * level) > 0)
        counts = own.groupBy(context.alias("context"), symbol.alias("symbol")).agg(
            F.sum("n").alias("n")
        )
        if level == 0:
            state = counts.withColumn("above", F.lit(1 / 256))
        else:
            up = F.col("context").bitwiseAND((1 << (8 * (level - 1))) - 1)
            parent = levels[-1].select(F.col("context").alias("up"), "symbol", F.col("p").alias("above"))
            state = counts.withColumn("up", up).join(parent, ["up", "symbol"])
        of_context = Window.partitionBy("context")
        state = state.withColumn("total", F.sum("n").over(of_context))
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("above")))
        state = state.withColumn("fit", gain.over(of_context) >= MIN_GAIN)
        if level == DEPTH:
            state = state.filter("fit")  # nothing hangs on the others
        rows = state.select(
            F.lit(level).alias("level"),
            "context",
            "symbol",
            ((F.col("n") + WEIGHT * F.col("above")) / (F.col("total") + WEIGHT)).alias("p"),
            (WEIGHT / (F.col("total") + WEIGHT)).alias("back"),
            "fit",
        )
        levels.append(staged(rows, f"level{level}"))
    kept = levels[DEPTH].drop("fit")
    tree = kept
    for level in range(DEPTH - 1, -1, -1):
        rows = levels[level]
        if level:
            # Ancestors of what is retained below.
            up = F.col("context").bitwiseAND((1 << (8 * level)) - 1)
            older = kept.select(up.alias("context")).distinct().withColumn("older", F.lit(True))
            rows = rows.join(older, "context", "left").filter(F.col("fit") | F.col("older").isNotNull())
        kept = staged(rows.select("level", "context", "symbol", "p", "back"), f"kept{level}")
        tree = tree.unionByName(kept)
    return tree


class Tree:
    """A part of the tree as sorted arrays by level."""

    def __init__(self, level, context, symbol, p, back):
        self.levels = []
        for k in range(DEPTH + 1):
            own = level == k
            keys = (context[own].astype(np.uint64) << np.uint64(8)) | symbol[own].astype(np.uint64)
            order = np.argsort(keys)
            keys, logs = keys[order], np.log10(p[own][order])
            states, first = np.unique(keys >> np.uint64(8), return_index=True)
            self.levels.append((keys, logs, states, np.log10(back[own][order][first])))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its longest retained state."""
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        for k in range(DEPTH, -1, -1):
            rows, logs, states, back = self.levels[k]
            some = np.flatnonzero(open_)
            # A state of this level needs a context that is long enough.
            if k:
                some = some[(keys[some] >> np.uint64(8 * k)) > 0]
            if not len(rows) or not len(some):
                continue
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            own = keys[some] & mask
            at = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
            hit = rows[at] == own
            out[some[hit]] += logs[at[hit]]
            open_[some[hit]] = False
            rest, own = some[~hit], own[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(states, own), len(states) - 1)
            known = states[at] == own
            out[rest[known]] += back[at[known]]
        out[open_] -= np.log10(256)
        return out


class Remembered:
    """A tree's answers in a table of fixed size with one place per hash: most symbols of a
    text stand in contexts seen shortly before."""

    BITS = 21

    def __init__(self, tree: Tree):
        self.tree = tree
        self.keys = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64)
        self.logs = np.zeros(1 << self.BITS)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        place = ((keys * GOLDEN) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.logs[place]
        new = np.flatnonzero(self.keys[place] != keys)
        if len(new):
            some, inverse = np.unique(keys[new], return_inverse=True)
            logs = self.tree.log10(some)
            out[new] = logs[inverse]
            place = ((some * GOLDEN) >> np.uint64(64 - self.BITS)).astype(np.int64)
            # Where two share a place, both arrays take the same one: the last.
            self.keys[place], self.logs[place] = some, logs
        return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the last two symbols of a context; states shorter than that are in every part."""
    low = (keys >> np.uint64(8)) & LOW
    return ((low * np.uint64(SPREAD)) & LOW) % np.uint64(parts)


def _score(shared, parts: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Remembered(Tree(*shared.value))
        for batch in batches:
            for block, texts in zip(*(c.to_pylist() for c in batch.columns)):
                streams = unpack(texts)
                total = np.zeros(len(streams))
                for keys, owner in symbols(streams):
                    if parts > 1:
                        own = part_of(keys, parts) == part
                        keys, owner = keys[own], owner[own]
                    total += np.bincount(owner, tree.log10(keys), len(streams))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(streams)),
                        pa.array(np.arange(len(streams))),
                        pa.array(total),
                    ],
                    names=["block", "at", "score"],
                )

    return run


def unpack(texts: bytes) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(texts)
    return [t + END for t in whole.split(END)[:-1]]


def score_blocks(blocks: DataFrame, tree: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(block, at, score) of each document. A pass broadcasts one part of the tree; of several
    passes each is written before the next, and its part released."""
    context = blocks.sparkSession.sparkContext
    whole = blocks.filter(F.col("texts").isNotNull()).select("block", "texts")
    parts = max(1, math.ceil(tree.count() / part_rows))
    scored = None
    for part in range(parts):
        low = (F.col("context").bitwiseAND(0xFFFF) * SPREAD).bitwiseAND(0xFFFF)
        own = tree.filter((F.col("level") < 2) | (low % parts == part))
        arrays = own.select("level", "context", "symbol", "p", "back").toArrow()
        shared = context.broadcast(tuple(c.to_numpy() for c in arrays.columns))
        some = whole.mapInArrow(_score(shared, parts, part), "block string, at long, score double")
        if parts > 1:
            some = staged(some, f"scores{part}")
            shared.destroy()
        scored = some if scored is None else scored.unionByName(some)
    return scored.groupBy("block", "at").agg(F.sum("score").alias("score")) if parts > 1 else scored


def _add_up(tokens: int, distinct: int, kind: pa.DataType):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        names = words["word"].cast(pa.binary()).to_pylist()
        table = dict(zip(names, range(len(names))))
        count = words["n"].to_numpy().astype(np.float64)
        base = np.log10((count + 1) / (tokens + distinct + 1))
        values = np.stack([count > 0, base], axis=1)
        blocks, ids, flags, at, sums = [], [], [], [], []
        for row in docs.select(["block", "ids", "held_out", "texts"]).to_pylist():
            streams = unpack(row["texts"])
            blocks += [row["block"]] * len(streams)
            ids += row["ids"]
            flags += row["held_out"]
            at += range(len(streams))
            for text in streams:
                places = [table[w] for w in (*text.split(), END)]
                sums.append((len(places), *values[places].sum(axis=0)))
        sums = np.array(sums).reshape(-1, 3)
        return pa.table(
            {
                "block": pa.array(blocks, pa.string()),
                "at": pa.array(at, pa.int64()),
                "doc_id": pa.array(ids, kind),
                "held_out": pa.array(flags, pa.bool_()),
                "n_tokens": pa.array(sums[:, 0].astype(np.int64)),
                "n_known": pa.array(sums[:, 1].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sums), tokens, np.int64)),
                "base_score": pa.array(sums[:, 2]),
            }
        )

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents
    with doc_id, text and held_out; learns from those that are not held out."""
    ship(docs.sparkSession)
    blocks = packed(docs)
    words = listed(blocks, "words", "word")
    vocabulary = staged(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))
    ).first()
    tree = grow_tree(listed(blocks, "keys", "key"))
    by_block = words.select(F.col("block").alias("of"), "word").join(vocabulary, "word")
    whole = blocks.filter(F.col("texts").isNotNull()).select("block", "ids", "held_out", "texts")
    kind = docs.schema["doc_id"].dataType
    base = (
        whole.groupBy("block")
        .cogroup(by_block.groupBy("of"))
        .applyInArrow(
            _add_up(tokens, distinct, to_arrow_type(kind)),
            f"block string, at long, doc_id {kind.simpleString()}, held_out boolean, "
            "n_tokens long, n_known long, train_tokens long, base_score double",
        )
    )
    return base.join(score_blocks(blocks, tree), ["block", "at"]).drop("block", "at")


def with_folds(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", held_out("doc_id", 7).alias("held_out"))
