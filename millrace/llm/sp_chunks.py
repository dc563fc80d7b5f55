"""SentencePiece encoding and decoding by a table of distinct chunks (operator 7).

A text is normalised as the model's library does it (a leading marker, each space a
marker) and cut before every run of markers. If no piece of the vocabulary holds a
marker behind another character, no merge can cross such a cut, so segmenting the chunks
one by one gives exactly the library's ids. In every block of documents (an Arrow batch
within a task) the distinct chunks form a table, each is segmented once by the library,
and the ids are joined back to the documents by position. Copies of a word in a block
cost a lookup. No shuffle: a global table would move every word occurrence through the
network, and a lost executor costs only its own blocks.

The cut is used only for models for which it is proven: vocabulary as above, identity
normaliser, dummy prefix, white space kept. Other models are encoded text by text.

Defined results: null text counts as empty and gives only the end id; repeated rows give
repeated rows; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ship

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
CROSSING = re.compile(f"[^{MARK}]{MARK}")

#: Field numbers of the public model format: the normaliser within the model, and within
#: that its character map, dummy prefix, removal of extra spaces, escaping of spaces.
NORMALIZER, CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 3, 2, 3, 4, 5

#: Distinct chunks kept per block before the table starts anew, to bound memory.
TABLE_CHUNKS = 150_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def chunks_are_safe(model) -> bool:
    """Whether cutting before marker runs is proven to leave this model's ids unchanged."""
    spec = next((v for f, v in _fields(model.serialized_model_proto()) if f == NORMALIZER), b"")
    options = dict(_fields(spec))
    if options.get(CHARSMAP) or options.get(REMOVE_EXTRA, 1):
        return False
    if not options.get(DUMMY_PREFIX, 1) or not options.get(ESCAPE, 1):
        return False
    return not any(CROSSING.search(model.id_to_piece(i)) for i in range(model.get_piece_size()))


@functools.lru_cache(maxsize=4)
def load(model_path: str | None):
    """The model, whether chunks are safe, and the id of a lone marker; once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path or default_model())
    return model, chunks_are_safe(model), model.piece_to_id(MARK)


def encode_block(texts: list[str], table: dict, model_path: str | None) -> list[tuple[list, str]]:
    """Ids (with the end id) and decoded text of each text. table: chunk -> (ids, text)."""
    model, safe, lone = load(model_path)
    end = model.eos_id()
    if not safe:
        every = [model.encode(t, num_threads=1) for t in texts]
        return [(ids + [end], model.decode(ids + [end])) for ids in every]
    parts = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    new = list({c for chunks in parts for c in chunks} - table.keys())
    # The library puts a marker before whatever it encodes: that is the chunk's first one.
    found = [ids or [lone] for ids in model.encode([c[1:] for c in new], num_threads=1)]
    table.update(zip(new, zip(found, model.decode(found, num_threads=1) if found else [])))
    out = []
    for chunks in parts:
        found = [table[c] for c in chunks]
        ids = [i for piece_ids, _ in found for i in piece_ids]
        ids.append(end)
        # A chunk decodes without its first marker, which stands between chunks.
        out.append((ids, " ".join([text for _, text in found])))
    return out


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None
) -> DataFrame:
    """(key, ids array<int>, decoded string): one row per row of docs, end id included."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                if len(table) > TABLE_CHUNKS:
                    table.clear()
                done = encode_block(piece.column(1).to_pylist(), table, model_path)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([d[0] for d in done], pa.list_(pa.int32())),
                        pa.array([d[1] for d in done], pa.string()),
                    ],
                    names=[key, "ids", "decoded"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def token_digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
