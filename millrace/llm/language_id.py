"""Language identification by segmentation-marginalised unigrams (operator 10).

The pieces of a fixed public vocabulary get a probability in each language. A text's
probability in a language is the sum over all its segmentations into pieces, by a forward
algorithm; pieces do not cross words, so it is the product of its words' sums. Each
distinct word of a block of documents is summed once, in numpy, many words at once.

Learning is expectation maximisation from equal probabilities: the expected count of each
piece over all segmentations of all words of the labelled texts, by language, taken within
tasks and summed by Spark. It reads about LEARN_ROWS labelled rows of each language, chosen by
a hash, and all rows of a language that has fewer; ``None`` reads all. Prediction reads every
text whole. Languages are taken in passes of PASS_LANGUAGES; what is broadcast is one pass's
table of piece probabilities, of a size given by that and the vocabulary.

Words are runs of letters (Unicode category L), lower-cased, led by the vocabulary's word
marker. Bytes without a piece of their own have the vocabulary's byte pieces, so every word
can be segmented. Sums are rescaled on their way, in words of any length, so rare bytes can't
make them 0; long words are learnt and scored by the same sums as short ones.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text if nothing could be learned; null languages teach nothing; repeated rows count as
often as they stand; ties go to the language that sorts first; other columns are ignored.
The score is the probability of the language given the text, languages being equally
likely beforehand.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, ship
from millrace.llm.sp_chunks import default_model
from millrace.llm.tokens import mix, weights

#: Runs of word characters but digits and underscores: letters and other numbers.
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Labelled rows of each language that learning reads, about.
LEARN_ROWS = 10_000
HASH_BITS = 30
#: Languages whose probabilities are broadcast at once.
PASS_LANGUAGES = 512
#: Added to every expected count.
SMOOTHING = 0.05
EM_ROUNDS = 1
#: Bytes of words summed at once (one word may be longer), and words kept per task.
BATCH_BYTES = 250_000
TABLE_WORDS = 150_000
#: Sums held at once: long words are summed for some languages after others.
CELLS = 8_000_000
#: Probabilities are multiplied by this per byte so that words' sums stay near 1.
SCALE = 24.0
#: Sums below this or above its inverse are rescaled, looked for every so many bytes; between
#: two looks even the rarest pieces leave them far from the ends of floating point.
LEAST = 1e-30
CHECK_PLACES = 4
SIEVE_BITS = 16


class Vocabulary:
    """Pieces as bytes with a space for the marker, found by hash and length."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces: dict[bytes, int] = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                pieces.setdefault(bytes([int(name[3:5], 16)]), i)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = name.replace("▁", " ")
                # A space can only lead a word here.
                if " " not in text[1:]:
                    pieces[text.encode()] = i
        self.size = model.get_piece_size()
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        by_length: dict[int, list[bytes]] = {}
        prefixes: dict[int, set[bytes]] = {}
        for piece in pieces:
            by_length.setdefault(len(piece), []).append(piece)
            for n in range(1, len(piece)):
                prefixes.setdefault(n, set()).add(piece[:n])
        self.tables, self.onward = {}, {}
        for n in range(1, self.longest + 1):
            own = by_length.get(n, [])
            keys = self._hashes(own, n)
            order = np.argsort(keys)
            ids = np.array([pieces[p] for p in own], dtype=np.int64)[order]
            self.tables[n] = (keys[order], ids, self._sieve(keys))
            self.onward[n] = self._sieve(self._hashes(list(prefixes.get(n, ())), n))

    @staticmethod
    def _hashes(pieces: list[bytes], n: int) -> np.ndarray:
        data = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n).astype(np.uint64)
        return ((data + np.uint64(1)) * weights(n)[:n]).sum(axis=1, dtype=np.uint64)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def _sieve(self, keys: np.ndarray) -> np.ndarray:
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[self.slot(keys)] = True
        return sieve

    def edges(self, data: np.ndarray, room: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, piece ids) of all pieces in data; room: bytes to the word's end."""
        out = []
        at = np.arange(len(data))
        value = (data.astype(np.uint64) + np.uint64(1))
        total = np.zeros(len(data), np.uint64)
        for n in range(1, self.longest + 1):
            fits = room[at] >= n
            at, total = at[fits], total[fits]
            if not len(at):
                break
            total = total + value[at + (n - 1)] * weights(n)[n - 1]
            slots = self.slot(total)
            keys, ids, sieve = self.tables[n]
            maybe = np.flatnonzero(sieve[slots])
            if len(maybe):
                low = np.minimum(np.searchsorted(keys, total[maybe]), len(keys) - 1)
                hit = keys[low] == total[maybe]
                if hit.any():
                    out.append((n, at[maybe[hit]], ids[low[hit]]))
            more = self.onward[n][slots]
            at, total = at[more], total[more]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(model_path: str | None = None) -> Vocabulary:
    """Loaded where it is asked for: without a path, from that machine's own default."""
    return Vocabulary(model_path or default_model())


class Lattice:
    """The segmentations of some words: pieces grouped by start within the word."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(first, sizes)
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.first = first + np.arange(len(words))  # nodes: a byte's start, and each end
        self.last = self.first + sizes
        self.nodes = len(data) + len(words)
        self.sizes = sizes
        self.longest = vocab.longest
        steps = []
        for n, at, ids in vocab.edges(data, np.repeat(sizes, sizes) - place):
            order = np.argsort(place[at], kind="stable")
            at, ids = at[order], ids[order]
            cuts = np.flatnonzero(np.diff(place[at])) + 1
            for a, i in zip(np.split(at, cuts), np.split(ids, cuts)):
                steps.append((int(place[a[0]]), n, a + self.word[a], i))
        self.steps = sorted(steps, key=lambda s: (s[0], s[1]))

    def forward(self, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Sums up to each node; the logs they lack at each word's end; and (place, nodes,
        divisor) of each rescaling: of a word's node at the place and all that pieces from
        before it reach."""
        alpha = np.zeros((self.nodes, prob.shape[1]))
        alpha[self.first] = 1.0
        logs = np.zeros((len(self.sizes), prob.shape[1]))
        scalings: list = []
        seen = 0
        for place, n, at, ids in self.steps:
            if place >= seen + CHECK_PLACES:
                seen = place
                self._rescale(alpha, logs, scalings, place)
            alpha[at + n] += alpha[at] * (prob[ids] * SCALE**n)
        return alpha, logs, scalings

    def _rescale(self, alpha: np.ndarray, logs: np.ndarray, scalings: list, place: int) -> None:
        words = np.flatnonzero(self.sizes >= place)
        own = alpha[self.first[words] + place]
        words = words[((own < LEAST) | (own > 1 / LEAST)).any(axis=1)]
        if not len(words):
            return
        reach = (self.first[words] + place)[:, None] + np.arange(self.longest)
        nodes = np.minimum(reach, self.last[words][:, None])
        top = alpha[nodes].max(axis=1)
        top[top == 0] = 1.0
        alpha[nodes] /= top[:, None]
        logs[words] += np.log(top)
        scalings.append((place, nodes, top[:, None]))

    def log_sums(self, prob: np.ndarray) -> np.ndarray:
        alpha, logs, _ = self.forward(prob)
        return np.log(alpha[self.last]) + logs - self.sizes[:, None] * np.log(SCALE)

    def expected(self, prob: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Add the expected counts of pieces in words that stand counts times."""
        alpha, _, scalings = self.forward(prob)
        beta = np.zeros_like(alpha)
        beta[self.last] = counts / alpha[self.last]
        for place, n, at, ids in reversed(self.steps):
            while scalings and scalings[-1][0] > place:
                _, nodes, top = scalings.pop()
                beta[nodes] /= top
            carried = beta[at + n] * (prob[ids] * SCALE**n)
            beta[at] += carried
            share = carried * alpha[at]
            for k in range(prob.shape[1]):
                into[:, k] += np.bincount(ids, share[:, k], len(into))


def lattices(vocab: Vocabulary, words: list[bytes], languages: int) -> Iterator[tuple[list[int], Lattice, list[slice]]]:
    """(places in words, their lattice, parts of the languages to sum it for): words of
    about one length together, BATCH_BYTES at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    lo = 0
    while lo < len(order):
        hi, size = lo, 0
        while hi < len(order) and (hi == lo or size + len(words[order[hi]]) <= BATCH_BYTES):
            size += len(words[order[hi]])
            hi += 1
        lattice = Lattice(vocab, [words[i] for i in order[lo:hi]])
        step = max(1, CELLS // lattice.nodes)
        yield order[lo:hi], lattice, [slice(k, k + step) for k in range(0, languages, step)]
        lo = hi


def word_sums(vocab: Vocabulary, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), prob.shape[1]))
    coded = [b" " + w.encode() for w in words]
    for places, lattice, parts in lattices(vocab, coded, prob.shape[1]):
        for part in parts:
            out[places, part] = lattice.log_sums(prob[:, part])
    return out


def expected_counts(vocab: Vocabulary, words: list[str], prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces (pieces x languages), over all segmentations of the
    words, each of which stands counts[word, language] times."""
    into = np.zeros((vocab.size, prob.shape[1]))
    coded = [b" " + w.encode() for w in words]
    for places, lattice, parts in lattices(vocab, coded, prob.shape[1]):
        for part in parts:
            lattice.expected(prob[:, part], counts[places, part], into[:, part])
    return into


def words_of(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # Numbers that are no digits, such as fractions, part words.
    return "".join(c if c.isalpha() else " " for w in words for c in (*w, " ")).split()


def _count(shared, model_path: str | None):
    """Expected counts of pieces by language, over a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, languages = shared.value
        vocab = vocabulary(model_path)
        index = {name: k for k, name in enumerate(languages)}
        into = np.zeros((vocab.size, len(languages)))
        table: dict[str, np.ndarray] = {}

        def flush() -> None:
            if table:
                into[:] += expected_counts(vocab, list(table), prob, np.array(list(table.values())))
            table.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = index[lang]
                for word in words_of(text):
                    counts = table.get(word)
                    if counts is None:
                        counts = table[word] = np.zeros(len(languages))
                    counts[k] += 1
                if len(table) > TABLE_WORDS:
                    flush()
        flush()
        piece, k = np.nonzero(into)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(k), pa.array(into[piece, k])], ["piece", "lang", "n"]
        )

    return run


#: Piece probabilities (pieces x languages) and the languages, pass by pass in sorted order.
Model = list[tuple[np.ndarray, list[str]]]


def learn(
    labelled: DataFrame,
    model_path: str | None = None,
    rounds: int = EM_ROUNDS,
    learn_rows: int | None = LEARN_ROWS,
    pass_languages: int = PASS_LANGUAGES,
) -> Model:
    """The model of the languages in (text, lang); other columns only vary the choice of
    rows, of which about learn_rows of each language are read."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.dropna(subset=["text", "lang"])
    counted = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counted)
    size = vocabulary(model_path).size
    model: Model = []
    for lo in range(0, len(languages), pass_languages):
        names = languages[lo : lo + pass_languages]
        shares = [min(1.0, learn_rows / counted[x]) if learn_rows is not None else 1.0 for x in names]
        chosen = spark.createDataFrame(
            [(x, int(share * (1 << HASH_BITS))) for x, share in zip(names, shares)], "lang string, share long"
        )
        drawn = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << HASH_BITS)) < F.col("share")
        some = rows.join(F.broadcast(chosen), "lang").filter(drawn).select("text", "lang")
        prob = np.full((size, len(names)), 1.0 / size)
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast((prob, names))
            counts = some.mapInArrow(_count(shared, model_path), "piece long, lang long, n double")
            # At most pieces x languages rows come back, however large the corpus.
            summed = counts.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
            piece, lang, n = (summed.column(c).to_numpy() for c in ("piece", "lang", "n"))
            total = np.full((size, len(names)), SMOOTHING)
            total[piece, lang] += n
            prob = total / total.sum(axis=0)
            shared.destroy()
        model.append((prob, names))
    return model


def _score(shared, model_path: str | None):
    """One pass of languages: the other columns as one, the text, lang_pred, its log probability ``best`` and
    the log of all languages' summed probabilities ``every``, from those of earlier passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, languages = shared.value
        vocab = vocabulary(model_path)
        place: dict[str, int] = {}
        sums = np.empty((0, len(languages)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                before = [piece.column(i).to_pylist() for i in range(1, 5)]
                texts = [words_of(t) for t in before[0]]
                if len(place) > TABLE_WORDS:
                    place, sums = {}, sums[:0]
                new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in place]
                if new:
                    sums = np.concatenate([sums, word_sums(vocab, new, prob)])
                place.update(zip(new, range(len(place), len(place) + len(new))))
                found = []
                for words, name, best, every in zip(texts, *before[1:]):
                    if words:
                        logs = sums[[place[w] for w in words]].sum(axis=0)
                        top = int(np.argmax(logs))
                        if best is None or logs[top] > best:
                            name, best = languages[top], float(logs[top])
                        own = logs if every is None else np.append(logs, every)
                        every = float(own.max() + np.log(np.exp(own - own.max()).sum()))
                    found.append((name, best, every))
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:2], *(pa.array(c, t) for c, t in zip(columns, _FOUND))],
                    names=batch.schema.names,
                )

    return run


_FOUND = (pa.string(), pa.float64(), pa.float64())


def identify(docs: DataFrame, model: Model, model_path: str | None = None) -> DataFrame:
    """lang_pred and score from the column text alone, beside docs' other columns; columns of
    these two names give way."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *kept).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("lang_pred"),
        F.lit(None).cast("double").alias("best"),
        F.lit(None).cast("double").alias("every"),
    )
    for part in model:
        shared = spark.sparkContext.broadcast(part)
        rows = rows.mapInArrow(_score(shared, model_path), rows.schema)
    return rows.select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(F.exp(F.col("best") - F.col("every")), F.lit(0.0)).alias("score"),
    )


def predict(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from documents that are not held out."""
    flagged = docs.select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = learn(flagged.filter(~F.col("held_out")), model_path)
    found = identify(flagged.select("doc_id", "held_out", "text"), model, model_path)
    return found.select("doc_id", "held_out", "lang_pred", "score")
