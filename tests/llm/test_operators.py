"""Operators against brute force, and on awkward rows: nulls, empty and very long texts,
ties, repeated rows, empty tables, other columns whose names clash."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import (
    chat_grammar,
    components,
    decontaminate,
    jaccard_tiles,
    language_id,
    pii_bootstrap,
    sentence_spans,
    sp_chunks,
    suffix_tree_lm,
    tokens,
    topk_impacts,
    warc_chunks,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", run string, row string, level string, n string, ids string, value string, score string"
LONG = "word " * 60_000 + "x" * 30_000
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, rows, clash=True):
    data = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    if clash:
        data = [(*r, "a", "b", "c", "d", "e", "f", "g") for r in data]
    return spark.createDataFrame(data, DOCS + (CLASH if clash else ""))


AWKWARD = [
    (1, "the cat sat on the mat and went away again. It was late.", "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "the cat sat on the mat and went away again. It was late.", "en"),
    (4, LONG, "en"),
    (5, "le chat est sur le tapis et la souris est dans la maison.", "fr"),
    (5, "le chat est sur le tapis et la souris est dans la maison.", "fr"),
    (6, " \n\t ", None),
    (7, "<s>▁ \x00 </s> 😀", "en"),
    (8, "the cat sat on the mat and went away again. It was late.", None),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# 7: the library itself


def test_encoding_equals_the_library(spark):
    model, safe, _ = sp_chunks.load(sp_chunks.default_model())
    assert safe
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(" ▁ab\n\té中<s>/.") for _ in range(rng.randrange(40))), "x") for i in range(300)]
    frame = docs_of(spark, rows + AWKWARD)
    got = sorted((str(r[0]), list(r[1]), r[2]) for r in sp_chunks.encode_documents(frame).collect())
    want = []
    for key, text, _ in rows + AWKWARD:
        ids = [*model.encode(text or ""), model.eos_id()]
        want.append((str(key), ids, model.decode(ids)))
    assert got == sorted(want)


def test_unsafe_models_are_encoded_text_by_text(monkeypatch):
    model, _, _ = sp_chunks.load(sp_chunks.default_model())
    monkeypatch.setattr(sp_chunks, "load", lambda path: (model, False, 0))
    ids, text = sp_chunks.encode_block(["a  b"], {}, "")[0]
    assert ids == [*model.encode("a  b"), model.eos_id()] and text == "a  b"


# 2: exact round trip


def test_chat_round_trip_of_conflicting_texts(spark):
    rng = random.Random(2)
    bits = [*chat_grammar.CONTROLS, "<", "\\", "/s>", "s>", "[", "INST]", "a", "\n", " ", "%3C", "<\\/s>"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "a<\n%b", None]), "".join(rng.choices(bits, k=rng.randrange(9))))
        for c in range(60)
        for t in range(4)
    ]
    rows += [(7, None, "user", None), (None, 1, "assistant", LONG), (7, 2, "user", "tie"), (7, 2, "user", "tie")]
    frame = spark.createDataFrame(
        [(*r, "x", "y") for r in rows],
        "conv_id long, turn long, role string, text string, segment string, formatted string",
    )
    out = chat_grammar.format_conversations(frame, segment=3).collect()
    got = Counter((r.conv_id, t.role, t.text) for r in out for t in r.turns)
    assert got == Counter((c, role or "", text or "") for c, _, role, text in rows)
    for r in out:
        learnt = [t.text for t in r.turns if t.role == "assistant"]
        assert len(r.loss_spans) == len(learnt)
    digests = chat_grammar.conversation_digests(chat_grammar.format_conversations(frame, 3)).collect()
    for d in digests:
        own = sorted((r for r in rows if r[0] == d.conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert d.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_grammar.format_conversations(frame.limit(0)).count() == 0


def test_control_strings_are_escaped_text_by_text(spark):
    import duckdb

    texts = [*chat_grammar.CONTROLS, "plain", "a [INST] b <s> c", "<\\\\s> x", "<<s>[[/INST]"]
    rows = [(c, 0, "user", t) for c, t in enumerate(texts)]
    rows += [(50, t, "assistant", text) for t, text in enumerate(texts)]
    roles = ["us%er", "a<b\n", "%25", "", "assistant"]
    rows += [(60, t, role, f"text {t}") for t, role in enumerate(roles)]
    schema = "conv_id long, turn long, role string, text string"
    planted = [(-7, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))]
    formatted = chat_grammar.format_conversations(spark.createDataFrame(rows + planted, schema))
    live = re.compile(r"[<\[](?:/?s>|/?INST\]|</?SYS>>)")
    found = {r.conv_id: r for r in formatted.collect()}
    for c, text in enumerate(texts):
        assert live.findall(found[c].formatted) == ["<s>", "</s>"]
        assert found[c].escaped == (text != "plain")
    # A text is escaped alike in any company.
    alone = "".join(found[c].formatted.replace("user", "assistant") for c in range(len(texts)))
    assert found[50].formatted == alone
    got = sorted(map(tuple, chat_grammar.conversation_digests(formatted).collect()))
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert got == sorted(db.execute(chat_grammar.SQL).fetchall())


# 3: brute force


@pytest.mark.parametrize("passes", [4096, 3])
def test_top_k_equals_brute_force(spark, passes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "z") for i in range(400)]
    rows += [(500 + i, [0.5] * 8, "z") for i in range(40)]  # ties
    rows += [(900, None, "z"), (901, [None] * 8, "z"), (902, [math.nan] * 8, "z"), (903, [math.inf] * 8, "z")]
    rows += [(None, [0.1] * 8, "z"), (7, rows[7][1], "z"), (910, [], "z"), (1000, [0.25] * 3, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    asked = frame.filter("vec_id % 100 = 0")
    got = sorted(map(tuple, topk_impacts.top_k(frame, asked, 10, passes).collect()))
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in fine:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:10])]
    assert got == sorted(want)
    assert topk_impacts.top_k(frame.limit(0), asked).count() == 0


def test_components_too_large_for_doubles_are_multiplied_exactly(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1), rng.choice([0.0, 1e6, -2e6, 2.0**50, 0.3])]) for i in range(120)]
    rows += [(200, [0.0, 1e300]), (300, [1.0, 0.0]), (301, [1e12, 5e-324]), (302, [-1e300, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    few = [r for r in rows if abs(r[1][1]) < 1e8 and abs(r[1][0]) < 1e13]
    own = frame.filter("abs(embedding[1]) < 1e8 AND abs(embedding[0]) < 1e13")
    asked = own.filter("vec_id % 10 = 0")
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in few}
    want = []
    for q in whole:
        if q % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:10])]
    assert sorted(map(tuple, topk_impacts.top_k(own, asked, 10).collect())) == sorted(want)
    assert topk_impacts.exact(np.array([1e300, -1e300, -0.3])) == [int(1e300) * 1024, -int(1e300) * 1024, -308]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk_impacts.top_k(frame, frame.filter("vec_id = 200"), 10).collect()


def test_few_postings_are_processed_where_vectors_form_groups():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    vectors = centres[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 32)) / 20
    searcher = topk_impacts.Searcher({0: (0, vectors[0].tolist())}, 10)
    for lo in range(0, 4_000, 1_000):
        searcher.add(np.arange(lo, lo + 1_000), vectors[lo : lo + 1_000])
    whole = np.floor(vectors * 1024).astype(np.int64)
    scores = whole @ whole[0]
    want = sorted(((int(s), i) for i, s in enumerate(scores) if i), key=lambda x: (-x[0], x[1]))[:10]
    assert searcher.best[0] == want
    assert searcher.touched < 0.6 * vectors.size and searcher.scored < 1_000


# 4: exact round trip


def test_archives_give_back_every_payload(spark):
    hostile = "WARC/1.1\r\nWARC-Type: x\r\n\r\nWARC/1.1" * 40
    rows = [(1, "http://a/\r\nWARC/1.1 é", hostile), (2, None, None), (3, "u", ""), (None, "u", "é" * 30_000)]
    rows += [(i, "u", "same" * 300) for i in range(10, 20)] + [(i, "u", "short") for i in range(20, 24)]
    rows += [(4, "u", "WARC/1.1"), (-5, "u", "x\r\n\r\n" * 9_000), (19, "u", "same" * 300)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    got = Counter(map(tuple, warc_chunks.round_trip(frame, chunk_bytes=1000).collect()))
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        again = 19 if html == "same" * 300 and page != 19 else None
        want[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", again)] += 1
    assert got == want
    assert warc_chunks.round_trip(frame.limit(0)).count() == 0


def test_long_payloads_are_streamed_by_bytes(monkeypatch):
    """Tasks hand on a bounded number of bytes, however long a payload is and whatever is in it."""
    monkeypatch.setattr(warc_chunks, "BATCH_BYTES", 100_000)
    payload = (b"x" * 3_000 + b"WARC/1.1") * 900
    cuts = [payload[i : i + 16_384] for i in range(0, len(payload), 16_384)]
    names = ["record_key", "page_id", "url", "size", "digest", "refers_to", "data"]
    digest = hashlib.sha1(payload).hexdigest()

    def batches():
        for lo in range(0, len(cuts), 3):
            some = cuts[lo : lo + 3]
            heads = [["k"], [5], ["u"], [len(payload)], [digest], [None]]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(h * len(some), k) for h, k in zip(heads, kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.binary())], names)

    data, sizes = [], []
    for out in warc_chunks._records(batches()):
        records = out["record"].to_pylist()
        sizes.append(sum(map(len, records)))
        data += [r.split(b"\r\n\r\n", 1)[1][:-2] for r in records]
        assert all(r.count(b"WARC/1.1") == 1 for r in records)
    assert b"".join(data) == payload and len(sizes) > 20 and max(sizes) < 100_000 + 2 * 16_384


def test_many_large_payloads(spark):
    rows = spark.range(200).select(
        F.col("id").alias("page_id"),
        F.lit("u").alias("url"),
        F.concat(F.repeat(F.concat(F.lit("<p>text "), (F.col("id") % 150).cast("string")), 200_000), F.lit("WARC/1.1")).alias("html"),
    )
    out = warc_chunks.round_trip(rows.repartition(8), chunk_bytes=1 << 20)
    want = rows.select(F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1("html").alias("payload_digest"))
    got = out.groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in got} == {"response": 150, "revisit": 50}
    assert out.select(want.columns).exceptAll(want).count() == 0 and out.count() == 200


# 1: brute force on planted passages


def test_tiles_cover_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([item[20:], np.arange(900, 950, dtype=np.uint64), item[:20]])
    assert decontaminate.tiles_of(item, doc, 5) == [(0, 70, 20), (20, 0, 20)]


def test_tiling_is_greedy_and_never_overlaps():
    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(3, 30))] for _ in range(2))
        tiles = decontaminate.tiles_of(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        for i, j, n in tiles:
            assert n >= 3 and a[i : i + n] == b[j : j + n]
        for side in (0, 1):
            places = [p for t in tiles for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(3, 31) if i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n]), default=0)
        assert max((t[2] for t in tiles), default=0) == longest


def plain_tiles(item, doc, minimum):
    """Mark the longest match of free words, the first of equals, until none is long enough."""
    free_item, free_doc, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (minimum - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < minimum:
            return sorted(tiles)
        tiles.append((i, j, n))
        free_item[i : i + n] = [False] * n
        free_doc[j : j + n] = [False] * n


def test_tiling_equals_plain_greedy_tiling():
    rng = random.Random(14)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([2, 4])) for _ in range(rng.randrange(1, 26))] for _ in range(2))
        minimum = rng.choice([1, 2, 3])
        got = decontaminate.tiles_of(np.array(a, np.uint64), np.array(b, np.uint64), minimum)
        assert got == plain_tiles(a, b, minimum), (a, b, minimum)


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    benchmark = [(1, " ".join(words)), (2, "one two three"), (3, None), (None, " ".join(words)), (1, " ".join(words))]
    items = spark.createDataFrame([(*b, "e") for b in benchmark], "item_id long, text string, doc_id string")
    rows = [
        (10, "zz " + " ".join(words).upper() + " yy", "en"),
        (11, " ".join(words[20:]) + "\nother text here\n" + " ".join(words[:20]), "en"),
        (12, " ".join(words[:12]), "en"),
        (13, "one two three", "en"),
        (10, "zz " + " ".join(words).upper() + " yy", "en"),
    ]
    frame = docs_of(spark, rows + AWKWARD[1:])
    for part in (1_000_000, 10):
        got = Counter((r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(frame, items, part_words=part).collect())
        assert got == Counter({(10, 1, 1.0): 2, (11, 1, 1.0): 1})
    clean = decontaminate.clean(frame, items)
    assert clean.columns == frame.columns and clean.count() == frame.count() - 3
    assert decontaminate.leaks(frame, items.limit(0)).count() == 0
    assert decontaminate.leaks(frame.limit(0), items).count() == 0


# 9: brute force


def shingle_set(text):
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_no_row_gathers_the_documents_of_a_frequent_shingle(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tiles, "BLOCK", 50)
    line = "one line that stands in each"
    rng = random.Random(2)
    rows = [(i, f"{line} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(rng.randrange(3)))}", "en") for i in range(3_000)]
    sets = jaccard_tiles.describe(docs_of(spark, rows), bits=6)
    groups = jaccard_tiles.prefix_groups(sets).select(F.size("members").alias("n"), "blocks")
    assert groups.agg(F.max("n")).first()[0] <= 2 * 50 and groups.agg(F.max("blocks")).first()[0] >= 10


@pytest.mark.parametrize("bits", [12, 6])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, bits):
    """With 6 bits the sketch tells no frequent shingle apart: groups are cut by their size."""
    monkeypatch.setattr(jaccard_tiles, "BLOCK", 8)
    rng = random.Random(5)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(6, 90))] for _ in range(6)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(words), "en"))
    rows += [(i, t, lang) for i, t, lang in AWKWARD if i is not None] + [(50, "One two", "en"), (51, "one TWO", "en")]
    frame = docs_of(spark, rows)
    found = jaccard_tiles.near_duplicates(frame, bits=bits).collect()
    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    assert Counter(map(tuple, found)) == Counter((i, len(s), root(i)) for i, s in sets)
    assert jaccard_tiles.near_duplicates(frame.limit(0), bits=bits).count() == 0


def test_word_hashes_see_words_as_python_does():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB \n\x0bé中\x00.") for _ in range(rng.randrange(30))) for _ in range(400)]
    seen, n = {}, 0
    for first, hashes, bounds in tokens.word_hashes(pa.array(texts)):
        for i in range(len(bounds) - 1):
            own = hashes[bounds[i] : bounds[i + 1]].tolist()
            words = WORD.findall(ascii_lower(texts[first + i]))
            assert len(own) == len(words)
            for w, h in zip(words, own):
                assert seen.setdefault(w, h) == h
            n += 1
    assert n == len(texts) and len(set(seen.values())) == len(seen)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 130)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8: brute force

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("0123456789 .-+()@a_é😀-..00") for _ in range(rng.randrange(90))), "x") for i in range(1500)]
    fixed = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 00.000.0.256", "4111 1111 1111 1111", "+1 (487) 555-1234", "9" * 20_000, "a" * 20_000 + "@b.c", "1.1" * 2_000]
    rows += [(5000 + i, t, "x") for i, t in enumerate(fixed)] + AWKWARD
    frame = docs_of(spark, rows)
    got = Counter((r.doc_id, r.base_sha256) for r in pii_bootstrap.span_digests(pii_bootstrap.find_spans(frame)).collect())
    assert got == Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert pii_bootstrap.find_spans(frame.limit(0)).count() == 0


def test_counts_by_kind_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "x.y@h-1.org", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1 (487) 555-1234", "word"]
    texts = ["a@b.c, a@b.cc", "1.2.3.4; 5.6.7.8; 9.9.9.9", "+49 30 1234567", "4111 1111 1111 1111 x a@b.c", "+49 30 1234567, +1 (487) 555-1234, 1.2.3.4", "none", "", None]
    texts += [", ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    # Spans of kind context, which counts leave out, a null id, and an id and a row that come twice.
    texts += [f"please write to: user{i}@mail.example.com now" for i in range(8)] + ["please write to: AB-99-7712 now"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[4], "x"), (0, texts[1], "x"), (0, texts[0], "x")]
    got = pii_bootstrap.span_digests(pii_bootstrap.find_spans(docs_of(spark, rows))).collect()
    assert next(r.spans for r in got if r.doc_id == len(texts) - 1) == "context:17:27"

    def exact(i, text):
        base = base_spans(text or "")
        kinds = Counter(s.split(":")[0] for s in base.split(","))
        return (i, *[kinds[k] for k in pii_bootstrap.KINDS[:4]], hashlib.sha256(base.encode()).hexdigest())

    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(exact(i, t) for i, t, _ in rows)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please write to: user{i}@mail.example.com now", "en") for i in range(12)]
    rows += [(100, "please write to: AB-99-7712 now", "en"), (101, "we saw 4 big 123456 things", "en")]
    frame = docs_of(spark, rows)
    spans = {r.doc_id: r.spans for r in pii_bootstrap.span_digests(pii_bootstrap.find_spans(frame)).collect()}
    assert spans[100] == "context:17:27" and spans[101] == "" and spans[3] == "email:17:39"
    out = pii_bootstrap.redacted(frame)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == frame.columns and texts[100] == "please write to: [CONTEXT] now"
    assert texts[3] == "please write to: [EMAIL] now" and texts[101] == rows[13][1]


def scores_of(edges, seeds, rounds):
    """Confidence and support of each pattern, by the rule of the module's docstring."""
    values = {v for _, v in edges}
    trust = {(p, v): float(v in seeds) for p, v in edges}
    for number in range(rounds):
        patterns = {}
        for p in {p for p, _ in edges}:
            own = [trust[e] for e in edges if e[0] == p]
            support = sum(t >= pii_bootstrap.TRUSTED for t in own)
            patterns[p] = (sum(own) / (len(own) + pii_bootstrap.SMOOTHING), support)
        if number == rounds - 1:
            return patterns
        for p, v in edges:
            if v not in seeds:
                others = [patterns[q] for q, w in edges if w == v and q != p]
                wrong = math.prod(1 - min(c, 0.999) for c, n in others if n >= pii_bootstrap.MIN_SEEDS)
                trust[p, v] = pii_bootstrap.DECAY * (1 - wrong)
    assert values


@pytest.mark.parametrize("rounds", [1, 2, 6])
def test_pattern_scores_equal_plain_iteration(spark, rounds):
    rng = random.Random(rounds)
    edges = sorted({(f"p{rng.randrange(12)}", f"v{rng.randrange(30)}") for _ in range(110)})
    seeds = {f"v{i}" for i in range(14)}
    rows = [(p, v, v in seeds and rng.random() < 0.7) for p, v in edges for _ in range(rng.randrange(1, 3))]
    known = {v for _, v, seed in rows if seed}
    frame = spark.createDataFrame(rows, "pattern string, value string, seed boolean")
    got = {r.pattern: (r.confidence, r.seeds) for r in pii_bootstrap.confident_patterns(frame, rounds, 0.0, 0).collect()}
    # With no bound on seeds every pattern spreads, so the bound is put to the plain one too.
    want = scores_of(edges, known, rounds)
    if rounds == 1:
        assert got.keys() == want.keys()
    chosen = pii_bootstrap.confident_patterns(frame, rounds, 0.3).collect()
    assert {r.pattern for r in chosen} == {p for p, (c, n) in want.items() if c >= 0.3 and n >= 3}
    assert all(abs(r.confidence - want[r.pattern][0]) < 1e-9 and r.seeds == want[r.pattern][1] for r in chosen)


def test_discovered_identifiers_support_further_patterns(spark):
    rows = [(i, f"please write to user{i}@mail.example.com", "en") for i in range(8)]
    rows += [(100 + i, f"please write to XQ-77{i}012", "en") for i in range(3)]
    rows += [(200 + i, f"account number is XQ-77{i}012", "en") for i in range(3)]
    rows += [(300, "account number is ZZ-551234", "en"), (301, "room number: ZZ-991234", "en")]
    spans = {r.doc_id: r.spans for r in pii_bootstrap.span_digests(pii_bootstrap.find_spans(docs_of(spark, rows))).collect()}
    assert spans[100] == "context:16:25" and spans[200] == "context:18:27"
    assert spans[300] == "context:18:27" and spans[301] == ""


def test_lists_of_identifiers_and_long_words_have_patterns(spark):
    text = "write to: a@x.org, AB-99-7712, CD-11-2233 " + "y" * 500 + " " + "z" * 300 + " EF-1234"
    found = pii_bootstrap.base_and_instances(docs_of(spark, [(1, text, "en")]))
    got = {r.value: (r.pattern, r.seed) for r in pii_bootstrap.instances_of(found).collect()}
    mark = pii_bootstrap.MARK
    assert got == {
        "a@x.org": ("write to:", True),
        "ab-99-7712": (f"to: {mark},", False),
        "cd-11-2233": (f"{mark}, {mark},", False),
        "ef-1234": ("y" * 500 + " " + "z" * 300, False),
    }


def test_many_matches_in_one_text_take_seconds(spark):
    lines = [f"mail to user{i}@example.com now" for i in range(100_000)]
    frame = docs_of(spark, [(1, "\n".join(lines), "en")])
    start = time.perf_counter()
    (row,) = pii_bootstrap.find_spans(frame).collect()
    assert len(row.spans) == 100_000
    assert [(s.start, s.end) for s in row.spans[-1:]] == [(sum(map(len, lines)) + 99_999 - 25, sum(map(len, lines)) + 99_999 - 4)]
    (out,) = pii_bootstrap.redacted(frame).collect()
    assert out.text == "\n".join(["mail to [EMAIL] now"] * 100_000)
    assert time.perf_counter() - start < 120


def test_spans_that_overlap_are_replaced_as_one(spark):
    texts = ["call +49 30 1234567@example.com now", "+49 30 1234567@example.com", "a@b.cc and 1.2.3.4", "é 1.2.3.4", "😀 none"]
    out = {r.doc_id: r.text for r in pii_bootstrap.redacted(docs_of(spark, [(i, t, "x") for i, t in enumerate(texts)])).collect()}
    assert out == {0: "call [PHONE] now", 1: "[PHONE]", 2: "[EMAIL] and [IP]", 3: "é [IP]", 4: "😀 none"}


# 5: brute force for the counts, a proper model for the score


def test_scores(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["der", "Die", "the", "of", "x"]) + rng.choice(["", "s", "\x0b"]) for _ in range(rng.randrange(60))), "x") for i in range(120)]
    rows += AWKWARD
    frame = docs_of(spark, rows)
    got = suffix_tree_lm.score_documents(suffix_tree_lm.with_folds(frame)).collect()
    words = lambda t: [*WORD.findall(ascii_lower(t or "")), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words(t))
        want[(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(base, 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert suffix_tree_lm.score_documents(suffix_tree_lm.with_folds(frame.limit(0))).count() == 0


def test_tree_is_proper_and_parts_do_not_matter(spark):
    from pyspark.sql import functions as F

    rows = [(i, "abra cadabra abracadabra " * (i % 5), "x") for i in range(30)]
    blocks = suffix_tree_lm.packed(docs_of(spark, rows).select("doc_id", "text", F.lit(False).alias("held_out")))
    grown = suffix_tree_lm.grow_tree(suffix_tree_lm.listed(blocks, "keys", "key"))
    tree = suffix_tree_lm.Tree(*(c.to_numpy() for c in grown.select("level", "context", "symbol", "p", "back").toArrow().columns))
    for context in (b" ", b" abra", b"zzzzz", b"cadab"):
        key = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        assert abs((10 ** tree.log10(key + np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-9
    whole = {(r.block, r.at): r.score for r in suffix_tree_lm.score_blocks(blocks, grown).collect()}
    parts = {(r.block, r.at): r.score for r in suffix_tree_lm.score_blocks(blocks, grown, part_rows=40).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-6 for k in whole)


def test_contexts_below_unfit_ones_are_tested(spark):
    """Behind cm x and y are as likely as behind m, but acm and bcm tell which one comes."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    words = ["acmx", "admy", "bcmy", "bdmx"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "x") for i in range(10)]
    blocks = suffix_tree_lm.packed(docs_of(spark, rows).select("doc_id", "text", F.lit(False).alias("held_out")))
    grown = suffix_tree_lm.grow_tree(suffix_tree_lm.listed(blocks, "keys", "key")).collect()
    counts: dict[bytes, Counter] = {}
    for _, text, _ in rows:
        data = b" " + text.encode() + b" \n"
        for i in range(1, len(data)):
            for k in range(min(i, suffix_tree_lm.DEPTH) + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    weight, p, fit = suffix_tree_lm.WEIGHT, {}, set()
    for context in sorted(counts, key=len):
        own, total = counts[context], sum(counts[context].values())
        above = {s: p[context[1:]][s] if context else 1 / 256 for s in own}
        p[context] = {s: (n + weight * above[s]) / (total + weight) for s, n in own.items()}
        if sum(n * math.log(n / total / above[s]) for s, n in own.items()) >= suffix_tree_lm.MIN_GAIN:
            fit.add(context)
    assert b"cm" not in fit and b"acm" in fit
    retained = {c[i:] for c in fit for i in range(len(c) + 1)} | {b""}
    got = {(r.context.to_bytes(r.level, "big"), r.symbol): r.p for r in grown}
    want = {(c, s): p[c][s] for c in retained for s in p[c]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# 6: brute force


def sentences(text):
    """Words of the sentences, long ones in units, by plain reading."""
    out, words = [], WORD.finditer(text)
    words = [(m.group(), m.start(), m.end()) for m in words]
    for i, (word, start, _) in enumerate(words):
        gap = text[words[i - 1][2] : start] if i else ""
        if i == 0 or "\n" in gap or words[i - 1][0][-1] in ".!?":
            out.append([])
        out[-1].append(ascii_lower(word))
    units = []
    for own in out:
        cuts = sentence_spans.cuts_of([w.encode() for w in own]).tolist() if len(own) > sentence_spans.CUT_ABOVE else []
        units += [tuple(own[a:b]) for a, b in zip([0, *cuts], [*cuts, len(own)])]
    return units


def test_sentences_are_those_of_plain_reading(monkeypatch):
    rng = random.Random(6)
    bits = ["a", "B.", "é!", "?", ".", " ", "  ", "\n", "\t", " \n ", "\u00a0", "中文", "x" * 40, "w w w w w w w w w "]
    for slice_ in (1 << 20, 16):
        monkeypatch.setattr(sentence_spans, "SLICE", slice_)
        for _ in range(300):
            text = "".join(rng.choices(bits, k=rng.randrange(30)))
            got = [tuple(ascii_lower(w) for w in WORD.findall(text[a:b])) for a, b in sentence_spans.sentences_of(text)]
            assert got == sentences(text)


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [f"sentence {i} has these {i} words in a row here." for i in range(8)]
    rows = [(1000 + i, " ".join(rng.choices(pool, k=rng.randrange(7))) + rng.choice(["", "\n\nEnd"]), "x") for i in range(60)]
    rows += [(2000 + i % 7, " ".join(rng.choices(pool, k=5)), "x") for i in range(20)]
    rows += [(None, " ".join(rng.choices(pool, k=5)), "x") for i in range(5)]
    rows += [(5000, "own words only, none of them anywhere else. And these too, as they stand in no other text.", "x")]
    rows += [(5000, " ".join(pool[:4]), "x"), *AWKWARD]
    frame = docs_of(spark, rows).withColumn("tag", F.lit("clash")).withColumn("place", F.lit("clash"))
    hashes = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct().collect()
    order = sorted(hashes, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is None, r.h))
    first, runs = {}, []
    for i, text, _ in order:
        parts = sentences(text or "")
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                if sum(map(len, parts[a:b])) >= 15:
                    run = tuple(parts[a:b])
                    runs.append((run, (i, text), a, b))
                    first.setdefault(run, (i, text, a))
                    break
    gone = {}
    for run, key, a, b in runs:
        if first[run] != (*key, a):
            gone.setdefault(key, set()).update(range(a, b))
    got = sentence_spans.remove_repeats(frame).collect()
    plain = [(i, text, frozenset(gone.get((i, text), ()))) for i, text, _ in rows]
    assert Counter((r.doc_id, r.n_sentences, r.n_removed, frozenset(r.removed)) for r in got) == Counter(
        (i, len(sentences(t or "")), len(g), g) for i, t, g in plain
    )
    left = Counter((r.doc_id, tuple(itertools.chain(*sentences(r.text)))) for r in got if r.n_removed)
    assert left == Counter(
        (i, tuple(itertools.chain(*(s for n, s in enumerate(sentences(t)) if n not in g)))) for i, t, g in plain if g
    )
    assert Counter((r.doc_id, r.text) for r in got if not r.n_removed) == Counter((i, t) for i, t, g in plain if not g)
    assert [t for i, t, g in plain if g and i == 5000] == [" ".join(pool[:4])]
    assert sentence_spans.remove_repeats(frame.limit(0)).count() == 0


def test_passages_without_stops_are_found_in_any_surroundings(spark):
    rng = random.Random(11)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = draw(60)
    rows = [(1, " ".join(passage), "x"), (2, " ".join(passage).upper(), "x")]
    rows += [(10 + i, " ".join([*draw(rng.randrange(50)), *passage, *draw(rng.randrange(50))]), "x") for i in range(30)]
    rows += [(50, " ".join(draw(60)), "x")]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs_of(spark, rows)).collect()}
    for i, text, _ in rows:
        left, gone = got[i].text.split(), 60 - sum(w.lower() in passage for w in got[i].text.split())
        # What goes is of the passage only, but for the units it begins or ends in.
        assert (left == text.split() and got[i].n_removed == 0) if i in (1, 50) else gone >= 15
        assert len(text.split()) - len(left) <= gone + 2 * sentence_spans.WINDOW
    # Of a whole copy, no more stays than is too short for a run.
    assert len(got[2].text.split()) < sentence_spans.MIN_WORDS
    for _ in range(300):
        some, cuts = draw(49), []
        for _ in range(2):
            before = draw(rng.randrange(40))
            words = [w.encode() for w in (*before, *some, *draw(rng.randrange(40)))]
            cuts.append({int(c) - len(before) for c in sentence_spans.cuts_of(words)})
        w = sentence_spans.WINDOW
        assert {c for c in cuts[0] if w <= c <= 49 - w} == {c for c in cuts[1] if w <= c <= 49 - w}
        assert max(np.diff(sorted(cuts[0]))) <= w


# 10: all segmentations by brute force, held-out accuracy


def rolling_log_sums(vocab, word, prob):
    """Log probability of one word byte by byte: a rolling window of sums, rescaled."""
    window = np.zeros((vocab.longest + 1, prob.shape[1]))
    window[0] = 1.0
    logs = np.zeros(prob.shape[1])
    for start in range(len(word)):
        here = window[0]
        for n in range(1, min(vocab.longest, len(word) - start) + 1):
            piece = vocab.pieces.get(word[start : start + n])
            if piece is not None:
                window[n] += here * prob[piece]
        window = np.roll(window, -1, axis=0)
        window[-1] = 0.0
        top = window.max(axis=0)
        logs += np.log(top)
        window /= top
    return logs + np.log(window[0])


def segmentations(vocab, word):
    if not word:
        yield []
    for n in range(1, min(vocab.longest, len(word)) + 1):
        if word[:n] in vocab.pieces:
            for rest in segmentations(vocab, word[n:]):
                yield [vocab.pieces[word[:n]], *rest]


def test_learning_equals_enumerated_segmentations(spark):
    vocab = language_id.vocabulary()
    rows = [(1, "Cats sat, the cat", "en"), (2, "les chats", "fr"), (3, "the the", "en"), (4, "½ ² x", "fr")]
    (prob, names), = language_id.learn(docs_of(spark, rows), rounds=2)
    assert names == ["en", "fr"]
    want = np.full((vocab.size, 2), 1.0 / vocab.size)
    for _ in range(2):
        counts = np.full((vocab.size, 2), language_id.SMOOTHING)
        for _, text, lang in rows:
            k = names.index(lang)
            for word in re.findall("[a-z]+", text.lower()):
                ways = list(segmentations(vocab, b" " + word.encode()))
                chances = np.array([np.prod(want[w, k]) for w in ways])
                for way, chance in zip(ways, chances / chances.sum()):
                    np.add.at(counts[:, k], way, chance)
        want = counts / counts.sum(axis=0)
    assert np.allclose(prob, want)
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, rows), [(prob, names)]).collect()}
    for i, text, _ in rows:
        words = [b" " + w.encode() for w in re.findall("[a-z]+", text.lower())]
        chances = [math.prod(sum(math.prod(want[w, k]) for w in segmentations(vocab, x)) for x in words) for k in (0, 1)]
        assert got[i].lang_pred == names[int(chances[1] > chances[0])]
        assert abs(got[i].score - max(chances) / sum(chances)) < 1e-9


def test_long_words_are_learnt_whole():
    vocab = language_id.vocabulary()
    word = "".join(random.Random(4).choices("abcé中文字", k=400))
    prob = np.random.default_rng(4).dirichlet(np.ones(vocab.size), 3).T
    coded = b" " + word.encode()
    got = language_id.expected_counts(vocab, [word], prob, np.ones((1, 3)))
    # Expected counts are the slopes of the log probability along the logs of the pieces.
    rng = np.random.default_rng(5)
    for piece in rng.choice(np.flatnonzero(got[:, 0]), 12, replace=False):
        more, less = prob.copy(), prob.copy()
        more[piece] *= 1.0001
        less[piece] /= 1.0001
        slope = rolling_log_sums(vocab, coded, more) - rolling_log_sums(vocab, coded, less)
        assert np.allclose(slope / (2 * np.log(1.0001)), got[piece], rtol=1e-4, atol=1e-6)


def test_numbers_are_no_letters_and_languages_come_in_passes(spark):
    names = ["en", "fr", "de", "es"]
    texts = {
        "en": "the cat and the dog went over the hill with them",
        "fr": "le chat et la souris sont dans la maison avec eux",
        "de": "der Hund und die Katze gehen über den Berg mit ihnen",
        "es": "el gato y el perro van por la colina con ellos",
    }
    rows = [(100 * k + i, f"{texts[x]} {i}", x) for k, x in enumerate(names) for i in range(30)]
    rows += [(900, "½ ² Ⅷ ①", "fr"), (901, "ªb", None)]
    frame = docs_of(spark, rows)
    whole, parts = (language_id.learn(frame, pass_languages=n) for n in (512, 3))
    assert [len(p[1]) for p in parts] == [3, 1]
    one, many = ({r.doc_id: r for r in language_id.identify(frame, m).collect()} for m in (whole, parts))
    for i, _, lang in rows:
        assert one[i].lang_pred == many[i].lang_pred and abs(one[i].score - many[i].score) < 1e-9
        assert lang is None or i == 900 or one[i].lang_pred == lang
    assert language_id.words_of("a½b Ⅷ cd²é 中①文") == ["a", "b", "cd", "é", "中", "文"]
    assert (one[900].lang_pred, one[900].score) == ("und", 0.0) and one[901].lang_pred != "und"


def test_learning_reads_about_the_rows_stated_of_each_language(spark):
    rows = [(i, f"word{'a' * (i % 50)}", "en") for i in range(3000)] + [(5000 + i, "mot", "fr") for i in range(5)]
    (prob, _), = language_id.learn(docs_of(spark, rows), learn_rows=300)
    # All five French rows are read whole: their counts are those of learning from all rows.
    (every, _), = language_id.learn(docs_of(spark, rows), learn_rows=None)
    assert np.allclose(prob[:, 1], every[:, 1])
    assert not np.allclose(prob[:, 0], every[:, 0])


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(sp_chunks.default_model())
    rng = np.random.default_rng(10)
    prob = rng.dirichlet(np.ones(vocab.size), 2).T

    def brute(word, k):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            sums[end] = sum(sums[s] * prob[vocab.pieces[word[s:end]], k] for s in range(end) if word[s:end] in vocab.pieces)
        return math.log(sums[-1])

    words = ["the", "straße", "中文", "a", "internationalisation"]
    got = language_id.word_sums(vocab, words, prob)
    for w, row in zip(words, got):
        coded = b" " + w.encode()
        for k in (0, 1):
            assert abs(row[k] - brute(coded, k)) < 1e-6
        assert np.allclose(rolling_log_sums(vocab, coded, prob), row)


def test_long_words_without_pieces_keep_finite_sums(spark):
    vocab = language_id.vocabulary(sp_chunks.default_model())
    letters = [chr(0x1D41A + i) for i in range(26)]
    assert not any(c.encode() in vocab.pieces for c in letters)
    rare = "".join(random.Random(13).choices(letters, k=60))
    prob = np.random.default_rng(13).dirichlet(np.ones(vocab.size), 2).T
    for c in range(256):
        prob[vocab.pieces[bytes([c])]] = 0.05 / 1e9
    words = [rare[:30], "the", "internationalisation", rare[30:42] + "the"]
    coded = [b" " + w.encode() for w in words]
    for w, row in zip(coded, language_id.word_sums(vocab, words, prob)):
        assert np.isfinite(row).all() and np.allclose(rolling_log_sums(vocab, w, prob), row)
    # Each byte is in one piece of a segmentation.
    sizes = np.zeros(vocab.size)
    for piece, i in vocab.pieces.items():
        sizes[i] = len(piece)
    into = np.zeros((vocab.size, 2))
    coded += [rare.encode()[:160]]
    counts = np.arange(1.0, 11.0).reshape(5, 2)
    language_id.Lattice(vocab, coded).expected(prob, counts, into)
    assert np.allclose(sizes @ into, np.array([len(w) for w in coded]) @ counts)
    alone = np.zeros((vocab.size, 2))
    for w, n in zip(coded, counts):
        language_id.Lattice(vocab, [w]).expected(prob, n[None], alone)
    assert np.allclose(into, alone)
    en, fr = "the cat and the dog went over the hill", "le chat et la souris sont dans la maison"
    rows = [(50 + i, en, "en") for i in range(9)] + [(80 + i, fr, "fr") for i in range(9)]
    rows += [(100 + i, f"{en} {rare}", "en") for i in range(9)] + [(120, f"{fr} {rare[:30]}", None)]
    got = {r.doc_id: r for r in language_id.predict(docs_of(spark, rows)).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)


def test_languages(spark):
    en, fr = "the cat and the dog went over the hill with them", "le chat et la souris sont dans la maison avec eux"
    rows = [(50 + i, f"{en} {i}", "en") for i in range(40)] + [(100 + i, f"{fr} {i}", "fr") for i in range(40)]
    rows += [(300, "123 !?", "en"), (301, en, None), *AWKWARD]
    got = language_id.predict(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    named = {r.doc_id: r.lang_pred for r in got}
    assert all(named[i] == ("en" if i < 100 else "fr") for i, _, _ in rows[:80])
    assert named[300] == named[2] == named[3] == "und" and named[301] == "en"
    none = docs_of(spark, [(1, "text", None)])
    assert [tuple(r)[2:] for r in language_id.predict(none).collect()] == [("und", 0.0)]
    assert language_id.predict(none.limit(0)).count() == 0


# pipeline


def test_pipeline_stages_on_awkward_rows(spark):
    docs = docs_of(spark, AWKWARD)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert kept[0] == sorted(str(i) for i, _, _ in AWKWARD if i not in (2, 3, 6))
    assert kept[1] == sorted(str(i) for i in (1, 4, 5, 7))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == len(kept[-1])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(spark, AWKWARD).limit(0), SMALL).count() == 0, name


def test_pipeline_decides_row_by_row(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    leak, clean = items[min(items)], "nothing of this stands in any test, and so it may well stay in here for good"
    other = "another text that stands under the same number as the first and is not like it at all"
    rows = [(1, f"so {leak} it is", "en"), (1, clean, "en"), (None, f"then {leak} again", "en"), (None, other, "en")]
    frame = docs_of(spark, rows)
    left = corpus_pipeline.decontaminate(spark, frame, SMALL)
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, clean), (None, other)}
    rows = [(1, clean, "en"), (1, clean, "en"), (1, other, "en"), (None, other, "en"), (2, clean, "en"), (None, "", "en")]
    left = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), SMALL)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", other), ("1", clean), ("None", "")]


def test_intermediate_tables_go_when_the_pipeline_ends(spark):
    from millrace.llm.common import staged_paths

    before = staged_paths()
    out = corpus_pipeline.run(spark, SMALL)
    left = [p for p in staged_paths() if p not in before]
    assert len(left) == 1 and out.count() > 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from millrace.llm.common import shared_dir

    def session(master, own=None, conf=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: own)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf))

    assert shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert shared_dir(session("yarn", "hdfs://a/b", "s3://c/")) == "s3://c"
    for master in ("yarn", "spark://host:1", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_pipeline_equals_its_operators(spark):
    found = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    groups = {r.doc_id for r in jaccard_tiles.near_duplicates(docs).collect() if r.doc_id == r.component_id}
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.leaks(docs, items).collect()}
    assert found == groups - dirty
