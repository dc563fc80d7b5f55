"""Column-wise suffix arrays and the removal of repeats against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup
from millrace.llm.column_bwt import collection
from tests.llm.test_operators import AWKWARD, docs_of


def table(strings):
    symbols = np.zeros((len(strings), max(map(len, strings), default=0)), np.uint8)
    for row, s in zip(symbols, strings):
        row[: len(s)] = np.frombuffer(s, np.uint8)[::-1] + 1
    return symbols, np.array([len(s) for s in strings])


def sorted_suffixes(strings):
    """(string, length, common prefix) by plain comparison; ends sort by string."""
    every = [
        ([b + 1 for b in s[len(s) - n :]], i, n) for i, s in enumerate(strings) for n in range(len(s) + 1)
    ]
    every.sort(key=lambda x: (x[0] + [0, x[1]]))
    out, last = [], []
    for text, i, n in every:
        same = 0
        while same < min(len(text), len(last)) and text[same] == last[same]:
            same += 1
        out.append((i, n, same))
        last = text
    return out


def test_suffix_array_equals_plain_sorting():
    rng = random.Random(1)
    for _ in range(200):
        letters = b"ab\x00\xf4"[: rng.randrange(1, 5)]
        strings = [bytes(rng.choices(letters, k=rng.randrange(12))) for _ in range(rng.randrange(1, 8))]
        got = [x.tolist() for x in collection(*table(strings))]
        assert list(zip(*got)) == sorted_suffixes(strings)


def brute(rows, span):
    """rows: (key, bytes) in order; equal keys share one document."""
    seen, out = set(), {}
    for key, data in rows:
        if key in out:
            continue
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - span + 1):
            window = data[at : at + span]
            if window in seen:
                gone[at : at + span] = True
            seen.add(window)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[key] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def rows_of(frame, span, anchor, batch, chunk=700):
    runs = suffix_dedup.removed_runs(frame, span, anchor, batch, chunk)
    return suffix_dedup.removal_digests(runs).collect()


@pytest.mark.parametrize(("span", "anchor", "batch"), [(8, 3, 8192), (8, 8, 3), (20, 5, 5), (100, 32, 50), (5, 1, 1)])
def test_removal_equals_brute_force(spark, span, anchor, batch):
    rng = random.Random(span)
    words = ["a", "bb", "é", "中文", "the", "of", "x" * 9, "-" * 30, "ab" * 8]
    passage = " ".join(rng.choices(words, k=60))
    texts = []
    for _ in range(120):
        text = " ".join(rng.choices(words, k=rng.randrange(30)))
        if rng.random() < 0.4:
            at = rng.randrange(len(passage) - 20)
            text += passage[at : at + rng.randrange(250)] + rng.choice(["", "end", "-" * 150])
        texts.append(text)
    texts += [texts[3]] * 20 + ["ab" * 300, "b" + "ab" * 290, "=" * 1000, "=" * 1000]
    rows = [(1000 + i, t, "en") for i, t in enumerate(texts)]
    got = {r[0]: tuple(r[1:]) for r in rows_of(docs_of(spark, rows), span, anchor, batch)}
    assert got == brute([(i, t.encode()) for i, t, _ in rows], span)


def test_shared_and_null_ids_and_awkward_texts(spark):
    extra = [(8, "another text under a used id. " * 9, "en"), (None, "x" * 400, "en"), (None, None, None)]
    frame = docs_of(spark, AWKWARD + extra).withColumn("tag", F.lit("clash")).withColumn("place", F.lit(1))
    tagged = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tagged = tagged.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(tagged, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = brute([((r.doc_id, r.text), r.text.encode()) for r in order], 100)
    got = rows_of(frame, 100, 32, 8192)
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        ((r.doc_id, *want[r.doc_id, r.text]) for r in tagged), key=str
    )


def test_empty_table_and_wrong_widths(spark):
    frame = docs_of(spark, [(1, "a", "en")])
    assert rows_of(frame.limit(0), 100, 32, 10) == []
    with pytest.raises(ValueError):
        suffix_dedup.removed_runs(frame, 200, 32)
