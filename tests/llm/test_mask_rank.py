"""Ranking by presence masks against brute force, and on awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from millrace.llm import mask_rank
from tests.llm.test_operators import AWKWARD, docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for key, wanted in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted
                if c[t]
            )
            if d is not None and score > 0:
                scored.append((-score, d))
        out += [(key, n + 1, d, -s) for n, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, terms string, n int")


def test_terms_are_those_of_the_pattern():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice("aZ09 _-/:@[`{\x7f\x00\né中ßÄ😀") for _ in range(30))
        assert [t.decode() for t in mask_rank.terms_of(text)] == terms(text)


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    odds = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rng.choices(vocabulary, odds, k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[5][1]) for i in range(30)]  # ties
    docs += [(d, t) for d, t, _ in AWKWARD] + [(3, docs[7][1])]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 90])))) for i in range(25)]
    items += [(1, "W1 w1, the CAT"), (1, "W1 w1, the CAT"), (2, None), (9, ""), (None, "w3 word"), (30, "nowhere")]
    frame = docs_of(spark, [(d, t, "en") for d, t in docs])
    for limit in (10_000, 20):
        rows = mask_rank.ranked(frame, items_frame(spark, items), 10, limit).collect()
        assert sorted(map(tuple, rows), key=str) == brute(docs, items, 10)


def test_masks_are_left_out_only_on_proof():
    rng = np.random.default_rng(1)
    docs = 4_000
    at = np.repeat(np.arange(docs), 2)
    held = np.tile([0, 1], docs)
    rare = rng.choice(docs, 20, replace=False)
    at, held = np.append(at, rare), np.append(held, np.full(20, 2))
    counts = np.ones(at.size, np.int64)
    block = mask_rank.Block(np.arange(docs), np.full(docs, 50), at, held, counts, np.array([1, 1, 9_000]))
    places, scores, seen = block.best(np.arange(3), 10, 1)
    assert set(places) <= set(rare) and len(places) >= 10 and seen < docs
    _, _, seen = block.best(np.arange(3), 10, 10**12)
    assert seen == 0


def test_long_documents_keep_their_length_exact():
    n = np.array([2**40, 5])
    assert mask_rank.length_terms(n, 2**30, 2**41).tolist() == [10 + 90 * x * 2**30 // 2**41 for x in n.tolist()]


def test_empty_tables_give_no_row(spark):
    docs, items = docs_of(spark, [(1, "a b", "en")]), items_frame(spark, [(1, "a")])
    assert mask_rank.ranked(docs.limit(0), items).count() == 0
    assert mask_rank.ranked(docs, items.limit(0)).count() == 0
    assert mask_rank.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
