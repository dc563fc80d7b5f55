"""Merkle manifests against a tree built by hand, and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle_shift
from tests.llm.test_operators import AWKWARD, docs_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes, arity):
    """Root, and per leaf the siblings before and behind on each level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for number, place in enumerate(places):
            run, slot = runs[place // arity], place % arity
            paths[number].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            places[number] = place // arity
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows, arity):
    def tampered(r):
        hit = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        return leaf(r, r["text"].replace("\n", "") if hit else r["text"])

    sources: dict = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), tampered(r)))
    keys = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for key in keys:
        sources[key].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = [tree([x[1] for x in sources[key]], arity) for key in keys]
    root, above = tree([b[0] for b in built], arity)
    out = []
    for key, (subroot, paths), over in zip(keys, built, above):
        for (doc_id, own, changed), path in zip(sources[key], paths):
            folded = changed
            for left, right in path + over:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in path + over))
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_a_tree_built_by_hand(spark, arity):
    rows = [(i, f"text {i}\nmore" if i % 3 else "plain", "en") for i in range(10, 110)] + AWKWARD
    frame = docs_of(spark, rows).withColumn("tree", F.lit("clash")).withColumn("idx", F.lit("clash"))
    kinds = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, "é").when(
        F.col("doc_id") % 7 < 5, "src"
    ).when(F.col("doc_id") == 20, "alone").otherwise("z")
    frame = frame.withColumn("source", kinds)
    got = sorted(map(tuple, merkle_shift.verified(frame, arity).collect()), key=str)
    assert got == brute([r.asDict() for r in frame.collect()], arity)
    assert {r[6] for r in got} == {True, False}


def test_single_leaf_is_its_own_root_and_empty_table_gives_no_row(spark):
    one = docs_of(spark, [(7, "a", "en")])
    row = merkle_shift.verified(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == sha("")
    assert merkle_shift.verified(one.limit(0)).count() == 0


def test_places_within_a_source_that_spans_partitions(spark):
    rows = spark.range(1000).select(F.lit("one").alias("source"), F.col("id").alias("doc_id"), F.lit("x").alias("leaf"))
    rows = rows.repartition(7, F.rand(1))
    got = merkle_shift.placed(rows, "source", [F.col("doc_id")])
    assert got.filter("idx = doc_id AND n = 1000").count() == 1000
