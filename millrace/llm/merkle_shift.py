"""Merkle manifest of a dataset by sibling-shift self-joins, in DataFrame functions (operator 12).

Every row of documents is a leaf; leaves of one source form a tree, the sources' roots form
the tree above. Nodes are rows (tree, idx, n, h): a place among the n nodes of their level
and a digest. A level is built by equijoins of the nodes with themselves at computed sibling
indices: XOR 1 for two children, slot offsets within the run otherwise. After them each node
holds the digests to its left and right in its run, and the rows in slot zero emit the
parents. A level is a third of the one below, so all levels together cost half as much again
as the leaves; each is written to the shared folder. Proofs go the other way, from the root
down: a node's path is its own siblings before its parent's path, one join per level.

No join has a hot key: nodes are keyed by (tree, idx), whatever the size of a source. Places
within a source come from one range sort of the narrow leaves and the count of each sorted
partition, not from a window over a source. The driver holds no digest, only the height.

Defined results: null fields count as ``-``; a null source is a source of its own and comes
first; null ids come first within their source and are never tampered with; rows that share
an id are leaves of their own, in order of their digests; equal rows stay leaves each; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: monotonically_increasing_id puts the partition above this many bits.
ROW_BITS = 33
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's fields, each ``-`` or its UTF-8 length, a colon and the value."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        return F.coalesce(sized, F.lit("-"))

    return digest(*map(part, FIELDS))


def without_line_breaks(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the leaf of the text without \\n where
    2 divides the crc32 of the id, else the leaf."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaf = leaf_digest()
    changed = leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    hit = touched & F.contains(F.col("text"), F.lit("\n"))
    return docs.select(
        "doc_id", "source", leaf.alias("leaf"), F.when(hit, changed).otherwise(F.col("leaf")).alias("tampered")
    )


def placed(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows, which must be cheap to read twice, with idx and n: the place among the rows of
    equal ``tree`` in the given order, and their number."""
    ordered = staged(
        rows.orderBy(F.col(tree).asc_nulls_first(), *order).withColumn(
            "at", F.monotonically_increasing_id()
        ),
        "merkle-order",
    )
    part, row = F.shiftright("at", ROW_BITS), F.col("at").bitwiseAND((1 << ROW_BITS) - 1)
    ordered = ordered.withColumn("part", part).withColumn("row", row)
    runs = ordered.groupBy("part", tree).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("p"),
        F.col(tree).alias("t"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    same = (F.col("part") == F.col("p")) & F.col(tree).eqNullSafe(F.col("t"))
    return ordered.join(runs, same).select(
        *rows.columns, (F.col("row") + F.col("shift")).alias("idx"), "n"
    )


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, n, h, left, right): the digests of the run's other nodes, in order, that
    stand before and behind each node."""
    slot = F.col("idx") % arity
    others = nodes.select(F.col("tree").alias("t"), F.col("idx").alias("i"), F.col("h").alias("o"))
    out = nodes
    for shift in range(1, arity):
        moved = (slot + shift) % arity
        target = F.col("idx").bitwiseXOR(1) if arity == 2 else F.col("idx") - slot + moved
        other = others.withColumnRenamed("o", f"o{shift}")
        out = out.join(other, (F.col("tree") == F.col("t")) & (target == F.col("i")), "left").drop("t", "i")
    none = F.lit("")

    def side(behind: bool) -> Column:
        def digest_at(place: int) -> Column:
            """The run's node in slot ``place``, if it stands on this side."""
            found = none
            for shift in range(1, arity):
                here = ((slot + shift) % arity == place) & ((slot < place) if behind else (slot > place))
                found = F.when(here, F.coalesce(F.col(f"o{shift}"), none)).otherwise(found)
            return found

        return F.concat(*map(digest_at, range(arity)))

    return out.select("tree", "idx", "n", "h", side(False).alias("left"), side(True).alias("right"))


def build(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The staged levels of all trees, leaves (tree, idx, n, h) first, each with siblings and
    without the roots, and the roots (tree, h, level)."""
    height = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    nodes = leaves.select("tree", "idx", "n", "h")
    roots = [nodes.filter("n = 1").select("tree", "h", F.lit(0).alias("level"))]
    while height > 1:
        level = staged(with_siblings(nodes.filter("n > 1"), arity), f"merkle-{len(levels)}")
        levels.append(level)
        nodes = level.filter(F.col("idx") % arity == 0).select(
            "tree",
            (F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            digest(F.col("h"), F.col("right")).alias("h"),
        )
        roots.append(nodes.filter("n = 1").select("tree", "h", F.lit(len(levels)).alias("level")))
        height = -(-height // arity)
    return levels, staged(reduce(DataFrame.unionByName, roots), "merkle-roots")


def paths(
    levels: list[DataFrame], roots: DataFrame, carried: list[str], arity: int = ARITY
) -> DataFrame:
    """(tree, idx, path, carried...) of every leaf: the siblings of its ancestors from the
    bottom up. roots: (tree, level, path, carried...), with the path above the root."""
    whole = ["tree", "idx", "path", *carried]

    def ended(level: int) -> DataFrame:
        return roots.filter(F.col("level") == level).withColumn("idx", F.lit(0).cast("long")).select(whole)

    above = ended(len(levels))
    for number in range(len(levels) - 1, -1, -1):
        parents = above.withColumnsRenamed({"tree": "t", "idx": "i"})
        own = F.array(F.struct("left", "right"))
        down = levels[number].join(
            parents, (F.col("tree") == F.col("t")) & (F.floor(F.col("idx") / arity) == F.col("i"))
        )
        down = down.select("tree", "idx", F.concat(own, "path").alias("path"), *carried)
        above = down.unionByName(ended(number))
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, leaf, lambda acc, p: digest(p["left"], acc, p["right"]))


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """leaves (source, leaf, doc_id and others) with subroot, root and path, the siblings
    from the leaf's run up to the root."""
    leaves = placed(staged(leaves, "merkle-leaves"), "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    sources = staged(leaves.groupBy("source").agg(F.count("*").alias("rows")), "merkle-sources")
    one = sources.select("source", F.lit(0).alias("all"))
    trees = placed(one, "all", [F.col("source").asc_nulls_first()])
    trees = staged(trees.select("source", "idx", "n"), "merkle-trees")
    numbers = trees.select(F.col("source").alias("s"), F.col("idx").alias("tree"))
    leaves = leaves.join(numbers, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    leaves = staged(leaves.withColumnRenamed("leaf", "h"), "merkle-placed")

    low, subroots = build(leaves, arity)
    tops = trees.join(subroots, trees["idx"] == subroots["tree"]).select(
        F.lit(0).cast("long").alias("tree"), "idx", "n", "h"
    )
    high, root = build(staged(tops, "merkle-tops"), arity)
    empty = F.array().cast(PATH)
    over = paths(high, root.select("tree", "level", empty.alias("path"), F.col("h").alias("root")), ["root"], arity)
    over = over.select(F.col("idx").alias("i"), "path", "root")
    under = subroots.join(over, F.col("tree") == F.col("i")).select(
        "tree", "level", "path", F.col("h").alias("subroot"), "root"
    )
    found = paths(low, staged(under, "merkle-under"), ["subroot", "root"], arity)
    found = found.withColumnsRenamed({"tree": "t", "idx": "i"})
    joined = leaves.join(found, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i")))
    return joined.drop("tree", "idx", "n", "t", "i").withColumnRenamed("h", "leaf")


def verified(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Proof digest of every document and the outcome of checking its tampered copy."""
    rows = manifest(without_line_breaks(docs), arity)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    rows = rows.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: DuckDB has no crc32, so it is worked out from the digits' bits: the polynomial is a fixed value.
SQL = r"""
WITH RECURSIVE bytes AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM (SELECT DISTINCT doc_id FROM documents)
),
crc AS (
    SELECT doc_id, s, 0 AS pos, CAST(4294967295 AS UBIGINT) AS c FROM bytes
    UNION ALL
    SELECT doc_id, s, pos + 1,
        CASE WHEN pos % 9 = 0 THEN xor(c, CAST(ascii(s[pos // 9 + 1]) AS UBIGINT))
             WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END
    FROM crc WHERE pos < 9 * length(s)
),
odd AS (SELECT doc_id, (xor(c, CAST(4294967295 AS UBIGINT)) % 2) = 1 AS odd FROM crc WHERE pos = 9 * length(s)),
plain AS (
    SELECT doc_id, source, text,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
    FROM documents
),
leaves AS (
    SELECT p.doc_id, p.source,
        sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS tampered,
        row_number() OVER (PARTITION BY p.source ORDER BY p.doc_id) - 1 AS idx,
        count(*) OVER (PARTITION BY p.source) AS n
    FROM (SELECT p.*, CASE WHEN odd THEN text ELSE replace(text, chr(10), '') END AS t
          FROM plain p JOIN odd USING (doc_id)) p
),
nodes AS (
    SELECT 0 AS level, source, idx, n, leaf AS h FROM leaves
    UNION ALL
    SELECT a.level + 1, a.source, a.idx // 3, (a.n + 2) // 3,
        sha256(a.h || coalesce(b.h, '') || coalesce(c.h, ''))
    FROM nodes a
    LEFT JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND b.idx = a.idx + 1
    LEFT JOIN nodes c ON a.source IS NOT DISTINCT FROM c.source AND c.idx = a.idx + 2
    WHERE a.n > 1 AND a.idx % 3 = 0
),
subroots AS (
    SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
    FROM nodes WHERE n = 1
),
tops AS (
    SELECT 0 AS level, idx, n, h FROM subroots
    UNION ALL
    SELECT a.level + 1, a.idx // 3, (a.n + 2) // 3, sha256(a.h || coalesce(b.h, '') || coalesce(c.h, ''))
    FROM tops a
    LEFT JOIN tops b ON b.idx = a.idx + 1
    LEFT JOIN tops c ON c.idx = a.idx + 2
    WHERE a.n > 1 AND a.idx % 3 = 0
),
every AS (
    SELECT source, level, idx, n, h FROM nodes
    UNION ALL
    SELECT NULL, level + 1000, idx, n, h FROM tops
),
sided AS (
    SELECT e.level, e.source, e.idx, e.n,
        CASE e.idx % 3 WHEN 0 THEN '' WHEN 1 THEN a.h ELSE a.h || b.h END AS l,
        CASE e.idx % 3 WHEN 0 THEN coalesce(b.h, '') || coalesce(c.h, '')
            WHEN 1 THEN coalesce(c.h, '') ELSE '' END AS r
    FROM every e
    LEFT JOIN every a ON a.level = e.level AND a.source IS NOT DISTINCT FROM e.source AND a.idx = e.idx // 3 * 3
    LEFT JOIN every b ON b.level = e.level AND b.source IS NOT DISTINCT FROM e.source AND b.idx = e.idx // 3 * 3 + 1
    LEFT JOIN every c ON c.level = e.level AND c.source IS NOT DISTINCT FROM e.source AND c.idx = e.idx // 3 * 3 + 2
),
climb AS (
    SELECT doc_id, leaf, source AS own, source, 0 AS level, idx, n, tampered AS acc, '' AS proof FROM leaves
    UNION ALL
    SELECT k.doc_id, k.leaf, k.own,
        CASE WHEN k.n = 1 THEN NULL ELSE k.source END,
        CASE WHEN k.n = 1 THEN 1000 ELSE k.level + 1 END,
        CASE WHEN k.n = 1 THEN u.idx ELSE k.idx // 3 END,
        CASE WHEN k.n = 1 THEN u.n ELSE (k.n + 2) // 3 END,
        CASE WHEN k.n = 1 THEN k.acc ELSE sha256(x.l || k.acc || x.r) END,
        CASE WHEN k.n = 1 THEN k.proof ELSE k.proof || x.l || x.r END
    FROM climb k
    LEFT JOIN subroots u ON u.source IS NOT DISTINCT FROM k.own
    LEFT JOIN sided x ON x.level = k.level AND x.source IS NOT DISTINCT FROM k.source AND x.idx = k.idx
    WHERE NOT (k.level >= 1000 AND k.n = 1)
)
SELECT k.doc_id, k.leaf, u.h AS subroot, t.h AS root, sha256(k.proof) AS proof_sha256,
    k.acc AS folded_root, k.acc = t.h AS verified
FROM climb k
JOIN subroots u ON u.source IS NOT DISTINCT FROM k.own
JOIN tops t ON t.n = 1
WHERE k.level >= 1000 AND k.n = 1
"""
