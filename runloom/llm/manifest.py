"""A Merkle manifest of a data set: nested-struct rollup within bounded blocks, proofs without joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runloom.session import cut_lineage

# Nodes of a block are 2^BITS: a block is one row whose structs nest BITS deep.
BITS = 8
_PATH = "array<struct<l string, r string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_of(group: Column) -> Column:
    """A group's name as a key that is never null and orders like it bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) in ``order`` within ``tree``, and the ``total`` of the tree.

    Rows are dealt by ranges of (tree, order), so a tree that holds most rows spreads over all tasks.
    A small table of counts by tree and range gives each range its first rank.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id())
    cut = cut_lineage(cut)  # range numbers are read twice and must not change
    tree, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("tree", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(tree).alias("total"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return cut.join(counts, ["tree", "part"]).withColumn("rank", F.col("before") + inside - 1).drop("part", "before")


def rollup(level: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, total, block, node): each block of 2^BITS consecutive hashes ``h`` as one nest of structs.

    The binary digits of the rank inside the block are grouped away one after another, lowest first, each
    time putting the structs of a pair into their parent's. One exchange by block serves all of them.
    A parent exists while its tree has several nodes at the height; above, the single node stays.
    """
    digits = [f"d{j}" for j in range(BITS)]
    rows = level.select(
        "tree", "total", F.shiftright("rank", BITS).alias("block"), F.struct("h", *payload).alias("node"),
        *[F.shiftright("rank", j).bitwiseAND(F.lit(1)).alias(d) for j, d in enumerate(digits)],
    )
    rows = rows.repartition("tree", "block")
    for j, d in enumerate(digits):
        pair = F.sort_array(F.collect_list(F.struct(d, "node")))
        rows = rows.groupBy("tree", "total", "block", *digits[j + 1 :]).agg(F.transform(pair, lambda x: x["node"]).alias("kids"))
        first, second = F.col("kids")[0]["h"], F.coalesce(F.get("kids", F.lit(1))["h"], F.lit(""))
        h = F.when(F.col("total") > 1 << j, digest(first, second)).otherwise(first)
        rows = rows.withColumn("node", F.struct(h.alias("h"), "kids")).drop("kids")
    return rows


def _leaves(node: Column, height: int, path: Column) -> Column:
    """All nodes at the bottom of a nest, each with its path to the top, nearest step first."""
    if height == 0:
        return F.array(F.struct(node.alias("node"), path.alias("path")))
    kids = node["kids"]

    def down(kid: Column, i: Column) -> Column:
        left = F.when(i == 1, kids[0]["h"]).otherwise(F.lit(""))
        right = F.when(i == 0, F.coalesce(F.get(kids, F.lit(1))["h"], F.lit(""))).otherwise(F.lit(""))
        step = F.array(F.struct(left.alias("l"), right.alias("r")))
        there = F.when(F.col("total") > 1 << (height - 1), step).otherwise(F.array().cast(_PATH))
        return _leaves(kid, height - 1, F.concat(there, path))

    return F.flatten(F.transform(kids, down))


def descend(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Every node at the bottom of the blocks, with its whole path: (tree, subroot, root, node, path).

    ``paths`` (tree, block, path, subroot, root) are those of the blocks' tops. A block and its path are
    grouped into one row by (tree, block), and one transform and explode emits the rest.
    """
    tops = blocks.withColumns({"path": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
    both = tops.unionByName(paths, allowMissingColumns=True).groupBy("tree", "block")
    met = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("total", "node", "path", "subroot", "root")])
    out = met.select("tree", "subroot", "root", F.explode(_leaves(F.col("node"), BITS, F.col("path"))).alias("x"))
    return out.select("tree", "subroot", "root", "x.node", "x.path")


def climb(level: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of every level, the lowest first; in the last each tree has one block."""
    out = [cut_lineage(rollup(level, payload))]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1 << BITS:
        total = F.ceil(F.col("total") / F.lit(1 << BITS)).cast("long")
        upper = out[-1].select("tree", total.alias("total"), F.col("block").alias("rank"), F.col("node.h").alias("h"))
        out.append(cut_lineage(rollup(upper, ["rank"])))
    return out


def fall(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """From the paths (tree, path, subroot, root) of all trees' tops down to the nodes of the lowest level."""
    found = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(levels[1:]):
        found = descend(blocks, found).select("tree", F.col("node.rank").alias("block"), "path", "subroot", "root")
        found = cut_lineage(found)
    return descend(levels[0], found)


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, leaf: Column, tampered: Column | None = None) -> DataFrame:
    """A leaf, its proof and its check for every row of ``docs``.

    Rows form a binary tree for each value of ``group``, ascending by ``order``; the subroots, ascending
    by name bytewise and null first, form the tree that ends in the root. While a tree has several
    nodes, each two consecutive ones, or a last one alone, become the digest of their concatenation.

    ``leaf`` is the row's hash, ``tampered`` another one (null: unchanged) that the check folds instead.
    Returns ``columns``, leaf, path (array of (l, r), what stands left and right of the folded hash at each
    step, empty for nothing), subroot, root, folded_root and verified.

    A row of a block holds 2^BITS leaves at most, at any size of the table; the blocks' tops are the next
    level's rows, so there are log(rows) / BITS levels. Ranks come from ranges of the order.

    Defined cases: a null group is a group; a null order comes first; equal ones are ordered by their
    leaves, so that rows alike in all hashed columns are interchangeable; an empty table gives no
    rows; a tree of one row is its leaf; columns not named are ignored, and names cannot clash as the
    named ones travel in a struct (none of them may have the name of a returned column).
    """
    held = F.struct(*[F.col(c) for c in columns]).alias("row")
    changed = F.lit(None).cast("string") if tampered is None else tampered
    rows = docs.select(tree_of(F.col(group)).alias("tree"), F.col(order).alias("at"), leaf.alias("h"), changed.alias("changed"), held)
    rows = cut_lineage(rows.withColumn("salt", F.monotonically_increasing_id()))  # texts are read once; spreads equal rows
    levels = climb(ranked(rows, ["at", "h", "salt"]), ["changed", "row"])
    tops = levels[-1].select(F.lit("").alias("tree"), F.col("node.h").alias("h"), F.col("tree").alias("name"))
    upper = climb(ranked(tops, ["name"]), ["name"])
    none = F.array().cast(_PATH)
    root = upper[-1].select("tree", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node.h").alias("root"))
    groups = fall(upper, root).select(F.col("node.name").alias("tree"), "path", F.col("node.h").alias("subroot"), "root")
    found = fall(levels, cut_lineage(groups))
    start = F.coalesce("node.changed", "node.h")
    folded = found.withColumn("folded_root", F.aggregate("path", start, lambda h, s: digest(s["l"], h, s["r"])))
    return folded.select(
        *[F.col("node.row")[c].alias(c) for c in columns], F.col("node.h").alias("leaf"), "path", "subroot", "root",
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, nearest first."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def document_leaf(n_chars: Column) -> Column:
    """The leaf of a document, with a given number of characters."""
    return digest(*[field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])


def document_manifest(docs: DataFrame, tamper: Column) -> DataFrame:
    """``manifest`` of a document table by language; where ``tamper`` holds, one is added to ``n_chars`` before the check.

    Defined cases: as in ``manifest``; a null ``n_chars`` stays, so that row verifies; the largest integer
    may be passed, as the sum is a decimal.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    changed = F.when(tamper & F.col("n_chars").isNotNull(), document_leaf(more))
    return manifest(docs, ["doc_id"], "lang", "doc_id", document_leaf(F.col("n_chars")), changed)

