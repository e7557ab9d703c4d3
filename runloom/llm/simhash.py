"""Near-duplicates by 64-bit fingerprints and multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from runloom.llm.common import map_arrow, with_columns
from runloom.llm.components import connected_components
from runloom.session import cut_lineage

BITS = 64
SEED = 42
# Entries of a bucket above which it is looked at class by class; nodes of a bucket that the others are tied to;
# rows of large buckets that are broadcast at most.
LARGE_BUCKET = 64
HEADS = 3
BROADCAST_ROWS = 100_000
# Share of the links that a plan of likely segments finds at least, at the distance it is made for.
RECALL = 0.96


def _votes(text: str | None, width: int, longs: int) -> tuple[int, np.ndarray]:
    """Number of word shingles, and for each bit of ``longs`` hashes how many shingles set it.

    Words are separated by ASCII white space and A-Z are lower-cased. A shorter text is one shingle. The
    first hash is XXH64; each further one mixes it anew.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    votes = np.zeros((longs, BITS), dtype=np.int64)
    if not words:
        return 0, votes
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)
    for k in range(longs):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k)
            hashes ^= hashes >> np.uint64(28)
        for at in range(0, n, 1 << 16):  # bounded memory for very long texts
            part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            votes[k] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return n, votes


def fingerprint(text: str | None, width: int, longs: int = 1) -> list[int]:
    """Bit by bit the majority over the hashes of all word shingles, as signed 64-bit integers; zeros without words."""
    n, votes = _votes(text, width, longs)
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view("<i8").reshape(-1).tolist()


def _names(longs: int) -> list[str]:
    return [f"f{k}" for k in range(longs)]


def _with_prints(rows: DataFrame, width: int, longs: int) -> DataFrame:
    """``rows`` with their last column, the text, replaced by the fingerprint f0, f1, ..., without a shuffle."""

    def process(batch: pa.RecordBatch) -> dict:
        last = batch.num_columns - 1
        prints = [fingerprint(text, width, longs) for text in batch.column(last).to_pylist()]
        return {f"{i}": batch.column(i) for i in range(last)} | {f"p{k}": [p[k] for p in prints] for k in range(longs)}

    return map_arrow(rows, process, with_columns(rows.schema.fields[:-1], ", ".join(f"{name} long" for name in _names(longs))))


def fingerprints(docs: DataFrame, width: int = 3, longs: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...) of every document."""
    return _with_prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), width, longs)


def segment_plan(distinct: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment of 64 bits for so many fingerprints: no link is missed.

    Segments of about log2(n) bits keep a table's buckets near one entry, and any plan gives the same
    links. Of two fingerprints that differ in at most ``radius`` bits, by the pigeonhole principle, some
    segment differs in no more than radius // m of them; as not all can reach that, the segments
    after the first radius % m + 1 need one bit less.
    """
    m = max(1, min(BITS, round(BITS / max(math.log2(max(distinct, 2)), 1.0))))
    m = min(m, radius + 1)  # more segments would only be looked up with a negative radius
    cuts = [BITS * i // m for i in range(m + 1)]
    each, over = divmod(radius, m)
    plan = [(a, b - a, each if i <= over else each - 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return [x for x in plan if x[2] >= 0]


def likely_plan(distinct: int, share: float) -> list[tuple[int, int, int]]:
    """Segments of wide fingerprints for pairs that differ in a ``share`` of their bits: most agree nearly in one.

    Segments have about log2(n) bits, do not cross a long, and are looked up within one bit. There are as
    many as make RECALL of such pairs, bits differing independently, meet in one of them; nearer
    pairs meet more often. So the fingerprint grows with the table rather than the balls.
    """
    bits = min(BITS, max(8, math.ceil(math.log2(max(distinct, 2)))))
    near = (1 - share) ** bits + bits * share * (1 - share) ** (bits - 1)
    each, count = BITS // bits, math.ceil(math.log(1 - RECALL) / math.log(1 - near))
    return [(BITS * (i // each) + i % each * (BITS // each), bits, 1) for i in range(count)]


def longs_of(plan: list[tuple[int, int, int]]) -> int:
    return max(first for first, _, _ in plan) // BITS + 1


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))


def ball(part: Column, bits: int, radius: int) -> Column:
    """The values within ``radius`` bits of a segment, as an array; the value itself first."""
    flips = [0, *(sum(1 << b for b in chosen) for r in range(1, radius + 1) for chosen in combinations(range(bits), r))]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    return F.transform(F.array(*[F.lit(f).cast("long") for f in signed]), lambda f: part.bitwiseXOR(f))


def _segment(plan: list[tuple[int, int, int]]) -> list[Column]:
    return [_part(F.col(f"f{first // BITS}"), first % BITS, bits) for first, bits, _ in plan]


def _entries(prints: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(k, v, and the columns of ``prints``): each fingerprint in the table of each segment k, under its value v."""
    tables = [F.struct(F.lit(k).alias("k"), part.alias("v")) for k, part in enumerate(_segment(plan))]
    return prints.select("*", F.explode(F.array(*tables)).alias("t")).select("t.k", "t.v", *prints.columns)  # unused columns fall away


def _apart(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(0)
    for a, b in zip(left, right, strict=True):
        out = out + F.bit_count(a.bitwiseXOR(b))
    return out


def _stars(entries: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Links (a, b), a < b, of every node to a few nodes of each of its buckets, if they are near.

    These are the bucket's least nodes in HEADS different orders, so that a group whose members are not all
    near the same one is joined as well.
    """
    orders = [F.col("node"), *[F.xxhash64(F.col("node"), F.lit(i)) for i in range(1, HEADS)]]
    least = [F.min_by(F.struct("node", *names), order).alias(f"h{i}") for i, order in enumerate(orders)]
    heads = entries.groupBy("k", "v").agg(F.count(F.lit(1)).alias("size"), *least).where("size > 1")
    met = entries.join(heads, ["k", "v"]).select("node", *names, F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HEADS)]))).alias("h"))
    near = _apart([F.col(f) for f in names], [F.col(f"h.{f}") for f in names]) <= radius
    return met.where((F.col("node") != F.col("h.node")) & near).select(F.least("h.node", "node").alias("a"), F.greatest("h.node", "node").alias("b"))


def _across(classed: DataFrame, names: list[str], radius: int, plan: list[tuple[int, int, int]]) -> DataFrame:
    """Links (a, b) between the classes of the table (node, class, f0, ...): those that hold near fingerprints.

    Every fingerprint enters each segment's table once and looks up the ball around its segment, from the
    side whose segment is the smaller. In a large bucket, the class with most entries is told apart from
    the rest: its own lookups meet the rest only. So a bucket full of one class, as a large group of near
    copies makes it, is not compared with itself. ``names`` are the columns compared.
    """

    def lookup(k: int, part: Column, bits: int, r: int) -> Column:
        upward = F.filter(ball(part, bits, r), lambda v: v >= part)
        return F.transform(upward, lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))

    # What was checkpointed may lie in few partitions, and a row makes very many here.
    rows = classed.repartition(int(classed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    balls = [lookup(k, part, bits, r) for k, (part, (_, bits, r)) in enumerate(zip(_segment(plan), plan, strict=True))]
    wanted = rows.select("class", *names, F.explode(F.concat(*balls)).alias("t")).select("t.k", "t.v", F.col("class").alias("c"), *names)
    entries = _entries(rows, plan).select("k", "v", F.col("class").alias("d"), *[F.col(f).alias(f"g{i}") for i, f in enumerate(names)])
    counts = entries.groupBy("k", "v", "d").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("k", "v").agg(F.sum("n").alias("size"), F.max(F.struct("n", "d")).alias("top"))
    large = cut_lineage(large.where(F.col("size") > LARGE_BUCKET).select("k", "v", F.col("top.d").alias("most")))
    found = large.count()
    large = F.broadcast(large) if found <= BROADCAST_ROWS else large
    # Side 0 of a large bucket are its entries of other classes than the one with most, side 1 all entries.
    ours = F.col("d") == F.col("most")
    sides = F.when(F.col("most").isNull() | ours, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    placed = entries.join(large, ["k", "v"], "left").select("k", "v", F.explode(sides).alias("side"), "d", *[f"g{i}" for i in range(len(names))])
    asked = wanted.join(large, ["k", "v"], "left").select("k", "v", F.when(F.col("c") == F.col("most"), 0).otherwise(1).alias("side"), "c", *names)
    near = _apart([F.col(f) for f in names], [F.col(f"g{i}") for i in range(len(names))]) <= radius
    met = asked.join(placed, ["k", "v", "side"]).where((F.col("c") != F.col("d")) & near)
    return met.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def rooted(prints: DataFrame, radius: int, compared: int, plan: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(f0, ..., doc_id, root) of every fingerprint of the table (doc_id, f0, ...): its smallest id and its class.

    Links are made at ``radius`` bits over the first ``compared`` longs; ``plan`` names the segments that bring
    fingerprints together, by default those of one long that miss no link.

    Equal fingerprints are one before anything is looked up, so copies cost no pairs. A first pass links
    every fingerprint to the few first ones of its buckets, if near, ties it to the least of them, and
    that to its own, which joins large groups in a few shuffles; the second looks up all that may be near, but for pairs that are in
    one class already, and its links go to a component search. No link between different classes is
    left out, whatever the first pass joined, and groups cost links in proportion to their size.
    """
    names = [c for c in prints.columns if c != "doc_id"]
    least = prints.groupBy(*names).agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id())
    least = cut_lineage(least)
    plan = plan or segment_plan(least.count(), radius)

    stars = cut_lineage(_stars(_entries(least.select("node", *names), plan), names[:compared], radius).distinct())
    tied = cut_lineage(least.join(_tied(stars), "node", "left").select(*names, "doc_id", "node", F.coalesce("to", "node").alias("star")))
    # What the ties left apart though linked is little, and is joined as a graph of its own.
    to = tied.select(F.col("node").alias("n"), "star")
    rest = stars.join(to, F.col("a") == F.col("n")).select("b", F.col("star").alias("x")).join(to, F.col("b") == F.col("n")).select("x", "star")
    rest = rest.where("x <> star").select(F.col("x").alias("a"), F.col("star").alias("b"))
    merged = connected_components(rest).withColumnRenamed("node", "tied")
    first = tied.join(merged, F.col("star") == F.col("tied"), "left")
    first = cut_lineage(first.select(*names, "doc_id", "node", F.coalesce("root", "star").alias("class")))
    found = connected_components(_across(first.select("node", "class", *names), names[:compared], radius, plan))
    joined = first.join(found.withColumnRenamed("node", "tied"), F.col("class") == F.col("tied"), "left")
    return cut_lineage(joined.select(*names, "doc_id", F.coalesce("root", "class").alias("root")))


def _tied(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, to): the least partner of each node, followed along 2 ** ``jumps`` such steps; links go from a to a larger b."""
    ties = cut_lineage(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
    for _ in range(jumps):
        ahead = ties.select(F.col("node").alias("to"), F.col("to").alias("next"))
        ties = ties.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return ties


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    ``fp`` is the fingerprint over shingles of ``width`` words; documents whose fingerprints differ in at
    most ``radius`` bits are linked, and component_id is the smallest doc_id reachable, the document's
    own included.

    Defined cases: null and empty texts have fingerprint zero and are linked like any other; a null id is
    kept and never the smallest unless there is no other; repeated rows are kept; an empty table gives
    no rows; other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, width))
    found = rooted(prints, radius, 1)
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = found.join(least, "root").select(F.col("f0").alias("fp"), "component_id")
    return prints.withColumnRenamed("f0", "fp").join(found, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 32, compared: int = 3, share: float = 0.12) -> DataFrame:
    """The documents with one of each class of near-duplicates: that of the smallest doc_id.

    Fingerprints over shingles of ``width`` words are compared in 64 * ``compared`` bits, and linked where
    ``radius`` or fewer differ; more bits are made for the segments that bring them together. Edits that leave a Jaccard similarity s of five-word shingles change about (1 - s) / (1 + s)
    of them, three fifths of that share of the three-word ones, and so arccos(1 - 3 (1 - s) / (5 (1 + s)))
    / pi of the bits: 0.12 at 0.8. The segments' plan is made for ``share``, which finds RECALL of the pairs
    so far apart and more of the nearer ones; 32 of 192 bits are two deviations above it. A class is
    what such links join: measured on edited texts, 95 of 100 pairs of a similarity of 0.8 are linked, 99 at
    0.85, and still a third at 0.6.

    The texts are hashed once and shuffled once, to meet the ids that stay.

    Defined cases: rows that repeat an id are told apart by their fingerprints, and of rows alike in both
    one stays; a document without id stays only where no document of its class has one; null and
    empty texts are copies of one another; all columns are returned as they are, whatever their names.
    """
    plan = likely_plan(docs.count(), share)
    longs = max(compared, longs_of(plan))
    names = _names(longs)
    prints = cut_lineage(fingerprints(docs, width, longs))
    alone = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names)
    chosen = rooted(prints, radius, compared, plan).groupBy("root").agg(F.min(alone).alias("x")).select("x.doc_id", *[f"x.{f}" for f in names])
    times = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    stay = chosen.join(times, chosen["doc_id"].eqNullSafe(times["doc_id"])).select(
        chosen["doc_id"].alias("kept"), *[F.col(f).alias(f"k_{f}") for f in names], (chosen["doc_id"].isNull() | (F.col("times") > 1)).alias("shared")
    )
    stay = cut_lineage(stay)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    once = rows.join(stay.where("NOT shared").select("kept"), F.col("id") == F.col("kept"), "left_semi").select("row.*")
    shared = stay.where("shared")
    if shared.isEmpty():
        return once
    several = rows.join(shared.select("kept").distinct(), F.col("id").eqNullSafe(F.col("kept")), "left_semi")
    marked = _with_prints(several.select("row", "id", "text"), width, longs)
    same = F.col("id").eqNullSafe(F.col("kept"))
    for f in names:
        same = same & (F.col(f) == F.col(f"k_{f}"))
    again = marked.join(shared, same, "left_semi").dropDuplicates(["id", *names])
    return once.unionByName(again.select("row.*"))
