"""Spelling variants: a minimised vocabulary acceptor, a one-edit transducer and the acceptor again."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runloom.session import cut_lineage

RUNS = "[A-Za-zÀ-ÿ]+"
# Words that one task composes at once at most; a larger partition is cut by two more letters.
PARTITION_WORDS = 20_000
STEP = 2
# Different words that a task counts before it hands them on.
COUNTED = 200_000


def word_counts(docs: DataFrame, pattern: str = RUNS, least: int = 7, slip: int | None = None) -> DataFrame:
    """(word, n) of all runs of ``pattern`` with at least ``least`` code points, A-Z lower-cased.

    With ``slip``, a run loses one code point where the CRC-32 h of ``<doc_id>:<run>`` is a multiple
    of it: that at h modulo its length. The CRC depends on document and run only, so each different
    run of a document is hashed once. Tasks count before the shuffle.
    """
    runs = re.compile(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(lowered)).items():
                    if len(word) < least:
                        continue
                    if slip:
                        h = zlib.crc32(word.encode(), seed)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    held[word] += n
                if len(held) >= COUNTED:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


# An acceptor's node is a dictionary from letter to node; the key "" marks a final node.


def acceptor(words: list[str], skip: int) -> dict:
    """The minimised acceptor of sorted, different words, without their first ``skip`` letters.

    Words are added in order; what the next word cannot change any more is replaced by an equal
    node that is known already, so nodes with equal right languages are one object.
    """
    known: dict[tuple, dict] = {}
    root: dict = {}
    path: list[dict] = [root]
    last = ""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            key = tuple([(c, id(to)) for c, to in node.items()])
            path[-1][last[len(path) - 1]] = known.setdefault(key, node)

    for word in words:
        word = word[skip:]
        top, at = min(len(word), len(last)), 0
        while at < top and word[at] == last[at]:
            at += 1
        settle(at)
        for letter in word[at:]:
            node: dict = {}
            path[-1][letter] = node
            path.append(node)
        path[-1][""] = None
        last = word
    settle(0)
    return root


def compose(root: dict) -> Iterator[tuple[str, str]]:
    """The pairs accepted by acceptor, one-edit transducer and acceptor, each once: (shorter or smaller, other).

    Before the edit both sides are in one state, as the acceptor is deterministic. A replaced letter leads to
    the targets of two letters, an inserted one to a state and one of its targets; from there both
    sides must read the same, and what they can is remembered by state pair. An insertion into a run of
    equal letters is made at the run's begin only.
    """
    memo: dict[tuple[int, int], tuple] = {}

    def common(u: dict, v: dict) -> tuple:
        """The words that both states accept."""
        key = (id(u), id(v))
        if (found := memo.get(key)) is not None:
            return found
        out, read = [], []
        while True:
            both = u.keys() & v.keys()
            if "" in both:
                out.append("".join(read))
                both.discard("")
            if len(both) != 1:
                break
            letter = both.pop()
            read.append(letter)
            u, v = u[letter], v[letter]
        if both:
            start = "".join(read)
            for letter in both:
                out += [start + letter + rest for rest in common(u[letter], v[letter])]
        memo[key] = found = tuple(out)
        return found

    path: list[str] = []
    stack: list[tuple[dict, int, str]] = [(root, 0, "")]
    while stack:
        node, depth, letter = stack.pop()
        del path[max(depth - 1, 0) :]
        if depth:
            path.append(letter)
        arcs = [(c, to) for c, to in node.items() if c]
        start = None
        for i, (c, to) in enumerate(arcs):
            if c != letter and (rests := common(node, to)):
                start = "".join(path) if start is None else start
                for rest in rests:
                    yield start + rest, start + c + rest
            for d, other in arcs[i + 1 :]:
                if rests := common(to, other):
                    start = "".join(path) if start is None else start
                    for rest in rests:
                        yield start + c + rest, start + d + rest
        stack += [(to, depth + 1, c) for c, to in arcs]


def partitioned(words: DataFrame) -> DataFrame:
    """(side, base, depth, suffix, key, form, n): every word in each partition that may hold a near word of it.

    Of two near words, the shorter of length l, either the first l // 2 letters are the same or the last
    l - l // 2. So the states in which the composition starts are those after such a prefix, over the
    words (side 0) and over the words reversed (side 1). A word is the shorter one or has one letter
    more, so it starts in one or two states a side.
    """
    size, whole = F.length("word"), F.col("word")
    short = F.array_distinct(F.array(F.floor(size / 2), F.floor((size - 1) / 2)))
    long = F.array_distinct(F.array(size - F.floor(size / 2), size - 1 - F.floor((size - 1) / 2)))
    starts = F.concat(
        F.transform(short, lambda k: F.struct(F.lit(0).alias("side"), k.cast("int").alias("base"))),
        F.transform(long, lambda k: F.struct(F.lit(1).alias("side"), k.cast("int").alias("base"))),
    )
    rows = words.select("word", "n", F.explode(starts).alias("s")).select("n", "s.*", F.when(F.col("s.side") == 1, F.reverse(whole)).otherwise(whole).alias("form"))
    return rows.select("side", "base", F.col("base").alias("depth"), F.lit("").alias("suffix"), _prefix("form", F.col("base")).alias("key"), "form", "n")


def _prefix(text: str, n: Column) -> Column:
    return F.substring(F.col(text), F.lit(1), n)


GROUP = ["side", "base", "depth", "suffix", "key"]


def bounded(parts: DataFrame, most: int) -> DataFrame:
    """The same pairs from partitions of at most ``most`` words, where letters can tell words apart.

    A larger partition after a prefix of k letters is cut: pairs with STEP more letters in common start
    after those; the others have their edit among these letters, so all that follows is the same and
    joins the key, aligned from the end, for the length of the shorter word. What is left between is
    STEP letters, or one more.
    """
    done = None
    while True:
        sizes = parts.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
        large = cut_lineage(sizes.where((F.col("size") > most) & (F.col("suffix") == "")).drop("size"))
        if large.isEmpty():
            return parts if done is None else done.unionByName(parts)
        small = parts.join(large, GROUP, "left_anti")
        hot = cut_lineage(parts.join(large, GROUP, "left_semi"))
        done = cut_lineage(small if done is None else done.unionByName(small))
        deeper = F.col("depth") + STEP
        longer = hot.where(F.length("form") >= deeper)
        further = longer.withColumn("key", _prefix("form", deeper)).withColumn("depth", deeper)
        # The shorter word of a pair has this length; a length from a terminal mark on tells lengths apart.
        lengths = F.explode(F.array(F.length("form"), F.length("form") - 1)).alias("l")
        cut = hot.select("*", lengths).where(F.col("l") >= F.col("depth"))
        rest = F.concat(F.col("l").cast("string"), F.lit(":"), F.expr("right(form, greatest(l - depth - %d, 0))" % STEP))
        cut = cut.withColumn("suffix", rest).drop("l")
        done = cut_lineage(done.unionByName(cut.select(*done.columns)))
        parts = cut_lineage(further.select(*hot.columns))


def near_words(parts: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words with a near one; best is (-n, word) of the most frequent, the smallest of equals.

    Rows are dealt and sorted by partition, so a task composes one partition after the other and holds no
    more than one.
    """

    def pairs(side: int, base: int, depth: int, suffix: str, forms: list[str]) -> Iterator[tuple[str, str]]:
        """Each pair of near words in the one partition that answers for it."""
        for x, y in compose(acceptor(forms, depth)):
            head = forms[0][:depth]
            x, y = head + x, head + y
            size = len(x)
            half = size // 2
            if (half if side == 0 else size - half) != base:
                continue
            if suffix and (size != int(suffix[: suffix.index(":")]) or x[: depth + STEP] == y[: depth + STEP]):
                continue
            if side:
                x, y = x[::-1], y[::-1]
                if x[:half] == y[:half]:
                    continue
            yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)
        found: dict[str, list] = {}
        group: tuple | None = None
        forms: list[str] = []
        counts: list[int] = []

        def finish() -> None:
            if len(forms) < 2:
                return
            side, base, depth, suffix, _ = group
            of = dict(zip(forms, counts, strict=True))
            for x, y in pairs(side, base, depth, suffix, forms):
                n, m = (of[x[::-1]], of[y[::-1]]) if side else (of[x], of[y])
                for a, key in ((x, (-m, y)), (y, (-n, x))):
                    if (held := found.get(a)) is None:
                        found[a] = [1, key]
                    else:
                        held[0] += 1
                        if key < held[1]:
                            held[1] = key

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for *key, form, n in zip(*columns, strict=True):
                if (key := tuple(key)) != group:
                    finish()
                    group, forms, counts = key, [], []
                forms.append(form)
                counts.append(n)
            if len(found) >= COUNTED:
                yield _found(found)
                found.clear()
        finish()
        if found:
            yield _found(found)

    rows = parts.select(*GROUP, "form", "n").repartition(*GROUP).sortWithinPartitions(*GROUP, "form")
    out = rows.mapInArrow(run, "word string, n_near long, m long, near string")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "near")).alias("best"))


def _found(found: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()),
            pa.array([x[1][0] for x in found.values()], pa.int64()), pa.array([x[1][1] for x in found.values()], pa.string()),
        ],
        ["word", "n_near", "m", "near"],
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the pairs (word, form): the last word that the forms lead to.

    Every form is more frequent than its word, so there are no cycles; each round doubles the steps.
    """
    known = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = cut_lineage(stepped)
        known = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return known


def variants(counts: DataFrame, ratio: int = 10, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of a table (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its
    near word of largest n, the smallest of equals in code-point order, if that n is at least ``ratio``
    times its own; root follows forms to the last.

    Words are partitioned by the state in which a composition starts, half of the word read from either
    end; a partition of more than ``most`` words is cut by further letters (``bounded``). Every task
    composes the minimised acceptor of one partition with one edit and itself.

    Defined cases: null words are left out; words must be different; an empty table gives no rows.
    """
    words = cut_lineage(counts.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    found = near_words(bounded(partitioned(words), most))
    chosen = F.when(-F.col("best.m") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")))
    rows = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), chosen.alias("c"))
    rows = cut_lineage(rows.select("word", "n", "n_near", "c.form", "c.form_n"))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, pattern: str = RUNS, least: int = 7, occurrences: int = 2, slip: int | None = None, ratio: int = 10) -> DataFrame:
    """``variants`` of the words of all texts that occur at least ``occurrences`` times.

    Defined cases: null and empty texts have no words; a null id counts as an empty text in the CRC;
    repeated rows count each time; a text of one endless run is one word; other columns are ignored.
    """
    return variants(word_counts(docs, pattern, least, slip).where(F.col("n") >= occurrences), ratio)
