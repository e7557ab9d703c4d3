"""Toxicity by class-conditional Kneser-Ney models of letter sequences with shared backoff."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runloom.llm.common import map_arrow, newest, per_worker, with_columns
from runloom.llm.logistic import fit_cells
from runloom.operators.skew import salted_join
from runloom.session import cut_lineage

ORDER = 5
SYMBOL_BITS = 12  # low bits of each code point in a sequence's key
WIDE_BITS = 9  # its other bits, in the wide part of the key
SLOT_BITS = 22  # slots of the broadcast tables, at most
CAPACITY = 1 << SLOT_BITS - 1  # sequences broadcast; the rest of a model is joined
MARGINS = (1.0, 3.0, 5.0)  # by how much toxic must explain a word better than ordinary for it to count
LEAST = 0.003  # excess per symbol that counts as none
CELL = 8  # cells per unit of a feature, for calibration
FEATURES = ("whole", *(f"excess{int(m)}" for m in MARGINS))


def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter or digit, and its symbol in lower case."""
    size = 0x110000
    inside = np.fromiter((chr(c).isalnum() for c in range(size)), dtype=bool, count=size)
    symbol = np.arange(size, dtype=np.int64)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            symbol[c] = ord(low)
    return inside, symbol


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 5-gram that ends at each letter and word end, as key and wide part, and where each word begins among them.

    A word is a run of letters and digits in lower case, followed by a space; what lies before the word is
    spaces, so that an expression counts alike after any word. The last symbol is in the low bits. The wide
    part holds the bits of code points that the key has no room for, 0 for most alphabets.
    """
    inside, symbol = per_worker("symbols", symbol_table)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    within = np.concatenate((inside[raw], [False]))
    ends = np.concatenate(([False], within[:-1])) & ~within
    keep = within | ends
    if not keep.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = np.where(within, np.concatenate((symbol[raw], [32])), 32)[keep]
    stops = np.flatnonzero(x == 32)
    begins = np.concatenate(([0], stops[:-1] + 1))
    depth = np.arange(len(x)) - np.repeat(begins, stops + 1 - begins)  # letters of the word before
    low, high = x & ((1 << SYMBOL_BITS) - 1), x >> SYMBOL_BITS
    key = preceded(low, depth, 32, SYMBOL_BITS)
    return key, preceded(high, depth, 0, WIDE_BITS) if high.any() else np.zeros(len(x), dtype=np.int64), begins


def preceded(x: np.ndarray, depth: np.ndarray, blank: int, bits: int) -> np.ndarray:
    """Each number with the four before it of its word, ``bits`` bits each; ``blank`` before the word."""
    key = x.copy()
    for lag in range(1, ORDER):
        before = np.full(len(x), blank, dtype=np.int64)
        before[lag:] = x[:-lag] if lag < len(x) else 0
        key |= np.where(depth >= lag, before, blank) << (bits * lag)
    return key


def tally(key: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different sequences among those given, as keys and wide parts, and how often each occurs."""
    if not wide.any():
        found, n = np.unique(key, return_counts=True)
        return found, np.zeros(len(found), dtype=np.int64), n
    found, n = np.unique(np.stack((key, wide)), axis=1, return_counts=True)
    return found[0], found[1], n


def count_grams(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(g, w, t, o): how often each 5-gram, of key g and wide part w, occurs in texts labelled 1 and 0, over all given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held: dict[int, list[tuple]] = {0: [(np.zeros(0, dtype=np.int64),) * 2], 1: [(np.zeros(0, dtype=np.int64),) * 2]}
                for body, mark in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[mark].append(grams(body)[:2])
                (g0, w0, n0), (g1, w1, n1) = (tally(*map(np.concatenate, zip(*held[mark], strict=True))) for mark in (0, 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "g": np.concatenate((g0, g1)),
                        "w": np.concatenate((w0, w1)),
                        "t": np.concatenate((np.zeros(len(g0), dtype=np.int64), n1)),
                        "o": np.concatenate((n0, np.zeros(len(g1), dtype=np.int64))),
                    }
                )

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(label).cast("long").alias("mark")).where("text IS NOT NULL AND mark IN (0, 1)")
    return rows.mapInArrow(run, "g long, w long, t long, o long").groupBy("g", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _suffix(order: int, *names: str) -> list[Column]:
    """Key and wide part of a sequence's last symbols."""
    return [F.col(c).bitwiseAND(F.lit((1 << bits * order) - 1)).alias(to) for c, bits, to in zip("gw", (SYMBOL_BITS, WIDE_BITS), names or "gw", strict=True)]


def _context(*names: str) -> list[Column]:
    """Key and wide part of a sequence without its last symbol."""
    return [F.shiftright(c, bits).alias(to) for c, bits, to in zip("gw", (SYMBOL_BITS, WIDE_BITS), names, strict=True)]


def shared_backoff(types: DataFrame, discount: float = 0.75) -> DataFrame:
    """(s, v, p): Kneser-Ney probability of every 4-gram's last symbol, from the 5-gram types of both classes.

    Lower orders count in how many different ways a sequence is continued to the left, and are
    shared by the classes, so a rare expression is judged by what both know of its parts.
    """
    levels = {}
    at = types.select("g", "w")
    for order in range(ORDER - 1, 0, -1):
        at = at.groupBy(*_suffix(order)).agg(F.count(F.lit(1)).alias("c"))
        levels[order] = at
    below = None
    for order in range(1, ORDER):
        here = levels[order].select("*", *_context("ctx", "wctx"), *_suffix(order - 1, "s", "v"))
        sums = here.groupBy("ctx", "wctx").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
        lower = here.join(sums, ["ctx", "wctx"])
        lower = lower.withColumn("p", F.lit(1.0 / (1 << SYMBOL_BITS))) if below is None else lower.join(below, ["s", "v"])
        below = lower.select(
            F.col("g").alias("s"), F.col("w").alias("v"), ((F.col("c") - discount + F.lit(discount) * F.col("k") * F.col("p")) / F.col("n")).alias("p")
        )
    return below


def class_models(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, w, n, llr) for seen 5-grams and for contexts: the log-likelihood ratio of toxic to ordinary.

    A class gives a seen sequence its discounted frequency plus what it leaves to the shared lower order;
    where neither class saw the sequence but both may know the context, the ratio is that of what
    they leave. A class that never saw the context leaves everything. The discount of a class is
    n1 / (n1 + 2 n2) of its counts once and twice.
    """
    counts = cut_lineage(counts)
    once = counts.agg(*[F.coalesce(F.sum(F.when(F.col(c) == n, 1)), F.lit(0)).alias(f"{c}{n}") for c in "to" for n in (1, 2)]).first()
    discount = {c: min(0.95, max(0.05, once[f"{c}1"] / max(1, once[f"{c}1"] + 2 * once[f"{c}2"]))) for c in "to"}
    contexts = counts.groupBy(*_context("ctx", "wctx")).agg(
        *[F.sum(c).alias(f"n{c}") for c in "to"], *[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"k{c}") for c in "to"]
    )
    left = {c: F.when(F.col(f"n{c}") > 0, F.lit(discount[c]) * F.col(f"k{c}") / F.col(f"n{c}")).otherwise(1.0) for c in "to"}
    contexts = contexts.select("ctx", "wctx", "nt", "no", left["t"].alias("lt"), left["o"].alias("lo"))
    seen = counts.select("*", *_context("ctx", "wctx"), *_suffix(ORDER - 1, "s", "v"))
    seen = seen.join(contexts, ["ctx", "wctx"]).join(shared_backoff(counts), ["s", "v"])
    p = {
        c: F.when(F.col(f"n{c}") > 0, F.greatest(F.col(c) - F.lit(discount[c]), F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0)
        + F.col(f"l{c}") * F.col("p")
        for c in "to"
    }
    return (
        seen.select("g", "w", (F.col("t") + F.col("o")).alias("n"), (F.log(p["t"]) - F.log(p["o"])).alias("llr")),
        contexts.select(F.col("ctx").alias("g"), F.col("wctx").alias("w"), (F.col("nt") + F.col("no")).alias("n"), (F.log("lt") - F.log("lo")).alias("llr")),
    )


def folded(key: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Key and wide part as one number, the key itself where the wide part is 0."""
    if not wide.any():
        return key
    mixed = wide.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key.astype(np.uint64) ^ mixed).view(np.int64) & np.int64((1 << 63) - 1)


def slot_of(key: np.ndarray, slots: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def split(model: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent sequences of a model, ``CAPACITY`` at most, and all others; None if there are none."""
    sizes = sorted(((r["n"], r["m"]) for r in model.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    if sum(m for _, m in sizes) <= CAPACITY:
        return model, None
    total, least = 0, sizes[0][0] + 1
    for n, m in sizes:
        total += m
        if total > CAPACITY:
            break
        least = n
    return model.where(F.col("n") >= least), model.where(F.col("n") < least)


def slotted(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Folded key and ratio of every given sequence; without a column of wide parts they are 0."""
    found = model.select("g", F.col("w") if "w" in model.columns else F.lit(0).cast("long").alias("w"), "llr").toArrow()
    key, wide, llr = (found[c].to_numpy() for c in ("g", "w", "llr"))
    return folded(key, wide), llr.astype(np.float32)


def dense(key: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key, -1 where a slot is empty, and ratio by slot: what a worker looks sequences up in.

    A sequence lies in its slot or, where that is taken, in the next free one. At most half are filled.
    """
    slots = 1 << max(4, (2 * len(key) - 1).bit_length())
    keys, held = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.float32)
    rest, slot = np.arange(len(key)), slot_of(key, slots)
    while len(rest):
        free = keys[slot] == -1
        keys[slot[free]] = key[rest[free]]
        placed = keys[slot] == key[rest]
        held[slot[placed]] = ratio[rest[placed]]
        rest, slot = rest[~placed], (slot[~placed] + 1) & (slots - 1)
    return keys, held


def look_up(key: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Whether each sequence is in the table, and its ratio, else 0."""
    keys, held = table
    slot = slot_of(key, len(keys))
    at = keys[slot]
    known = at == key
    out = np.where(known, held[slot], np.float32(0))
    rest = np.flatnonzero(~known & (at != -1))
    slot = slot[rest]
    while len(rest):
        slot = (slot + 1) & (len(keys) - 1)
        at = keys[slot]
        hit = at == key[rest]
        known[rest[hit]], out[rest[hit]] = True, held[slot[hit]]
        on = ~hit & (at != -1)
        rest, slot = rest[on], slot[on]
    return known, out


def ratios(key: np.ndarray, seen: tuple, contexts: tuple, wide: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood ratio of each symbol given the four before it; 0 where the context is unknown."""
    return found_ratios(key, np.zeros(len(key), dtype=np.int64) if wide is None else wide, seen, contexts)[0]


def found_ratios(key: np.ndarray, wide: np.ndarray, seen: tuple, contexts: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ratios``, and whether the sequence and whether its context were found."""
    known, out = look_up(folded(key, wide), seen)
    rest = np.flatnonzero(~known)
    context = known.copy()
    if len(rest):
        context[rest], out[rest] = look_up(folded(key[rest] >> SYMBOL_BITS, wide[rest] >> WIDE_BITS), contexts)
    return out, known, context


def totals(words: np.ndarray, times: np.ndarray | int = 1) -> list[float]:
    """Sum of the words' ratios, and for each margin of what exceeds it."""
    return [float((words * times).sum()), *[float((np.maximum(words - m, 0) * times).sum()) for m in MARGINS]]


def features(text: str | None, seen: tuple, contexts: tuple) -> tuple[float, ...]:
    """Length-normalised log-likelihood ratios of a text, toxic to ordinary.

    First of the whole; then, for each margin, of its words as far as a word's ratio exceeds the margin, so
    that a few expressions are not outweighed by the ordinary rest. The latter are logarithms of excess
    per symbol. A text without letters and digits is like one without excess.
    """
    key, wide, begins = grams(text) if text else (np.zeros(0, dtype=np.int64),) * 3
    if not len(key):
        return (0.0, *[float(np.log(LEAST))] * len(MARGINS))
    whole, *excess = totals(np.add.reduceat(ratios(key, seen, contexts, wide).astype(np.float64), begins))
    return (whole / len(key), *(float(np.log(e / len(key) + LEAST)) for e in excess))


def parts(text: str | None, seen: tuple, contexts: tuple, whole: tuple[bool, bool]) -> tuple[int, list[float], list[dict]]:
    """Symbols of a text, the totals of its settled words, and its other words, each different one once.

    A word is open while one of its sequences, or the context of an unseen one, may be in the part of a model
    that is not broadcast; ``whole`` says of which model all is. An open word has its number, how often it
    occurs, the ratio of its settled symbols and its open sequences, each with the ratio of its context
    where that is known.
    """
    key, wide, begins = grams(text) if text else (np.zeros(0, dtype=np.int64),) * 3
    if not len(key):
        return 0, [0.0] * len(FEATURES), []
    out, known, context = found_ratios(key, wide, seen, contexts)
    unsettled = ~known & ~(whole[0] & (context | whole[1]))
    words = np.add.reduceat(np.where(unsettled, 0.0, out.astype(np.float64)), begins)
    is_open = np.logical_or.reduceat(unsettled, begins)
    different: dict[tuple, list] = {}
    stops = np.append(begins[1:], len(key))
    for i in np.flatnonzero(is_open):
        a, b = begins[i], stops[i]
        different.setdefault((key[a:b].tobytes(), wide[a:b].tobytes()), [i, 0])[1] += 1
    found = []
    for i, times in different.values():
        at = np.arange(begins[i], stops[i])[unsettled[begins[i] : stops[i]]]
        sequences = [{"g": int(key[k]), "w": int(wide[k]), "base": float(out[k]) if context[k] or whole[1] else None} for k in at]
        found.append({"word": int(i), "times": times, "sum": float(words[i]), "open": sequences})
    return len(key), totals(words[~is_open]), found


def measure(docs: DataFrame, models: Models, keep: list[Column | str]) -> DataFrame:
    """The columns ``keep`` and the features of every row; rows stay where they are.

    Where a model has a part that is not broadcast, the words that may depend on it are settled by joins,
    a row for each different open word of a text and open sequence.
    """
    held, token = docs.sparkSession.sparkContext.broadcast((models.seen, models.contexts)), uuid.uuid4().hex
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    whole = models.more_seen is None, models.more_contexts is None

    def tables() -> tuple:
        return newest("toxicity", token, lambda: tuple(dense(*t) for t in held.value))

    def process(batch: pa.RecordBatch) -> dict:
        last = batch.num_columns - 1
        at = tables()
        rows = [features(text, *at) for text in batch.column(last).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * len(FEATURES)
        return {f"{i}": batch.column(i) for i in range(last)} | dict(zip(FEATURES, columns, strict=True))

    def begin(batch: pa.RecordBatch) -> dict:
        last = batch.num_columns - 1
        at = tables()
        rows = [parts(text, *at, whole) for text in batch.column(last).to_pylist()]
        length, sums, words = list(zip(*rows, strict=True)) or [()] * 3
        return {f"{i}": batch.column(i) for i in range(last)} | {"length": length, "sums": sums, "words": words}

    fields = kept.schema[:-1].fields
    if all(whole):
        return map_arrow(kept, process, with_columns(fields, ", ".join(f"{f} double" for f in FEATURES)))
    layout = "_length long, _sums array<double>, _words array<struct<word: long, times: long, sum: double, open: array<struct<g: long, w: long, base: double>>>>"
    begun = cut_lineage(map_arrow(kept, begin, with_columns(fields, layout)).withColumn("_row", F.monotonically_increasing_id()))
    words = begun.select("_row", F.explode("_words").alias("x")).select("_row", "x.*")
    at = words.select("_row", "word", F.explode("open").alias("x")).select("_row", "word", "x.*", *_context("cg", "cw"))
    for more, on, name in ((models.more_seen, ["g", "w"], "own"), (models.more_contexts, ["cg", "cw"], "left")):
        if more is None:
            at = at.withColumn(name, F.lit(None).cast("double"))
        else:
            right = more.select(F.col("g").alias(on[0]), F.col("w").alias(on[1]), F.col("llr").cast("float").cast("double").alias(name))
            at = cut_lineage(salted_join(at, right, on, how="left"))
    # A row of its own for what is settled of a word, so that one sum by word has all of it.
    found = at.select("_row", "word", F.coalesce("own", "base", "left", F.lit(0.0)).alias("r"), F.lit(0).alias("times"))
    found = found.unionByName(words.select("_row", "word", F.col("sum").alias("r"), "times"))
    found = found.groupBy("_row", "word").agg(F.sum("r").alias("r"), F.sum("times").alias("times"))
    excess = [F.col("r"), *[F.greatest(F.col("r") - m, F.lit(0.0)) for m in MARGINS]]
    more = found.groupBy("_row").agg(*[F.sum(e * F.col("times")).alias(f"_m{i}") for i, e in enumerate(excess)])
    total = [F.col("_sums")[i] + F.coalesce(f"_m{i}", F.lit(0.0)) for i in range(len(FEATURES))]
    by = F.greatest(F.col("_length"), F.lit(1))
    done = [total[0] / by, *[F.log(t / by + LEAST) for t in total[1:]]]
    return begun.join(more, "_row", "left").select(*[f"`{f.name}`" for f in fields], *[c.alias(f) for c, f in zip(done, FEATURES, strict=True)])


class Models(NamedTuple):
    """Of 5-grams and of contexts: what is broadcast, and the table of the rest or None."""

    seen: tuple
    contexts: tuple
    more_seen: DataFrame | None
    more_contexts: DataFrame | None


def learn_models(labelled: DataFrame) -> Models:
    """The models of 5-grams and of contexts learned from all rows (text, toxic)."""
    (seen, more_seen), (contexts, more_contexts) = (split(cut_lineage(m)) for m in class_models(count_grams(labelled, "text", "toxic")))
    return Models(slotted(seen), slotted(contexts), more_seen, more_contexts)


def _units() -> list[Column]:
    """Features in cells; the ratio of the whole within the range of the others."""
    return [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col(f))) * CELL for f in FEATURES]


def calibrate(marked: DataFrame) -> np.ndarray:
    """Logistic weights from all rows (features, toxic), brought together as counts of feature cells."""
    names = list(FEATURES)
    cells = marked.select(*[F.round(u).cast("int").alias(f) for u, f in zip(_units(), names, strict=True)], F.col("toxic").cast("int").alias("mark"))
    cells = cells.where("mark IN (0, 1)").groupBy(*names, "mark").agg(F.count(F.lit(1)).alias("n"))
    return fit_cells(cells.toArrow(), names)


def score(measured: DataFrame, weights: np.ndarray) -> DataFrame:
    """``measured`` with score, the calibrated probability of label 1."""
    z = F.lit(float(weights[0]))
    for w, u in zip(weights[1:], _units(), strict=True):
        z = z + F.lit(float(w)) * u
    return measured.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def detect(docs: DataFrame, labels: DataFrame, for_model: Column, for_calibration: Column, keep: list[Column | str] | None = None) -> DataFrame:
    """The columns ``keep`` (all), the features and the score of every document, from labels (doc_id, toxic).

    The class models are counted over all labelled documents that ``for_model`` admits, the
    calibration over those that ``for_calibration`` admits; both are conditions on doc_id, and documents
    counted into a model should not calibrate it. The labels meet the texts of the former in one
    join, and only the features of the latter. Scoring leaves rows where they are.

    Broadcast are the ``CAPACITY`` most frequent sequences of each model; the others are joined, and
    the result is the same. Defined cases: a null or empty text, or
    one without letters and digits, has no excess and the score of that; without any labels every
    score is 1/2; labels other than 0 and 1 are ignored; a document with several label rows counts
    with each; repeated rows and null ids are scored like any other; without ``keep``, a column of a
    feature's name or ``score`` gives way to the result's.
    """
    kept = [c for c in docs.columns if c not in (*FEATURES, "score")] if keep is None else keep
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic"))
    training = docs.where(for_model).select(F.col("doc_id").cast("long").alias("_doc"), "text")
    # The same plan at every size: small labels would be broadcast, many cannot be.
    models = learn_models(training.join(marks.hint("merge"), F.col("_doc") == F.col("_id")))
    measured = measure(docs.where(for_calibration), models, ["doc_id"])
    marked = measured.join(marks, F.col("doc_id").cast("long") == F.col("_id"))
    return score(measure(docs, models, kept), calibrate(marked))
