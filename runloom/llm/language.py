"""Language mixtures of documents by expectation-maximisation over word likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runloom.llm.common import map_arrow, per_worker, with_columns

UNKNOWN = "und"
# n-grams are counted in so many buckets; the model is this times the number of languages floats.
BUCKETS = 1 << 17
MAX_LANGUAGES = 200


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case where that is one character."""
    size = 0x110000
    letter = np.fromiter((chr(c).isalpha() for c in range(size)), dtype=bool, count=size)
    lower = np.arange(size, dtype=np.uint32)
    for c in range(0x20000):  # no cased letters lie beyond
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return letter, lower


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each letter with its two neighbours, and where each word's letters begin.

    Words are runs of letters in lower case; everything else is a word boundary.
    """
    letter, lower = per_worker("letters", letter_tables)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.concatenate(([False], letter[raw], [False]))
    x = np.where(inside, np.concatenate(([32], lower[raw], [32])), 32).astype(np.uint64)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    mixed = (x[at - 1] << np.uint64(42)) ^ (x[at] << np.uint64(21)) ^ x[at + 1]
    bucket = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
    begins = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    return bucket.astype(np.int64), begins


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): n-gram counts by language over all given rows, summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush():
            for key, held in counts.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([key] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(held[at], pa.int64())})
            counts.clear()

        for batch in batches:
            for body, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bucket, _ = trigrams(body)
                if len(bucket):
                    if key not in counts and len(counts) >= 32:
                        yield from flush()
                    held = counts.setdefault(key, np.zeros(BUCKETS, dtype=np.int64))
                    if len(bucket) > BUCKETS // 8:
                        held += np.bincount(bucket, minlength=BUCKETS)
                    else:
                        np.add.at(held, bucket, 1)
        yield from flush()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.05) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and the log-probability of every bucket under each.

    Counts cover all rows with text and language. What reaches the driver is at most a number per
    bucket and language; more than ``MAX_LANGUAGES`` raise.
    """
    found = count_grams(docs, text, lang).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} are modelled")
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        place = {name: i for i, name in enumerate(names)}
        columns = np.fromiter((place[x] for x in found["lang"].to_pylist()), dtype=np.int64, count=found.num_rows)
        counts[found["bucket"].to_numpy(), columns] = found["n"].to_numpy()
    return names, np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * BUCKETS)).astype(np.float32)


def expect_maximise(likely: np.ndarray, steps: int = 30, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions that maximise the mixture likelihood of the words, and its logarithm.

    ``likely`` holds a likelihood per word and language, scaled so that the largest of a word is 1.
    """
    share = np.full(likely.shape[1], 1.0 / likely.shape[1])
    for _ in range(steps):
        joint = likely * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < close
        share = new
        if done:
            break
    return share, float(np.log(np.maximum(likely @ share, 1e-300)).sum())


def mixture(text: str | None, model: np.ndarray, penalty: float) -> tuple[np.ndarray | None, float]:
    """Proportions by language of a text, and how sure the first is against the next; null without letters.

    The set of languages is the one of the largest log-likelihood less ``penalty`` log(words) for each
    language after the first, found by leaving out the weakest language again and again. A text
    whose likelihood under all languages is no better than that under one, less a penalty, needs no
    search, as no smaller set can be better than all.
    """
    bucket, begins = trigrams(text) if text else (np.zeros(0, dtype=np.int64), None)
    if not len(bucket) or not model.shape[1]:
        return None, 0.0
    words = np.add.reduceat(model[bucket], begins, axis=0)
    best = words.max(axis=1, keepdims=True)
    scaled = (words - best).astype(np.float64)
    single = scaled.sum(axis=0)
    order = np.argsort(-single, kind="stable")
    lead = single[order[0]] - single[order[1]] if len(order) > 1 else np.inf
    cost = penalty * np.log(len(words) + 1.0)
    chosen = np.zeros(model.shape[1])
    chosen[order[0]] = 1.0
    likely = np.exp(np.maximum(scaled, -60.0))
    languages = np.arange(model.shape[1])
    top = single[order[0]]
    while len(languages) > 1:
        share, value = expect_maximise(likely[:, languages])
        if value - cost <= single[order[0]]:
            break
        if value - cost * (len(languages) - 1) > top:
            top = value - cost * (len(languages) - 1)
            chosen = np.zeros(model.shape[1])
            chosen[languages] = share
        languages = np.delete(languages, share.argmin())
    return chosen, float(1.0 / (1.0 + np.exp(-min(lead, 50.0))))


def identify(docs: DataFrame, names: list[str], model: np.ndarray, keep: list[Column | str] | None = None, penalty: float = 2.0) -> DataFrame:
    """For every row of ``docs``: the columns ``keep``, lang_pred, score, share, n_languages.

    lang_pred is the language of the largest proportion, the first in order of name on a tie; score
    is that proportion times the probability of the language against its rival; share is the
    proportion alone. Null text, text without a letter, and any text when no language was learned give
    ``und`` with 0. Only the text is looked at. Rows stay where they are; the model, of a fixed number
    of buckets for at most ``MAX_LANGUAGES`` languages, is broadcast. Repeated rows are kept.
    """
    held = docs.sparkSession.sparkContext.broadcast((names, model))
    if keep is None:  # a column of the result's name gives way to it
        keep = [c for c in docs.columns if c not in ("lang_pred", "score", "share", "n_languages")]
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = with_columns(kept.schema[:-1].fields, "lang_pred string, score double, share double, n_languages int")

    def process(batch: pa.RecordBatch) -> dict:
        names, model = held.value
        out: dict = {f"{i}": batch.column(i) for i in range(batch.num_columns - 1)}
        rows = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            share, sure = mixture(text, model, penalty)
            if share is None:
                rows.append((UNKNOWN, 0.0, 0.0, 0))
            else:
                first = int(share.argmax())
                rows.append((names[first], float(share[first]) * sure, float(share[first]), int((share > 0).sum())))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return out | dict(zip(("lang_pred", "score", "share", "n_languages"), columns, strict=True))

    return map_arrow(kept, process, schema)
