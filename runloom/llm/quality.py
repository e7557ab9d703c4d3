"""Quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runloom.llm import statistics
from runloom.llm.common import map_arrow
from runloom.llm.logistic import fit_cells
from runloom.session import cut_lineage

FEATURES = (
    "words", "word_length", "distinct", "repeated", "lines_repeated", "line_length", "upper", "digits", "symbols", "marks", "stops", "non_ascii",
)
CELL = 4  # cells per unit of the transformed density difference, for calibration


def transform(stats: np.ndarray) -> np.ndarray:
    """Features of rows of statistics: logarithms of counts and of shares, which tames long tails.

    A share enters as log(share + 0.01), so a share of none is a finite value and small shares count alike.
    """
    n = dict(zip(statistics.NAMES, stats.T.astype(np.float64), strict=True))
    words, chars = np.maximum(n["n_words"], 1), np.maximum(n["word_chars"], 1)
    ascii_chars = n["n_upper"] + n["n_lower"] + n["n_digits"] + n["n_marks"] + n["n_stops"]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.log(np.clip(a / b, 0, 1) + 0.01)

    return np.column_stack(
        [
            np.log1p(n["n_words"]),
            np.log(n["word_chars"] / words + 0.5),
            share(n["n_distinct"], words),
            share(n["n_repeat_words"], words),
            share(n["n_dup_lines"], np.maximum(n["n_lines"], 1)),
            np.log(words / np.maximum(n["n_lines"], 1)),
            share(n["n_upper"], chars),
            share(n["n_digits"], chars),
            share(n["n_symbols"], chars),
            share(n["n_marks"], chars),
            share(n["n_stops"], chars),
            share(np.maximum(chars - ascii_chars, 0), chars),
        ]
    )


def features(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, features) of every document; rows stay where they are."""

    def process(batch: pa.RecordBatch) -> dict:
        stats = np.array([statistics.measure(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(statistics.NAMES))
        return {"doc_id": batch.column(0)} | dict(zip(FEATURES, transform(stats).T, strict=True))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string"))
    return map_arrow(rows, process, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


class Discriminant:
    """Class means and Cholesky factors of shrunken class covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooling: float = 0.2, ridge: float = 0.05):
        """``moments`` has (rows, sums, sums of products) by class.

        A class covariance is drawn to the pooled one by ``pooling``, and both to a multiple of the
        identity by ``ridge``; a class of few rows is drawn further, by rows of the dimension.
        """
        size = len(FEATURES)
        stats = {c: (n, s / n, p / n - np.outer(s / n, s / n)) for c, (n, s, p) in moments.items() if n > 0}
        total = sum(n for n, _, _ in stats.values())
        pooled = sum((n * v for n, _, v in stats.values()), np.zeros((size, size))) / max(total, 1)
        spread = max(np.trace(pooled) / size, 1e-6)
        self.classes = {}
        for c, (n, mean, own) in stats.items():
            lean = min(1.0, pooling + size / (n + size))
            cov = (1 - ridge) * ((1 - lean) * own + lean * pooled) + ridge * spread * np.eye(size)
            factor = np.linalg.cholesky(cov)
            self.classes[c] = (np.log(n / total), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 with its prior, less that of class 0; 0 when a class is missing."""
        if set(self.classes) != {0, 1}:
            return np.zeros(len(x))
        value = {}
        for c, (prior, mean, inverse, log_det) in self.classes.items():
            value[c] = prior - log_det - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
        return value[1] - value[0]


def learn(marked: DataFrame, mark: str) -> Discriminant:
    """The discriminant of all rows (features, mark): sums by class, made by Spark."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    moments = {}
    for row in marked.groupBy(F.col(mark).cast("int").alias("mark")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).where("mark IN (0, 1)").collect():
        product = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            product[i, j] = product[j, i] = row[f"p{i}_{j}"]
        moments[row["mark"]] = (row["n"], np.array([row[f"s{i}"] for i in range(len(FEATURES))]), product)
    return Discriminant(moments)


def differences(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` (doc_id, features, ...) as (doc_id, difference, ...), the difference as its signed log."""
    rest = [c for c in rows.columns if c not in FEATURES and c != "doc_id"]
    held = rows.sparkSession.sparkContext.broadcast(model)  # two means and two factors

    def process(batch: pa.RecordBatch) -> dict:
        x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 1 + len(FEATURES))]).reshape(-1, len(FEATURES))
        d = held.value.difference(x)
        return {"doc_id": batch.column(0), "difference": np.sign(d) * np.log1p(np.abs(d))} | {
            c: batch.column(1 + len(FEATURES) + k) for k, c in enumerate(rest)
        }

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return map_arrow(rows.select("doc_id", *FEATURES, *rest), process, f"doc_id long, difference double{kinds}", rows=65_536)


def classify(docs: DataFrame, labels: DataFrame, learnable: Column, mark: str = "quality") -> DataFrame:
    """(doc_id, difference, score) of every document, from labels (doc_id, mark) that ``learnable`` admits.

    One pass over the texts writes the features; labels meet that small table. The score is the
    probability of label 1 by the log-density difference of the two classes, calibrated on the same
    labels by two numbers.

    Defined cases: a null or empty text has the features of no words and its score; without labels, or
    with one class only, differences are 0 and the score is the share of label 1, smoothed by one row of
    each; labels other than 0 and 1 are ignored; repeated rows and null ids are scored alike; other
    columns are ignored.
    """
    measured = cut_lineage(features(docs))
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(mark).cast("int").alias("mark"))
    marked = measured.where(learnable).join(marks, F.col("doc_id") == F.col("_id")).drop("_id")
    model = learn(marked, "mark")
    cells = differences(marked, model).select(F.round(F.col("difference") * CELL).cast("int").alias("difference"), "mark").where("mark IN (0, 1)")
    w = fit_cells(cells.groupBy("difference", "mark").agg(F.count(F.lit(1)).alias("n")).toArrow(), ["difference"])
    z = F.lit(float(w[0])) + F.lit(float(w[1]) * CELL) * F.col("difference")
    return differences(measured, model).withColumn("score", 1.0 / (1.0 + F.exp(-z)))
