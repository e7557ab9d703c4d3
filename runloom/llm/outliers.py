"""Quality rules and robust multivariate outliers: minimum covariance determinants by stratum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runloom.llm import statistics
from runloom.llm.common import map_arrow
from runloom.session import cut_lineage

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats")
SIZE = len(FEATURES)
UNIT = 1024  # features are held as multiples of 1/UNIT, so that sums do not depend on their order
FLOOR = 0.05  # added to every variance: no feature counts more exactly than this
BINS = 16  # bins of squared distance per doubling
# Quantiles of the chi-squared distribution with five degrees of freedom.
CHI2_HALF, CHI2_975, CHI2_999 = 4.351, 12.833, 20.515
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, statistics) of every document; rows stay where they are."""

    def process(batch: pa.RecordBatch) -> dict:
        stats = np.array([statistics.measure(t)[:5] for t in batch.column(3).to_pylist()], dtype=np.int64).reshape(-1, 5)
        return {f"{k}": batch.column(k) for k in range(3)} | {f"s{k}": v for k, v in enumerate(stats.T)}

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("lang", "source", "text")])
    return map_arrow(rows, process, f"doc_id long, lang string, source string, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> list[Column]:
    """The features in whole units: logarithms of length and of smoothed shares, less skewed than counts."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [
        F.log1p(words),
        4 * F.log(F.col("word_chars") / words + 0.5),
        F.log(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)) + 0.02),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log(F.col("n_repeat_words") / words + 0.1),
    ]
    return [F.round(v * UNIT).cast("long").alias(f) for v, f in zip(values, FEATURES, strict=True)]


def packed(center: np.ndarray, cov: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Centre and the lower triangle of W with W' W the inverse of a covariance; a distance is |W (x - centre)|."""
    w = np.linalg.inv(np.linalg.cholesky(cov + floor * np.eye(SIZE)))
    return np.concatenate((center, w[np.tril_indices(SIZE)]))


PARAMS = [f"m{i}" for i in range(SIZE)] + [f"w{i}{j}" for i, j in zip(*np.tril_indices(SIZE), strict=True)]
MOMENTS = [f"s{i}" for i in range(SIZE)] + [f"p{i}{j}" for i, j in zip(*np.tril_indices(SIZE), strict=True)]


def distance() -> Column:
    """Squared Mahalanobis distance of a row from its stratum's parameters, in JVM arithmetic."""
    x = [F.col(f) / F.lit(float(UNIT)) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    rows = []
    for i in range(SIZE):
        total = F.col(f"w{i}0") * x[0]
        for j in range(1, i + 1):
            total = total + F.col(f"w{i}{j}") * x[j]
        rows.append(total * total)
    out = rows[0]
    for r in rows[1:]:
        out = out + r
    return out


def moments(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Counts, sums and sums of products by stratum and bin of distance: exact, and combined map-side."""
    d2 = rows.join(params, "stratum").withColumn("bin", F.floor(F.log2(F.least(F.greatest(distance(), F.lit(2.0**-20)), F.lit(2.0**40))) * BINS))
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in zip(*np.tril_indices(SIZE), strict=True)]
    return d2.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def concentrate(coverage: float, last: bool):
    """One concentration step of a stratum, from its bins.

    The nearest bins that together hold ``coverage`` of the rows give the next centre and covariance,
    scaled so that the median distance is that of a normal distribution. The ``last`` step
    takes the bins within the 97.5 % quantile instead, which wins back efficiency.
    """

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        upto, edge = pdf["n"].cumsum().to_numpy(), 2.0 ** ((pdf["bin"].to_numpy() + 0.5) / BINS)
        total = upto[-1]
        if last:
            scale = max(edge[np.searchsorted(upto, (total + 1) // 2)] / CHI2_HALF, 1e-3)
            keep = max(1, int((edge <= scale * CHI2_975).sum()))
            keep = max(keep, int(np.searchsorted(upto, (total + 1) // 2)) + 1)
        else:
            keep = int(np.searchsorted(upto, coverage * total)) + 1
        chosen = pdf.iloc[:keep]
        n = float(chosen["n"].sum())
        mean = chosen[MOMENTS[:SIZE]].astype(float).sum().to_numpy() / n / UNIT
        cov = np.zeros((SIZE, SIZE))
        cov[np.tril_indices(SIZE)] = chosen[MOMENTS[SIZE:]].astype(float).sum().to_numpy() / n / UNIT**2
        cov = cov + np.tril(cov, -1).T - np.outer(mean, mean)
        cov = (cov + cov.T) / 2 + 1e-9 * np.eye(SIZE)
        values, vectors = np.linalg.eigh(cov)  # rounding may leave a tiny negative variance
        cov = (vectors * np.maximum(values, 0)) @ vectors.T
        return pd.DataFrame([[pdf["stratum"].iloc[0], *packed(mean, cov)]], columns=["stratum", *PARAMS])

    return step


SCHEMA = "stratum string, " + ", ".join(f"{p} double" for p in PARAMS)


def start(rows: DataFrame) -> DataFrame:
    """Parameters to begin with: exact medians, and quartile ranges as spreads."""
    quartiles = rows.groupBy("stratum").agg(*[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in FEATURES])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            q = np.array([list(getattr(row, f)) for f in FEATURES]) / UNIT
            out.append([row.stratum, *packed(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))])
        return pd.DataFrame(out, columns=["stratum", *PARAMS])

    return quartiles.groupBy("stratum").applyInPandas(first, SCHEMA)


def unpacked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of ``packed`` parameters, the floor included."""
    w = np.zeros((SIZE, SIZE))
    w[np.tril_indices(SIZE)] = values[SIZE:]
    back = np.linalg.inv(w)
    return values[:SIZE], back @ back.T


def blend(least: int):
    """Parameters of strata drawn towards those of their language and these towards those of all.

    A wider stratum counts as ``least`` rows of a narrower one for the covariance, and as a row for each feature
    for the centre, which fewer rows settle: weight moves with the number of rows, no size changes the method.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for row in pdf.itertuples(index=False):
                center, cov = None, None
                for level in (2, 1, 0):
                    m, c = unpacked(np.asarray(getattr(row, f"p{level}")))
                    n, scale = getattr(row, f"n{level}"), getattr(row, f"c{level}")
                    own, near = n / (n + least), n / (n + SIZE)
                    center = m if center is None else near * m + (1 - near) * center
                    cov = scale * c if cov is None else own * scale * c + (1 - own) * cov
                rows.append([row.stratum, *packed(center, cov, 0.0)])
            yield pd.DataFrame(rows, columns=["stratum", *PARAMS])

    return run


def judge(docs: DataFrame, coverage: float = 0.5, steps: int = 4, cutoff: float = CHI2_999, least: int = 25) -> DataFrame:
    """(doc_id, statistics, base_failed, distance, kept) of every document.

    Base rules come first: too few words, or too many of them in repeated windows. Of the documents that
    pass, each language and source is a stratum, each language another and all of them one, whose centre and covariance come from a minimum
    covariance determinant: ``steps`` concentrations on the ``coverage`` of the rows that lie nearest,
    from medians and quartiles, then one reweighting. A document is kept if its squared Mahalanobis
    distance is at most ``cutoff``, the 99.9 % quantile of a normal distribution's. It is judged by its language
    and source, drawn towards the language and all by number of rows: a wider stratum counts as ``least`` rows.

    All rows count in every step, by exact sums over bins of distance that combine map-side, so a
    stratum of a third of all rows costs its reducer a few hundred rows. The statistics are written
    once; steps read only them. The parameters, twenty numbers a stratum, are joined by
    whatever plan their size asks for.

    Defined cases: null and empty texts have zero statistics and fail the base rules; null languages and
    sources are strata of their own; a stratum of one value has the floor for its variances; a document
    that fails the base rules has no distance; repeated rows and null ids are kept; other columns are
    ignored; an empty table gives no rows.
    """
    rows = base_statistics(docs).withColumn("base_failed", base_failed())
    keyed = [F.to_json(F.struct(*c), {"ignoreNullFields": "false"}) for c in (("lang", "source"), ("lang",))]
    rows = rows.withColumns({"at0": keyed[0], "at1": keyed[1], "at2": F.lit("{}")})
    rows = cut_lineage(rows.select("*", *transformed()))
    passed = rows.where(~F.col("base_failed")).select(F.explode(F.array("at0", "at1", "at2")).alias("stratum"), *FEATURES)
    params = cut_lineage(start(passed))
    for k in range(steps + 1):
        params = cut_lineage(moments(passed, params).groupBy("stratum").applyInPandas(concentrate(coverage, k == steps), SCHEMA))
    # The distances of the last estimate are brought to those of a normal distribution by their median.
    bins = moments(passed, params).select("stratum", "bin", "n")

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        upto = pdf["n"].cumsum().to_numpy()
        middle = 2.0 ** ((pdf["bin"].iloc[int(np.searchsorted(upto, (upto[-1] + 1) // 2))] + 0.5) / BINS)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "n": [int(upto[-1])], "scale": [max(1.0, middle / CHI2_HALF)]})

    scales = bins.groupBy("stratum").applyInPandas(scale, "stratum string, n long, scale double")
    found = cut_lineage(params.join(scales, "stratum").select("stratum", F.array(*PARAMS).alias("p"), "n", "scale"))
    strata = rows.where(~F.col("base_failed")).select("at0", "at1", "at2").distinct()
    for k in range(3):
        level = found.select(F.col("stratum").alias(f"at{k}"), F.col("p").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.col("scale").alias(f"c{k}"))
        strata = strata.join(level, f"at{k}")
    final = cut_lineage(strata.withColumnRenamed("at0", "stratum").mapInPandas(blend(least), SCHEMA))
    far = F.when(~F.col("base_failed"), distance())
    judged = rows.join(final, F.col("at0") == F.col("stratum"), "left").withColumn("distance", far)
    names = [c.split()[0] for c in STATS.split(", ")]
    return judged.select("doc_id", "lang", "source", *names, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
