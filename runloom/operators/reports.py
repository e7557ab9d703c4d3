"""Evaluation and training reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions import arrays
from runloom.operators.dataset import stride_slice
from runloom.operators.scans import row_index, running
from runloom.operators.skew import default_share, hot_keys

TOTAL = "TOTAL"


def mean_of(column: str) -> Column:
    return F.sum(column) / F.count(F.lit(1))


def accuracy_of(correct: str, cost: str = "CE") -> Column:
    """Share of correct rows; always 0 unless the cost is cross-entropy."""
    return F.avg(F.col(correct).cast("double")) if cost == "CE" else F.lit(0.0)


def per_set(scored: DataFrame, by: str = "set", cost: str = "cost", correct: str = "correct") -> DataFrame:
    """Entries, accuracy and mean cost of each set."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_entries"), accuracy_of(correct).alias("accuracy"), mean_of(cost).alias("cost")
    )


def eval_report(scored: DataFrame, by: str = "set", cost: str = "cost", correct: str = "correct") -> DataFrame:
    """Per-set rows and a TOTAL row over all entries, sets first.

    The total row is recognised by its grouping flag: a set may itself be NULL.
    """
    rolled = scored.rollup(by).agg(
        F.grouping(by).alias("_all"),
        F.count(F.lit(1)).alias("num_entries"),
        accuracy_of(correct).alias("accuracy"),
        mean_of(cost).alias("cost"),
    )
    label = F.when(F.col("_all") == 1, TOTAL).otherwise(F.col(by).cast("string"))
    shown = rolled.select(label.alias("file"), "num_entries", "accuracy", "cost", "_all")
    return shown.orderBy("_all", "file").drop("_all")


def weighted_total(summary: DataFrame) -> DataFrame:
    """One entry-weighted row from per-set rows (num_entries, accuracy, cost)."""
    n = F.col("num_entries")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * n), F.sum(n)).alias(c)
    return summary.agg(F.sum(n).alias("num_entries"), mean("accuracy"), mean("cost"))


def unweighted_total(summary: DataFrame) -> DataFrame:
    """Plain mean over sets, whatever their size, with the number of entries beside it."""
    return summary.agg(
        F.sum("num_entries").alias("num_entries"), F.avg("accuracy").alias("accuracy"), F.avg("cost").alias("cost")
    )


def epoch_metrics(batches: DataFrame, cost: str = "cost", correct: str = "correct") -> DataFrame:
    """Per epoch the plain mean of the batch means: a short last batch counts fully."""
    per_batch = batches.groupBy("epoch", "batch").agg(mean_of(cost).alias("c"), accuracy_of(correct).alias("a"))
    return per_batch.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("num_batches"), F.avg("c").alias("cost_batch"), F.avg("a").alias("correct_batch")
    )


def best_checkpoint(costs: DataFrame, run: str, epoch: str, correct: str, cost: str | None = None) -> DataFrame:
    """Mark the epochs that beat every earlier one, the first being compared with 0.

    Adds ``best_before``, ``is_checkpoint`` and ``best_correct``, and with ``cost`` also
    the lowest cost so far (``best_cost``). ``epoch`` must be unique within a run.
    """
    seen = {"best_before": ("max", F.col(correct))}
    hot = hot_keys(costs, [run], default_share(costs.sparkSession))
    out = running(costs, [run], [epoch], seen, inclusive=False, hot=hot)
    before = F.coalesce(F.col("best_before").cast("double"), F.lit(0.0))
    out = out.withColumn("best_before", before)
    out = out.withColumn("is_checkpoint", F.coalesce(F.col(correct) > F.col("best_before"), F.lit(False)))
    out = out.withColumn("best_correct", F.greatest("best_before", F.col(correct)))
    if cost is not None:
        out = running(out, [run], [epoch], {"best_cost": ("min", F.col(cost))}, hot=hot)
    return out


def evaluation_rank(
    scored: DataFrame, id_col: str = "id", y: str = "y", correct: str = "correct", name: str = "index"
) -> DataFrame:
    """Number the rows by (correct, top probability): wrong rows first, least confident first."""
    top = scored.withColumn("_top", F.array_max(y))
    return row_index(top, ["_top", id_col], name, groups=[correct]).drop("_top")


def evaluation_detail(
    scored: DataFrame, classes: int, set_name: str = "null", id_col: str = "id", y: str = "y", correct: str = "correct"
) -> DataFrame:
    """(name, index, is_correct, cat0..): cat columns are the sorted probabilities of a row.

    Pass a materialised frame when scoring is costly: the ranking reads it three times.
    """
    ranked = evaluation_rank(scored.select(id_col, y, correct), id_col, y, correct)
    return ranked.select(
        F.lit(set_name).alias("name"),
        "index",
        F.col(correct).cast("int").alias("is_correct"),
        *arrays.spread(arrays.ascending(F.col(y)), "cat", classes),
    )


def misclassified(scored: DataFrame, id_col: str = "id", data: str = "data", channels: int = 1) -> DataFrame:
    """Wrongly classified images as pixels, with both classes and a numbered file name."""
    wrong = scored.where(F.col("correct") == 0)
    numbered = row_index(
        wrong.select(id_col, arrays.to_pixels(F.col(data)).alias("pixels"), "label", "predicted"), [id_col], "img"
    )
    name = F.format_string(f"img%d_channel{channels}_correct%d_wrong%d", "img", "label", "predicted")
    classes = [F.col("label").alias("correct"), F.col("predicted").alias("wrong")]
    return numbered.select("img", name.alias("name"), id_col, "pixels", *classes)


def export_images(
    df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, id_col: str = "id", data: str = "data", label: str = "label",
    channels: int = 1, individual: bool = True,
) -> DataFrame:
    """Any slice of a dataset as pixels, with numbered file names: (img, name, id, pixels, category).

    The slice is taken in id order. Pixels are scaled by each image's own range, or by that of the
    slice unless ``individual``.
    """
    placed = row_index(df.select(id_col, data, label), [id_col], "_at")
    chosen = stride_slice(placed, start, stop, step, "_at")
    img = F.floor((F.col("_at") - start) / step).cast("long")
    if individual:
        pixels = arrays.to_pixels(F.col(data))
    else:
        span = chosen.agg(F.min(F.array_min(data)).alias("_low"), F.max(F.array_max(data)).alias("_high"))
        chosen = chosen.join(F.broadcast(span))  # one row
        pixels = arrays.to_pixels(F.col(data), F.col("_low"), F.col("_high"))
    name = F.format_string(f"img%d_channel{channels}_category%d", img, F.col(label))
    return chosen.select(img.alias("img"), name.alias("name"), id_col, pixels.alias("pixels"), F.col(label).alias("category"))
