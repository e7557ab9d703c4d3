"""Array datasets: preparation, element functions, sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runloom.contract.base import CELLS, PIXELS, double_images, images, query, rounded, table
from runloom.functions import arrays, neural, targets
from runloom.operators import dataset, reports, sliding
from runloom.operators.scans import row_index
from runloom.session import shared_path

IDX = "SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings"


def _placed(spark, sf) -> DataFrame:
    return row_index(images(spark, sf).select("id", "label"), ["id"])


def _elements(df: DataFrame, data: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(data).alias("k", "v"))


# -- order, split, chunk ---------------------------------------------------------


@query(
    "s9_input_data",
    "SELECT '2024.01.01-00.00.00' AS populate_time, row_number() OVER (ORDER BY vec_id) AS idx, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64))
    + " FROM embeddings",
)
def _(spark, sf):
    from runloom.operators.records import profile_rows

    placed = row_index(double_images(spark, sf).select("id", "data"), ["id"], start=1)
    return profile_rows(placed.select("idx", *arrays.spread(F.col("data"), "x", 64)), stamp="2024.01.01-00.00.00")


@query("w5_chunk", f"SELECT id, label, idx, idx - idx % 30 AS chunk FROM ({IDX})")
def _(spark, sf):
    return dataset.chunk(_placed(spark, sf), 30)


TENTH = "(SELECT count(*) // 10 AS n FROM embeddings)"


@query("w5_batch_number", f"SELECT id, idx // 100 AS batch FROM ({IDX})")
def _(spark, sf):
    return _placed(spark, sf).select("id", dataset.batch_number(F.col("idx"), 100).alias("batch"))


@query(
    "w6_split",
    f"""SELECT id, label, idx, CASE WHEN idx < 6 * n THEN 'train' WHEN idx < 8 * n THEN 'valid' ELSE 'test' END AS "set"
FROM ({IDX}), {TENTH} WHERE idx < 10 * n - 5""",
)
def _(spark, sf):
    return dataset.split(_placed(spark, sf), *_split_sizes(spark, sf))


def _split_sizes(spark, sf) -> tuple[int, int, int]:
    """Six, two and two tenths of the rows, less five that are left out."""
    tenth = images(spark, sf).count() // 10
    return 6 * tenth, 2 * tenth, 2 * tenth - 5


@query(
    "s16_write_splits",
    f"""SELECT CASE WHEN idx < 6 * n THEN 'train' WHEN idx < 8 * n THEN 'valid' ELSE 'test' END AS "set",
count(*) AS num_rows, CAST(sum(id) AS BIGINT) AS id_sum FROM ({IDX}), {TENTH} WHERE idx < 10 * n - 5 GROUP BY 1""",
)
def _(spark, sf):
    path = shared_path(spark, "splits")
    dataset.write_parts(dataset.split(_placed(spark, sf), *_split_sizes(spark, sf)), path, "set")
    return spark.read.parquet(path).groupBy("set").agg(F.count(F.lit(1)).alias("num_rows"), F.sum("id").alias("id_sum"))


@query(
    "s16_write_chunks",
    f"SELECT idx - idx % 30 AS chunk, count(*) AS num_rows, CAST(sum(id) AS BIGINT) AS id_sum FROM ({IDX}) GROUP BY 1",
)
def _(spark, sf):
    path = shared_path(spark, "chunks")
    dataset.write_parts(dataset.chunk(_placed(spark, sf), 30), path, "chunk")
    written = spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk"))
    return written.agg(F.count(F.lit(1)).alias("num_rows"), F.sum("id").alias("id_sum"))


@query(
    "p9_split_by_class",
    "SELECT label, count(*) AS num_rows, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY label",
)
def _(spark, sf):
    path = shared_path(spark, "classes")
    dataset.write_parts(images(spark, sf), path, "label")
    by_class = spark.read.parquet(path).groupBy("label")
    return by_class.agg(F.count(F.lit(1)).alias("num_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    "s3_batch_sets",
    "SELECT 'embeddings.parquet' AS \"set\", count(*) AS num_entries, CAST(sum(label) AS BIGINT) AS label_sum FROM embeddings",
)
def _(spark, sf):
    from runloom.sources.sets import parquet_sets

    sets = parquet_sets(spark, f"{sf}/embeddings*.parquet")
    return sets.groupBy("set").agg(F.count(F.lit(1)).alias("num_entries"), F.sum("label").alias("label_sum"))


@query(
    "o7_shuffle",
    "SELECT event_id AS id, row_number() OVER (ORDER BY (event_id * 48271 + 11) % 2147483647, event_id) - 1 AS idx FROM events",
)
def _(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return dataset.shuffle(ids, sort_key=(F.col("id") * 48271 + 11) % 2147483647)


@query(
    "o7_shuffle_hashed",
    """SELECT count(*) AS num_rows, count(DISTINCT event_id) AS different_ids, CAST(sum(event_id) AS BIGINT) AS id_sum, count(*) AS different_places,
0::BIGINT AS first_place, count(*) - 1 AS last_place, true AS same_again, true AS mixed FROM events""",
)
def _(spark, sf):
    """What any repeatable shuffle must show: every row once, every place once, the same order again, another order than before."""
    ids = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    order = F.bit_xor(F.xxhash64("id", "idx"))
    again = dataset.shuffle(ids.repartition(5), seed=7, epoch=1).agg(order.alias("again"))
    facts = dataset.shuffle(ids, seed=7, epoch=1).agg(
        F.count(F.lit(1)).alias("num_rows"), F.countDistinct("id").alias("different_ids"), F.sum("id").alias("id_sum"),
        F.countDistinct("idx").alias("different_places"), F.min("idx").cast("long").alias("first_place"), F.max("idx").cast("long").alias("last_place"),
        order.alias("order"), (F.abs(F.corr("id", "idx")) < 0.1).alias("mixed"),
    )
    both = facts.join(F.broadcast(again))  # one row each
    return both.select("*", (F.col("order") == F.col("again")).alias("same_again")).drop("order", "again")


# -- ranges, rescaling, one-hot ---------------------------------------------------


@query(
    "a10_image_range",
    """SELECT vec_id AS id, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings""",
)
def _(spark, sf):
    return double_images(spark, sf).select("id", F.array_min("data").alias("low"), F.array_max("data").alias("high"))


@query("a10_set_range", "SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high FROM embeddings")
def _(spark, sf):
    return double_images(spark, sf).agg(F.min(F.array_min("data")).alias("low"), F.max(F.array_max("data")).alias("high"))


@query("a15_target_range", "SELECT min(label) AS low, max(label) - min(label) + 1 AS classes FROM embeddings")
def _(spark, sf):
    return images(spark, sf).agg(F.min("label").alias("low"), (F.max("label") - F.min("label") + 1).alias("classes"))


SPAN = f"""px AS ({PIXELS}),
span AS (SELECT *, min(v) OVER (PARTITION BY id) AS lo, max(v) OVER (PARTITION BY id) AS hi,
         min(v) OVER () AS all_lo, max(v) OVER () AS all_hi FROM px)"""


@query(
    "f8_to_pixels",
    f"WITH {SPAN} SELECT id, k, CAST(floor(coalesce(255.0::DOUBLE / nullif(hi - lo, 0) * (v - lo), 0)) AS INTEGER) AS v FROM span",
)
def _(spark, sf):
    return _elements(dataset.to_pixels(double_images(spark, sf)), "pixels", "id")


@query(
    "f8_to_pixels_whole_set",
    f"WITH {SPAN} SELECT id, k, CAST(floor(255.0::DOUBLE / nullif(all_hi - all_lo, 0) * (v - all_lo)) AS INTEGER) AS v FROM span",
)
def _(spark, sf):
    return _elements(dataset.to_pixels(double_images(spark, sf), each=False), "pixels", "id")


UNIT = "2.0::DOUBLE * (v - lo) / nullif(hi - lo, 0) - 1"


@query("f9_to_unit_range", f"WITH {SPAN} SELECT id, k, round({UNIT}, 6) AS v FROM span")
def _(spark, sf):
    scaled = double_images(spark, sf).withColumn("data", arrays.to_unit_range(F.col("data")))
    return rounded(_elements(scaled, "data", "id"), "v")


@query(
    "f9_to_unit_range_by_channel",
    f"""WITH px AS ({PIXELS}),
span AS (SELECT *, min(v) OVER (PARTITION BY id, k // 16) AS lo, max(v) OVER (PARTITION BY id, k // 16) AS hi FROM px)
SELECT id, k, round({UNIT}, 6) AS v FROM span""",
)
def _(spark, sf):
    scaled = double_images(spark, sf).withColumn("data", arrays.to_unit_range_by_channel(F.col("data"), 4, 16))
    return rounded(_elements(scaled, "data", "id"), "v")


@query(
    "f10_one_hot",
    """SELECT vec_id AS id, k, CASE WHEN k = label - (SELECT min(label) FROM embeddings) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v
FROM embeddings, range((SELECT max(label) - min(label) + 1 FROM embeddings)) r(k)""",
)
def _(spark, sf):
    return _elements(dataset.with_one_hot(images(spark, sf)), "target", "id")


@query(
    "f11_eight_bit",
    f"""WITH {SPAN} SELECT id, k, round((floor((({UNIT}) + 1) / 2 * 255.0) / 255.0 - 0.5) * 2, 6) AS v FROM span""",
)
def _(spark, sf):
    scaled = double_images(spark, sf).withColumn("data", arrays.to_unit_range(F.col("data")))
    return rounded(_elements(dataset.eight_bit(scaled), "data", "id"), "v")


@query(
    "f12_from_eight_bit",
    f"WITH {SPAN} SELECT id, k, round(floor(255.0::DOUBLE / nullif(hi - lo, 0) * (v - lo)) / 127.5 - 1, 6) AS v FROM span",
)
def _(spark, sf):
    pixels = dataset.to_pixels(double_images(spark, sf)).select("id", arrays.from_eight_bit(F.col("pixels")).alias("data"))
    return rounded(_elements(pixels, "data", "id"), "v")


@query("f13_cells", f"SELECT id, 0 AS c, y, x, v FROM ({CELLS})")
def _(spark, sf):
    return arrays.cells(double_images(spark, sf), "data", 8, 8, "id")


@query(
    "f13_channels_first",
    "SELECT vec_id AS id, k, embedding[(k % 16) * 4 + k // 16 + 1]::DOUBLE AS v FROM embeddings, range(64) r(k)",
)
def _(spark, sf):
    moved = double_images(spark, sf).withColumn("data", arrays.channels_first(F.col("data"), 4, 4, 4))
    return _elements(moved, "data", "id")


@query(
    "o4_sort_inside_row",
    f"WITH px AS ({PIXELS}) SELECT id, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS k, v FROM px",
)
def _(spark, sf):
    return _elements(double_images(spark, sf).withColumn("data", arrays.ascending(F.col("data"))), "data", "id")


@query("o6_argmax", "SELECT vec_id AS id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def _(spark, sf):
    return double_images(spark, sf).select("id", arrays.argmax(F.col("data")).alias("best"))


# -- activations on every element -------------------------------------------------

Z = "v * 1000"


def _activated(spark, sf, f) -> DataFrame:
    made = double_images(spark, sf).withColumn("data", F.transform("data", lambda v: f(v * 1000)))
    return rounded(_elements(made, "data", "id"), "v")


SIGMOID = f"1 / (1 + exp(-greatest({Z}, -400)))"


@query("f1_sigmoid", f"SELECT id, k, round({SIGMOID}, 6) AS v FROM ({PIXELS})")
def _(spark, sf):
    return _activated(spark, sf, neural.sigmoid)


@query("f3_relu", f"SELECT id, k, round(greatest({Z}, 0), 6) AS v FROM ({PIXELS})")
def _(spark, sf):
    return _activated(spark, sf, neural.relu)


@query("f4_sigmoid_slope", f"SELECT id, k, round(({SIGMOID}) * (1 - {SIGMOID}), 6) AS v FROM ({PIXELS})")
def _(spark, sf):
    return _activated(spark, sf, lambda z: neural.sigmoid_slope(neural.sigmoid(z)))


@query("f4_relu_slope", f"SELECT id, k, CASE WHEN {Z} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM ({PIXELS})")
def _(spark, sf):
    return _activated(spark, sf, lambda z: neural.relu_slope(neural.relu(z)))


@query("f4_unit_slope", f"SELECT id, k, 1.0::DOUBLE AS v FROM ({PIXELS})")
def _(spark, sf):
    return _activated(spark, sf, neural.unit_slope)


@query(
    "f2_softmax",
    f"SELECT id, k, round(exp(least({Z}, 400)) / sum(exp(least({Z}, 400))) OVER (PARTITION BY id), 6) AS v FROM ({PIXELS})",
)
def _(spark, sf):
    made = double_images(spark, sf).withColumn("data", neural.softmax(F.transform("data", lambda v: v * 1000)))
    return rounded(_elements(made, "data", "id"), "v")


# -- synthetic targets --------------------------------------------------------------

INPUTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS x0, l_tax AS x1, l_quantity / 50 AS x2 FROM lineitem"
XS = ["x0", "x1", "x2"]


def _inputs(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("x0"), F.col("l_tax").alias("x1"), (F.col("l_quantity") / 50).alias("x2")
    )


MEAN = "(x0 + x1 + x2) / 3"


@query("f23_sigmoid_target", f'SELECT *, round(10 * (1 / (1 + exp(-({MEAN})) - 0.5)), 6) AS y0, round({MEAN}, 6) AS "xAvg" FROM ({INPUTS})')
def _(spark, sf):
    return rounded(targets.with_target(_inputs(spark, sf), "sigmoid", XS), "y0", "xAvg")


@query("f24_linear_target", f'SELECT *, round(4 * (x1 + 2 * x2), 6) AS y0, round(x1 + 2 * x2, 6) AS "xLin" FROM ({INPUTS})')
def _(spark, sf):
    return rounded(targets.with_target(_inputs(spark, sf), "lin", XS), "y0", "xLin")


@query("f25_sine_target", f'SELECT *, round(10 * sin({MEAN}), 6) AS y0, round({MEAN}, 6) AS "xAvg" FROM ({INPUTS})')
def _(spark, sf):
    return rounded(targets.with_target(_inputs(spark, sf), "sin", XS), "y0", "xAvg")


@query("f26_random_target", "SELECT count(*) AS num_rows, true AS in_range, true AS spread FROM lineitem")
def _(spark, sf):
    """Random values lie in the range, fill it, and have its middle as their mean."""
    found = targets.with_target(_inputs(spark, sf), "random", XS, seed=3)
    low, high = F.min("y0"), F.max("y0")
    return found.agg(
        F.count(F.lit(1)).alias("num_rows"), ((low >= -5) & (high < 5)).alias("in_range"),
        ((low < -4.9) & (high > 4.9) & (F.abs(F.avg("y0")) < 0.2)).alias("spread"),
    )


@query(
    "f27_network_target",
    f"""WITH t AS (SELECT *, row_number() OVER () AS r FROM ({INPUTS})),
h AS (SELECT *, {", ".join(f"1 / (1 + exp(-greatest((x0 * {j} + x1 * {4 + j} + x2 * {8 + j} + {j}) / 100.0, -400))) AS h{j}" for j in range(4))} FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, x0, x1, x2,
{", ".join(f"round(({' + '.join(f'h{k} * {k * 2 + j + 1}' for k in range(4))} + {j - 1}) / 100.0, 6) AS y{j}" for j in range(2))} FROM h""",
)
def _(spark, sf):
    from runloom.plans.score import network_target

    made = network_target(_inputs(spark, sf), XS, [3, 4, 2], ["FC_SIG", "FC_LIN"])
    return rounded(made, "y0", "y1")


# -- sliding windows ------------------------------------------------------------------


def _cells(spark, sf) -> DataFrame:
    return arrays.cells(double_images(spark, sf), "data", 8, 8, "id")


@query(
    "n15_patches",
    f"""SELECT id, y // 2 AS i, x // 2 AS j, y % 2 AS ky, x % 2 AS kx, v FROM ({CELLS})""",
)
def _(spark, sf):
    return sliding.patch_cells(_cells(spark, sf), 8, 8, 2, 2, 0).select("id", "i", "j", "ky", "kx", "v")


@query(
    "j6_patch_join",
    f"""SELECT (y + 1 - ky) // 2 AS i, (x + 1 - kx) // 2 AS j, ky, kx, count(*) AS num_cells, round(sum(v), 6) AS total
FROM ({CELLS}), range(4) a(ky), range(4) b(kx)
WHERE (y + 1 - ky) >= 0 AND (y + 1 - ky) % 2 = 0 AND (y + 1 - ky) // 2 < 4
  AND (x + 1 - kx) >= 0 AND (x + 1 - kx) % 2 = 0 AND (x + 1 - kx) // 2 < 4 GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    patches = sliding.patch_cells(_cells(spark, sf), 8, 8, 4, 2, 1)
    summed = patches.groupBy("i", "j", "ky", "kx").agg(F.count(F.lit(1)).alias("num_cells"), F.sum("v").alias("total"))
    return rounded(summed, "total")


@query(
    "x2_window_aggregate",
    f"""WITH cell AS ({CELLS}),
grid AS (SELECT vec_id AS id, y, x FROM embeddings, range(-1, 9) a(y), range(-1, 9) b(x)),
padded AS (SELECT id, y, x, coalesce(v, 0) AS v FROM grid LEFT JOIN cell USING (id, y, x))
SELECT id, i, j, round(min(v), 6) AS low, round(avg(v), 6) AS mean, count(*) AS num_cells
FROM padded, range(4) c(i), range(4) d(j) WHERE y - 2 * i + 1 BETWEEN 0 AND 3 AND x - 2 * j + 1 BETWEEN 0 AND 3 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    made = sliding.separable_windows(_cells(spark, sf), 8, 8, 4, 2, 1, {"low": "min", "total": "sum"}, with_padding=True)
    made = made.select("id", "i", "j", "low", (F.col("total") / 16).alias("mean"), F.lit(16).cast("long").alias("num_cells"))
    return rounded(made, "low", "mean")


@query(
    "x2_window_any_aggregate",
    f"""WITH cell AS ({CELLS}),
grid AS (SELECT vec_id AS id, y, x FROM embeddings, range(-1, 9) a(y), range(-1, 9) b(x)),
padded AS (SELECT id, y, x, coalesce(v, 0) AS v FROM grid LEFT JOIN cell USING (id, y, x))
SELECT id, i, j, round(max(v) - min(v), 6) AS spread, count(DISTINCT v) AS num_values
FROM padded, range(4) c(i), range(4) d(j) WHERE y - 2 * i + 1 BETWEEN 0 AND 3 AND x - 2 * j + 1 BETWEEN 0 AND 3 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    wanted = {"spread": F.max("v") - F.min("v"), "num_values": F.count_distinct("v")}
    made = sliding.window2d(_cells(spark, sf), 8, 8, 4, 2, 1, wanted, with_padding=True)
    return rounded(made.drop("c"), "spread")


@query(
    "x2_window_function",
    f"""WITH cell AS ({CELLS})
SELECT id, i * 4 + j AS k, round(max(abs(v)) - min(abs(v)), 6) AS v FROM cell, range(4) c(i), range(4) d(j)
WHERE y // 2 = i AND x // 2 = j GROUP BY id, i, d.j""",
)
def _(spark, sf):
    """A function no built-in layer has: the spread of magnitudes in each window."""
    from runloom.plans.score import map_windows

    spread = lambda w: abs(w).max(axis=(4, 5)) - abs(w).min(axis=(4, 5))
    made = map_windows(images(spark, sf), spread, "id", image=(1, 8, 8), kernel=2, stride=2)
    return rounded(_elements(made, "y", "id"), "v")


# -- runs and epochs ----------------------------------------------------------------

TURNS = "SELECT conv_id AS run, turn AS epoch, length(text) / 1000 AS metric FROM conversations"


def _turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run"), F.col("turn").alias("epoch"), (F.length("text") / 1000).alias("metric")
    )


@query(
    "w2_best_checkpoint",
    f"""WITH t AS ({TURNS}), s AS (SELECT *, coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM t)
SELECT run, epoch, metric, best_before, metric > best_before AS is_checkpoint, greatest(metric, best_before) AS best_correct FROM s""",
)
def _(spark, sf):
    return reports.best_checkpoint(_turns(spark, sf), "run", "epoch", "metric")


@query(
    "w2b_best_cost",
    f"SELECT run, epoch, metric, min(metric) OVER (PARTITION BY run ORDER BY epoch) AS best_cost FROM ({TURNS})",
)
def _(spark, sf):
    scanned = reports.best_checkpoint(_turns(spark, sf), "run", "epoch", "metric", cost="metric")
    return scanned.select("run", "epoch", "metric", "best_cost")


@query(
    "w2_best_hot",
    """WITH s AS (SELECT event_type AS run, event_id AS epoch, value AS metric, coalesce(max(value) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM events)
SELECT run, epoch, metric, best_before, metric > best_before AS is_checkpoint, greatest(metric, best_before) AS best_correct FROM s""",
)
def _(spark, sf):
    """A few runs hold everything: each is cut into blocks."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("metric"))
    return reports.best_checkpoint(events, "run", "epoch", "metric")


def _sliced_sql(by: str) -> str:
    """Pixel sums of every third image from the seventh, scaled over ``by``."""
    return f"""WITH p AS (SELECT vec_id AS id, label AS category, row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings),
s AS (SELECT id, category, (idx - 7) // 3 AS img, unnest(embedding)::DOUBLE AS v FROM p WHERE idx >= 7 AND (idx - 7) % 3 = 0),
x AS (SELECT *, min(v) OVER ({by}) AS lo, max(v) OVER ({by}) AS hi FROM s)
SELECT img, 'img' || img || '_channel1_category' || category AS name, id, category, CAST(sum(floor(coalesce(255.0::DOUBLE / nullif(hi - lo, 0) * (v - lo), 0))) AS BIGINT) AS pixel_sum
FROM x GROUP BY img, id, category"""


def _sliced(spark, sf, individual: bool):
    shown = reports.export_images(images(spark, sf).withColumn("data", F.col("data").cast("array<double>")), 7, None, 3, individual=individual)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v)
    return shown.select("img", "name", "id", "category", total.alias("pixel_sum"))


@query("s15_export_slice", _sliced_sql("PARTITION BY id"))
def _(spark, sf):
    return _sliced(spark, sf, True)


@query("s15_export_slice_one_scale", _sliced_sql(""))
def _(spark, sf):
    return _sliced(spark, sf, False)
