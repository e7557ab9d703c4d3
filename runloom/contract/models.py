"""Networks: layers forward and backward, scoring, reports, training."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from runloom.contract.base import (
    B0,
    CLASSES,
    CONV,
    CONV_OUT,
    FLAT,
    PIXELS,
    SCORED,
    W0,
    bias,
    conv_net,
    double_images,
    flat_net,
    images,
    layer_net,
    pooled_net,
    query,
    rounded,
    table,
    weight,
)
from runloom.functions import arrays, neural, normal
from runloom.operators import reports, sliding
from runloom.operators.scans import row_index
from runloom.plans import gradients, tiles
from runloom.plans.checkpoints import load_model, save_model
from runloom.plans.kernels import ACTIVATIONS, COSTS as COST_TABLE, Dense
from runloom.plans.network import Network
from runloom.plans.score import evaluate, evaluate_details, predict, score, weight_rows
from runloom.plans.tiles import relational_forward
from runloom.plans.training import fit, fit_many
from runloom.session import cut_lineage, shared_path


def _scored(spark, sf, *keep: str, with_y: bool = False) -> DataFrame:
    return score(images(spark, sf), flat_net(), "id", *keep, target="label", with_y=with_y)


def _outputs(df: DataFrame, *keep: str) -> DataFrame:
    return rounded(df.select(*keep, F.posexplode("y").alias("j", "y")), "y")


def _cells(spark, sf) -> DataFrame:
    return arrays.cells(double_images(spark, sf), "data", 8, 8, "id")


def _flat_cells(spark, sf) -> DataFrame:
    return double_images(spark, sf).select("id", F.posexplode("data").alias("k", "v"))


# -- layers forward ------------------------------------------------------------------

DENSE = {"type": "FC_LIN", "num_channels": CLASSES}
DENSE_SQL = f"SELECT id, j, round(sum(v * {W0}) + any_value({B0}), 6) AS y FROM ({PIXELS}), range(10) r(j) GROUP BY id, j"


@query("n1_dense_forward", DENSE_SQL)
def _(spark, sf):
    return _outputs(score(images(spark, sf), layer_net(DENSE, False), "id"), "id")


@query("n1_dense_forward_by_join", DENSE_SQL)
def _(spark, sf):
    return rounded(relational_forward(_flat_cells(spark, sf), layer_net(DENSE, False)), "y")


CONV_SQL = f"WITH {CONV_OUT} SELECT id, e * 64 + i * 8 + j AS j, round(v, 6) AS y FROM conv"


@query("n2_convolution_forward", CONV_SQL)
def _(spark, sf):
    return _outputs(score(images(spark, sf), layer_net(CONV, True), "id"), "id")


@query("n2_convolution_forward_by_join", CONV_SQL)
def _(spark, sf):
    made = relational_forward(_cells(spark, sf), layer_net(CONV, True))
    return rounded(made.select("id", (F.col("c") * 64 + F.col("y") * 8 + F.col("x")).alias("j"), F.col("v").alias("y")), "y")


# 3 x 3 windows, stride 2, padding 1 on 8 x 8 do not divide; 4 x 4, stride 2, padding 1 do.
PADDED_POOL = {"type": "MAXPOOL", "num_channels": 1, "kernel_size": 4, "stride": 2, "padding": 1}
POOL_SQL = """WITH c AS (SELECT vec_id AS id, unnest(range(64)) // 8 AS y, unnest(range(64)) % 8 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT id, i * 4 + j AS j, round(CASE WHEN count(*) < 16 THEN greatest(max(v), 0) ELSE max(v) END, 6) AS y
FROM c, range(4) a(i), range(4) b(j) WHERE y - 2 * i + 1 BETWEEN 0 AND 3 AND x - 2 * j + 1 BETWEEN 0 AND 3 GROUP BY id, i, b.j"""


@query("n3_max_pool_forward", POOL_SQL)
def _(spark, sf):
    return _outputs(score(images(spark, sf), layer_net(PADDED_POOL, True), "id"), "id")


@query("n3_max_pool_forward_by_join", POOL_SQL)
def _(spark, sf):
    made = relational_forward(_cells(spark, sf), layer_net(PADDED_POOL, True))
    return rounded(made.select("id", (F.col("y") * 4 + F.col("x")).alias("j"), F.col("v").alias("y")), "y")


NETWORK_SQL = f"""WITH {CONV_OUT},
pool AS (SELECT id, e * 16 + (i // 2) * 4 + j // 2 AS k, max(v) AS v FROM conv GROUP BY 1, 2),
z AS (SELECT id, j, sum(v * ((7 * k + 13 * j + 2) % 11 - 5) / 10.0) + any_value(((3 * j + 2) % 5 - 2) / 10.0) AS z
      FROM pool, range(10) r(j) GROUP BY id, j)
SELECT id, j, round(exp(least(z, 400)) / sum(exp(least(z, 400))) OVER (PARTITION BY id), 6) AS y FROM z"""


@query("n4_network_forward", NETWORK_SQL)
def _(spark, sf):
    return _outputs(score(images(spark, sf), pooled_net(), "id"), "id")


@query("n4_network_forward_by_join", NETWORK_SQL)
def _(spark, sf):
    return rounded(relational_forward(_cells(spark, sf), pooled_net()), "y")


@query("j4_model_tiles", NETWORK_SQL)
def _(spark, sf):
    """The model is read from a table of tiles, and no task or driver holds it whole."""
    path = shared_path(spark, "tiles")
    tiles.save_tiles(spark, pooled_net(), path)
    return _outputs(tiles.score_tiles(images(spark, sf), spark.read.parquet(path), "id"), "id")


# -- scores and reports -----------------------------------------------------------------


@query("n5_predict", f"WITH {SCORED} SELECT 'img' || id || '.png' AS name, predicted FROM scored")
def _(spark, sf):
    named = images(spark, sf).withColumn("name", F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".png")))
    return predict(named, flat_net(), "name")


EVALUATE_SQL = f"""WITH {SCORED} SELECT count(*) AS num_entries, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy,
round(sum(cost) / count(*), 6) AS cost FROM scored"""


@query("n6_evaluate", EVALUATE_SQL)
def _(spark, sf):
    return rounded(evaluate(images(spark, sf), flat_net()), "accuracy", "cost")


@query("s14_saved_model_evaluate", EVALUATE_SQL)
def _(spark, sf):
    path = shared_path(spark, "model")
    save_model(spark, flat_net(), path, "run-1")
    return rounded(evaluate(images(spark, sf), load_model(spark, path, "run-1")), "accuracy", "cost")


@query("a4_mean_cost", f"WITH {SCORED} SELECT label, round(sum(cost) / count(*), 6) AS cost FROM scored GROUP BY label")
def _(spark, sf):
    by_label = _scored(spark, sf, "label").groupBy("label").agg(reports.mean_of("cost").alias("cost"))
    return rounded(by_label, "cost")


@query(
    "a5_accuracy",
    f"""WITH {SCORED} SELECT label, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, 0.0::DOUBLE AS accuracy_sqr
FROM scored GROUP BY label""",
)
def _(spark, sf):
    made = _scored(spark, sf, "label").groupBy("label")
    made = made.agg(reports.accuracy_of("correct").alias("accuracy"), F.max(reports.accuracy_of("correct", "SQR")).alias("accuracy_sqr"))
    return rounded(made, "accuracy")


@query(
    "a6_epoch_metrics",
    f"""WITH {SCORED},
b AS (SELECT id // 250 AS epoch, (id % 250) // 60 AS batch, avg(cost) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM scored GROUP BY 1, 2)
SELECT epoch, count(*) AS num_batches, round(avg(c), 6) AS cost_batch, round(avg(a), 6) AS correct_batch FROM b GROUP BY epoch""",
)
def _(spark, sf):
    placed = _scored(spark, sf).select(
        F.floor(F.col("id") / 250).alias("epoch"), F.floor(F.pmod("id", F.lit(250)) / 60).alias("batch"), "cost", "correct"
    )
    return rounded(reports.epoch_metrics(placed), "cost_batch", "correct_batch")


SETS = """sets AS (SELECT id % 3 AS f, count(*) AS n, avg(CAST(correct AS DOUBLE)) AS a, avg(cost) AS c FROM scored GROUP BY 1)"""


def _by_set(spark, sf) -> DataFrame:
    return _scored(spark, sf).select(F.pmod("id", F.lit(3)).alias("set"), "cost", "correct")


@query(
    "a7_eval_report",
    f"""WITH {SCORED} SELECT coalesce(CAST(id % 3 AS VARCHAR), 'TOTAL') AS file, count(*) AS num_entries,
round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(sum(cost) / count(*), 6) AS cost FROM scored GROUP BY ROLLUP (id % 3)""",
)
def _(spark, sf):
    return rounded(reports.eval_report(_by_set(spark, sf)), "accuracy", "cost")


@query(
    "a8_unweighted_report",
    f"""WITH {SCORED}, {SETS} SELECT CAST(sum(n) AS BIGINT) AS num_entries, round(avg(a), 6) AS accuracy, round(avg(c), 6) AS cost FROM sets""",
)
def _(spark, sf):
    return rounded(reports.unweighted_total(reports.per_set(_by_set(spark, sf))), "accuracy", "cost")


@query(
    "a9_weighted_report",
    f"""WITH {SCORED}, {SETS} SELECT CAST(sum(n) AS BIGINT) AS num_entries, round(sum(a * n) / sum(n), 6) AS accuracy,
round(sum(c * n) / sum(n), 6) AS cost FROM sets""",
)
def _(spark, sf):
    return rounded(reports.weighted_total(reports.per_set(_by_set(spark, sf))), "accuracy", "cost")


@query(
    "w4_evaluation_rank",
    f"""WITH {SCORED} SELECT id, correct, row_number() OVER (ORDER BY correct, top, id) - 1 AS "index" FROM scored""",
)
def _(spark, sf):
    return reports.evaluation_rank(cut_lineage(_scored(spark, sf, with_y=True))).select("id", "correct", "index")


@query(
    "n6_evaluation_detail",
    f"""WITH {SCORED}, c AS (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY y) - 1 AS r FROM p)
SELECT 'test' AS name, row_number() OVER (ORDER BY correct, top, id) - 1 AS "index", correct AS is_correct,
{", ".join(f"(SELECT round(y, 6) FROM c WHERE c.id = scored.id AND r = {i}) AS cat{i}" for i in range(10))} FROM scored""",
)
def _(spark, sf):
    detail, _wrong = evaluate_details(images(spark, sf), flat_net(), "test")
    return rounded(detail, *[f"cat{i}" for i in range(CLASSES)])


@query(
    "s15_export_misclassified",
    f"""WITH {SCORED},
px2 AS (SELECT id, floor(255.0::DOUBLE / nullif(max(v) OVER (PARTITION BY id) - min(v) OVER (PARTITION BY id), 0) * (v - min(v) OVER (PARTITION BY id))) AS p FROM px)
SELECT row_number() OVER (ORDER BY id) - 1 AS img, id, label AS correct, predicted AS wrong,
(SELECT CAST(sum(p) AS BIGINT) FROM px2 WHERE px2.id = scored.id) AS pixel_sum FROM scored WHERE correct = 0""",
)
def _(spark, sf):
    _detail, wrong = evaluate_details(double_images(spark, sf), flat_net(), "test")
    path = shared_path(spark, "wrong")
    wrong.write.parquet(path)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v)
    return spark.read.parquet(path).select("img", "id", "correct", "wrong", total.alias("pixel_sum"))


@query(
    "s11_output_data",
    f"""WITH {FLAT} SELECT '2024.01.01-00.00.00' AS populate_time, dense_rank() OVER (ORDER BY id) AS idx, 1 AS epoch, 5 AS batch,
{", ".join(f"round(max(CASE WHEN j = {i} THEN y END), 6) AS y{i}" for i in range(10))} FROM p GROUP BY id""",
)
def _(spark, sf):
    from runloom.operators.records import profile_rows

    scored = cut_lineage(score(images(spark, sf), flat_net(), "id"))
    placed = row_index(scored.select("id", "y"), ["id"], start=1)
    wide = placed.select("idx", F.lit(1).alias("epoch"), F.lit(5).alias("batch"), *arrays.spread(F.col("y"), "y", CLASSES))
    return profile_rows(rounded(wide, *[f"y{i}" for i in range(CLASSES)]), stamp="2024.01.01-00.00.00")


# -- costs on network outputs --------------------------------------------------------------

TARGETS = "t AS (SELECT *, CASE WHEN j = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM p)"


def _with_targets(spark, sf) -> DataFrame:
    return _scored(spark, sf, "label", with_y=True).select("id", "y", arrays.one_hot(F.col("label"), CLASSES).alias("t"))


@query("f5_squared_cost", f"WITH {FLAT}, {TARGETS} SELECT id, round(0.5 * sum((y - t) * (y - t)), 6) AS cost FROM t GROUP BY id")
def _(spark, sf):
    return rounded(_with_targets(spark, sf).select("id", neural.squared_cost(F.col("y"), F.col("t")).alias("cost")), "cost")


@query("f6_cross_entropy", f"WITH {FLAT}, {TARGETS} SELECT id, round(-sum(t * ln(y + 1e-30)), 6) AS cost FROM t GROUP BY id")
def _(spark, sf):
    return rounded(_with_targets(spark, sf).select("id", neural.cross_entropy(F.col("y"), F.col("t")).alias("cost")), "cost")


@query(
    "f7_cost_slope",
    f"WITH {FLAT}, {TARGETS} SELECT id, j, round((y - t) / (SELECT count(*) FROM embeddings), 9) + 0.0::DOUBLE AS y FROM t",
)
def _(spark, sf):
    rows = images(spark, sf).count()
    made = _with_targets(spark, sf).select("id", neural.cost_slope(F.col("y"), F.col("t"), rows).alias("y"))
    return rounded(made.select("id", F.posexplode("y").alias("j", "y")), "y", digits=9)


# -- gradients ---------------------------------------------------------------------------------

DELTA = f"""{FLAT}, n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT id, j, (y - CASE WHEN j = label THEN 1 ELSE 0 END) / n AS d FROM p, n)"""
DENSE_GRADIENT_SQL = f"""WITH {DELTA}
SELECT 'w' AS part, CAST(k * 10 + j AS INTEGER) AS pos, round(sum(v * d), 8) + 0.0::DOUBLE AS g FROM px JOIN d USING (id) GROUP BY k, j
UNION ALL SELECT 'b', CAST(j AS INTEGER), round(sum(d), 8) + 0.0::DOUBLE FROM d GROUP BY j"""


@query("n7_dense_backward", DENSE_GRADIENT_SQL)
def _(spark, sf):
    data = images(spark, sf)
    return rounded(gradients.gradient_rows(data, flat_net(), data.count()).drop("layer"), "g", digits=8)


@query("n7_dense_backward_by_join", DENSE_GRADIENT_SQL)
def _(spark, sf):
    data = double_images(spark, sf)
    slope = neural.cost_slope(F.col("y"), arrays.one_hot(F.col("label"), CLASSES), data.count())
    scored = cut_lineage(score(data, flat_net(), "id", "label"))
    deltas = scored.select("id", F.posexplode(slope).alias("j", "d"))
    by_weight = sliding.dense_weight_gradient(_flat_cells(spark, sf), deltas)
    weights = by_weight.select(F.lit("w").alias("part"), (F.col("k") * CLASSES + F.col("j")).alias("pos"), "g")
    by_bias = deltas.groupBy("j").agg(F.sum("d").alias("g")).select(F.lit("b").alias("part"), F.col("j").alias("pos"), "g")
    return rounded(weights.unionByName(by_bias), "g", digits=8)


@query(
    "a11_gradient_sum",
    f"""WITH {DELTA} SELECT j, round(sum(d), 8) + 0.0::DOUBLE AS bias_gradient FROM d GROUP BY j""",
)
def _(spark, sf):
    data = images(spark, sf)
    rows = gradients.gradient_rows(data, flat_net(), data.count()).where("part = 'b'")
    return rounded(rows.select(F.col("pos").alias("j"), F.col("g").alias("bias_gradient")), "bias_gradient", digits=8)


CONV_DELTA = f"""{CONV_OUT}, n AS (SELECT count(*) AS n FROM embeddings),
fw AS (SELECT k, q, ((7 * k + 13 * q + 1) % 11 - 5) / 10.0 AS w FROM range(128) a(k), range(10) b(q)),
z AS (SELECT id, label, q, sum(v * w) + any_value(((3 * q + 1) % 5 - 2) / 10.0) AS z
      FROM conv JOIN fw ON k = e * 64 + i * 8 + j GROUP BY id, label, q),
o AS (SELECT id, label, q, exp(least(z, 400)) / sum(exp(least(z, 400))) OVER (PARTITION BY id) AS y FROM z),
od AS (SELECT id, q, (y - CASE WHEN q = label THEN 1 ELSE 0 END) / n AS d FROM o, n),
cd AS (SELECT conv.id, e, i, j, sum(d * w) * any_value(CASE WHEN conv.v > 0 THEN 1 ELSE 0 END) AS d
       FROM conv JOIN fw ON k = e * 64 + i * 8 + j JOIN od ON od.id = conv.id AND od.q = fw.q GROUP BY conv.id, e, i, j)"""


CONV_GRADIENT_SQL = f"""WITH {CONV_DELTA}
SELECT 'w' AS part, CAST(e * 9 + ky * 3 + kx AS INTEGER) AS pos, round(sum(v * d), 8) + 0.0::DOUBLE AS g
FROM cell JOIN cd USING (id), range(3) a(ky), range(3) b(kx) WHERE y + 1 - ky = i AND x + 1 - kx = j GROUP BY e, ky, kx
UNION ALL SELECT 'b', CAST(e AS INTEGER), round(sum(d), 8) + 0.0::DOUBLE FROM cd GROUP BY e"""


@query("n8_convolution_backward", CONV_GRADIENT_SQL)
def _(spark, sf):
    data = images(spark, sf)
    rows = gradients.gradient_rows(data, conv_net(), data.count()).where("layer = 0")
    return rounded(rows.drop("layer"), "g", digits=8)


def _conv_deltas(spark, sf) -> DataFrame:
    """Derivatives by the convolution's output, through the dense layer, by joins."""
    net, data = conv_net(), double_images(spark, sf)
    slope = neural.cost_slope(F.col("y"), arrays.one_hot(F.col("label"), CLASSES), data.count())
    top = score(data, net, "id", "label").select("id", F.posexplode(slope).alias("j", "d"))
    dense_w, _ = weight_rows(net, 1, spark)
    back = top.join(dense_w, "j").groupBy("id", "k").agg(F.sum(F.col("d") * F.col("w")).alias("d"))
    kernels = tiles.tiles_of(spark, net).where("layer = 0")
    out = tiles.convolve(_cells(spark, sf), kernels, (1, 8, 8), 2, 3, 1, 1, data.count())
    placed = out.select("id", (F.col("c") * 64 + F.col("y") * 8 + F.col("x")).alias("k"), F.col("c").alias("e"), F.col("y").alias("i"), F.col("x").alias("j"), "v")
    return placed.join(back, ["id", "k"]).select("id", "e", "i", "j", (F.col("d") * neural.relu_slope(F.col("v"))).alias("d"))


@query("n8_convolution_backward_by_join", CONV_GRADIENT_SQL)
def _(spark, sf):
    deltas = cut_lineage(_conv_deltas(spark, sf))
    kernel = sliding.convolve_weight_gradient(_cells(spark, sf), deltas, 8, 8, 3, 1, 1)
    weights = kernel.select(F.lit("w").alias("part"), (F.col("e") * 9 + F.col("ky") * 3 + F.col("kx")).alias("pos"), "g")
    bias = deltas.groupBy("e").agg(F.sum("d").alias("g")).select(F.lit("b").alias("part"), F.col("e").alias("pos"), "g")
    return rounded(weights.unionByName(bias), "g", digits=8)


@query(
    "n8_convolution_input_gradient",
    f"""WITH {CONV_DELTA}
SELECT cd.id, i + ky - 1 AS y, j + kx - 1 AS x, round(sum(d * kern.w), 8) + 0.0::DOUBLE AS g FROM cd JOIN kern ON cd.e = kern.e
WHERE i + ky - 1 BETWEEN 0 AND 7 AND j + kx - 1 BETWEEN 0 AND 7 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    kernels = tiles.tiles_of(spark, conv_net()).where("layer = 0")
    made = tiles.convolve_input_gradient(_conv_deltas(spark, sf), kernels, (1, 8, 8), 2, 3, 1, 1, images(spark, sf).count())
    return rounded(made.drop("c"), "g", digits=8)


@query(
    "n9_max_pool_backward",
    """WITH c AS (SELECT vec_id AS id, unnest(range(64)) // 8 AS y, unnest(range(64)) % 8 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings),
w AS (SELECT id, i, j, y, x, v, max(v) OVER (PARTITION BY id, i, j) AS top FROM c, range(4) a(i), range(4) b(j)
      WHERE y // 2 = i AND x // 2 = j)
SELECT id, y, x, CAST(sum(CASE WHEN v = top THEN i + j + 1 ELSE 0 END) AS DOUBLE) AS g FROM w GROUP BY id, y, x""",
)
def _(spark, sf):
    cells = _cells(spark, sf)
    pooled = cut_lineage(sliding.max_pool(cells, 8, 8, 2, 2, 0))
    deltas = pooled.select("id", "c", F.col("y").alias("i"), F.col("x").alias("j"), (F.col("y") + F.col("x") + 1.0).alias("d"))
    return rounded(sliding.max_pool_input_gradient(cells, pooled, deltas, 8, 8, 2, 2, 0).drop("c"), "g")


POOLED_DELTA = f"""{CONV_OUT}, n AS (SELECT count(*) AS n FROM embeddings),
pool AS (SELECT id, label, e, i // 2 AS pi, j // 2 AS pj, e * 16 + (i // 2) * 4 + j // 2 AS k, max(v) AS v FROM conv GROUP BY ALL),
fw AS (SELECT k, q, ((7 * k + 13 * q + 2) % 11 - 5) / 10.0 AS w FROM range(32) a(k), range(10) b(q)),
z AS (SELECT id, label, q, sum(v * w) + any_value(((3 * q + 2) % 5 - 2) / 10.0) AS z FROM pool JOIN fw USING (k) GROUP BY id, label, q),
o AS (SELECT id, label, q, exp(least(z, 400)) / sum(exp(least(z, 400))) OVER (PARTITION BY id) AS y FROM z),
od AS (SELECT id, q, (y - CASE WHEN q = label THEN 1 ELSE 0 END) / n AS d FROM o, n),
pd AS (SELECT id, k, sum(d * w) AS d FROM od JOIN fw USING (q) GROUP BY id, k),
cd AS (SELECT conv.id, conv.e, i, j, CASE WHEN conv.v > 0 AND conv.v = pool.v THEN pd.d ELSE 0 END AS d
       FROM conv JOIN pool ON pool.id = conv.id AND pool.e = conv.e AND i // 2 = pi AND j // 2 = pj JOIN pd ON pd.id = conv.id AND pd.k = pool.k)"""


@query(
    "n9_pooled_network_gradient",
    f"""WITH {POOLED_DELTA}
SELECT 'w' AS part, CAST(e * 9 + ky * 3 + kx AS INTEGER) AS pos, round(sum(v * d), 8) + 0.0::DOUBLE AS g
FROM cell JOIN cd USING (id), range(3) a(ky), range(3) b(kx) WHERE y + 1 - ky = i AND x + 1 - kx = j GROUP BY e, ky, kx
UNION ALL SELECT 'b', CAST(e AS INTEGER), round(sum(d), 8) + 0.0::DOUBLE FROM cd GROUP BY e""",
)
def _(spark, sf):
    """The batch form's way back through a pooling layer."""
    data = images(spark, sf)
    rows = gradients.gradient_rows(data, pooled_net(), data.count()).where("layer = 0")
    return rounded(rows.drop("layer"), "g", digits=8)


@query("x3_added_layer_type", f"""SELECT id, j, round(abs(sum(v * {W0}) + any_value({B0})), 6) AS y FROM ({PIXELS}), range(10) r(j) GROUP BY id, j""")
def _(spark, sf):
    """A layer type that the library does not have, under a name of its own."""
    ACTIVATIONS.setdefault("FC_ABS", Dense(np.abs, np.sign))
    return _outputs(score(images(spark, sf), layer_net({"type": "FC_ABS", "num_channels": CLASSES}, False), "id"), "id")


@query(
    "x4_added_cost",
    f"""WITH z AS (SELECT id, label, j, sum(v * {W0}) + any_value({B0}) AS y FROM ({PIXELS}), range(10) r(j) GROUP BY id, label, j)
SELECT id, round(sum(abs(y - CASE WHEN j = label THEN 1 ELSE 0 END)), 6) AS cost FROM z GROUP BY id""",
)
def _(spark, sf):
    """A cost that the library does not have, under a name of its own."""
    COST_TABLE.setdefault("ABS", lambda y, t: np.abs(y - t).sum(axis=-1))
    net = layer_net(DENSE, False)
    made = score(images(spark, sf), Network.closed_form(replace(net.config, cost="ABS"), weight, bias), "id", target="label", with_y=False)
    return rounded(made.select("id", "cost"), "cost")


def _normal_sql(index: str, seed: int, stream: int) -> str:
    """Normal numbers by counter, written out from the definition."""
    sql = f"SELECT *, ({index}) // 46341 AS l, ({index}) % 46341 AS r FROM places"
    for i in range(1, 6):
        k = f"((69621::BIGINT * {seed} + 39373::BIGINT * {stream} + 26544357::BIGINT * {i}) % 2147483647)"
        key = f"(({k} * {k} + 48271 * {k} + {i - 1}) % 2147483647)"
        t = f"((r * 48271 + {key}) % 2147483647)"
        sql = f"SELECT * EXCLUDE (l, r), r AS l, (l + ({t} * {t}) % 2147483647) % 46341 AS r FROM ({sql})"
    poly = lambda c, x: "(" * (len(c) - 1) + str(c[0]) + "".join(f"::DOUBLE * {x} + ({v})::DOUBLE)" for v in c[1:])
    centre = f"{poly(normal.CENTRE_ABOVE, 'q2')} * q / {poly(normal.CENTRE_BELOW, 'q2')}"
    tail = f"{poly(normal.TAIL_ABOVE, 't')} / {poly(normal.TAIL_BELOW, 't')}"
    return f"""SELECT * EXCLUDE (p, q, q2, t), CASE WHEN p < 0.02425 THEN {tail} WHEN p > 1.0 - 0.02425 THEN -({tail}) ELSE {centre} END AS z
FROM (SELECT *, q * q AS q2, sqrt(-2.0 * ln(least(p, 1.0 - p))) AS t FROM (SELECT *, p - 0.5::DOUBLE AS q FROM (
SELECT * EXCLUDE (l, r), ((l * 46341 + r)::DOUBLE + 0.5::DOUBLE) / 2147488281.0::DOUBLE AS p FROM ({sql}))))"""


@query(
    "n12_initial_weights",
    f"""WITH places AS (SELECT vec_id AS k, j FROM embeddings, range(10) r(j)) SELECT k, j, round(0.3 * z, 6) + 0.0::DOUBLE AS w FROM ({_normal_sql("k * 10 + j", 0, 0)})""",
)
def _(spark, sf):
    """First weights of a dense layer with an input for each vector, as columns."""
    at = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1)).cast("array<bigint>")).alias("j"))
    return rounded(at.withColumn("w", F.lit(0.3) * normal.normal(F.col("k") * CLASSES + F.col("j"), 0, 0)), "w")


# -- training ------------------------------------------------------------------------------------

STEPS, ALPHA, MOMENTUM = 3, 2.0, 0.9
COSTS = ("cost_batch", "correct_batch", "cost_val", "correct_val")


def _training_views(
    run: str, alpha: float, momentum: float, epochs: int, batches: int, restarts: bool = False, shuffled: bool = False
) -> list[str]:
    """Momentum steps over contiguous batches in SQL, a few views per step.

    Views of a run share its prefix; ``{run}w{t}`` are the weights before step t, and
    ``{run}v{e}`` the whole-set metrics after epoch e. ``restarts`` forgets momentum per epoch,
    ``shuffled`` takes the batches of epoch e from column ``batch{e}``.
    """
    views = [
        f"{run}w0 AS MATERIALIZED (SELECT k, j, {W0} AS w, 0.0::DOUBLE AS m FROM range(64) a(k), range(10) b(j))",
        f"{run}b0 AS MATERIALIZED (SELECT j, {B0} AS b, 0.0::DOUBLE AS m FROM range(10) r(j))",
    ]

    def outputs(name: str, t: int, where: str) -> list[str]:
        return [
            f"""{name} AS MATERIALIZED (SELECT id, label, j, exp(least(z, 400)) / sum(exp(least(z, 400))) OVER (PARTITION BY id) AS y FROM (
  SELECT id, label, s.j AS j, s + b AS z FROM (SELECT id, label, j, sum(v * w) AS s FROM px JOIN {run}w{t} USING (k) WHERE {where} GROUP BY id, label, j) s
  JOIN {run}b{t} USING (j)))""",
            f"""{name}m AS MATERIALIZED (SELECT (SELECT avg(-ln(y + 1e-30)) FROM {name} WHERE j = label) AS cost, avg(CAST(j = label AS INTEGER)) AS correct
FROM (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY y DESC, j) = 1))""",
        ]

    for t in range(epochs * batches):
        keep = 0.0 if restarts and t % batches == 0 else momentum
        views += outputs(f"{run}y{t}", t, f"batch{t // batches if shuffled else ''} = {t % batches}")
        views += [
            f"{run}d{t} AS MATERIALIZED (SELECT id, j, (y - CASE WHEN j = label THEN 1 ELSE 0 END) / (SELECT count(DISTINCT id) FROM {run}y{t}) AS d FROM {run}y{t})",
            f"""{run}w{t + 1} AS MATERIALIZED (SELECT k, j, w - {alpha} * ({keep} * m + g) AS w, {keep} * m + g AS m
  FROM (SELECT k, j, sum(v * d) AS g FROM px JOIN {run}d{t} USING (id) GROUP BY k, j) JOIN {run}w{t} USING (k, j))""",
            f"""{run}b{t + 1} AS MATERIALIZED (SELECT j, b - {alpha} * ({keep} * m + g) AS b, {keep} * m + g AS m
  FROM (SELECT j, sum(d) AS g FROM {run}d{t} GROUP BY j) JOIN {run}b{t} USING (j))""",
        ]
        if (t + 1) % batches == 0:
            views += outputs(f"{run}v{t // batches}", t + 1, "true")
    return views


def _batches_sql(batches: int) -> str:
    return f"""WITH ids AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // ((count(*) OVER () + {batches - 1}) // {batches}) AS batch FROM embeddings),
px AS MATERIALIZED (SELECT p.*, batch FROM ({PIXELS}) p JOIN ids ON vec_id = id)"""


def _places_sql(epoch: int, seed: int = 0) -> str:
    """(vec_id, x): the place of each row in an epoch, by Feistel rounds over the digits of its number.

    Written out from the definition: five rounds with squares modulo 2147483647, to the base of the least
    number whose square is not under the number of rows; a result beyond the rows goes round again.
    """

    def rounds(x: str, source: str) -> str:
        sql = f"SELECT vec_id, n, side, {x} // side AS l, {x} % side AS r FROM {source}"
        for i in range(1, 6):
            k = f"((69621::BIGINT * {seed} + 39373::BIGINT * {epoch} + 26544357::BIGINT * {i}) % 2147483647)"
            key = f"(({k} * {k} + 48271 * {k} + {i - 1}) % 2147483647)"
            t = f"((r * 48271 + {key}) % 2147483647)"
            sql = f"SELECT vec_id, n, side, r AS l, (l + ({t} * {t}) % 2147483647) % side AS r FROM ({sql})"
        return f"SELECT vec_id, n, side, l * side + r AS x FROM ({sql})"

    return f"walk{epoch} AS ({rounds('spot', 'numbered')} UNION ALL {rounds('x', f'walk{epoch} WHERE x >= n')})"


def _shuffled_sql(batches: int, epochs: int) -> str:
    """The pixels with a batch number for each epoch."""
    size = f"((n + {batches - 1}) // {batches})"
    joins = " ".join(f"JOIN (SELECT vec_id, x // {size} AS batch{e} FROM walk{e} WHERE x < n) USING (vec_id)" for e in range(epochs))
    return f"""WITH RECURSIVE numbered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS spot, count(*) OVER () AS n,
  CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS side FROM embeddings),
{", ".join(_places_sql(e) for e in range(epochs))},
px AS MATERIALIZED (SELECT p.*, {", ".join(f"batch{e}" for e in range(epochs))} FROM ({PIXELS}) p JOIN (SELECT * FROM numbered {joins}) ON vec_id = id)"""


def _costs_sql(run: str, epochs: int, batches: int, lead: str = "") -> str:
    """The per-epoch cost rows of a run."""
    rows = []
    for e in range(epochs):
        steps = [f"{run}y{t}m" for t in range(e * batches, (e + 1) * batches)]
        mean = lambda c: f"round(({' + '.join(f'(SELECT {c} FROM {s})' for s in steps)}) / {batches}, 6)"
        rows.append(
            f"SELECT {lead}{e + 1} AS epoch_num, {(e + 1) * batches} AS batch_num, {mean('cost')} AS cost_batch, {mean('correct')} AS correct_batch, "
            f"round(cost, 6) AS cost_val, round(correct, 6) AS correct_val FROM {run}v{e}m"
        )
    return " UNION ALL ".join(rows)


def _training_sql(runs: dict[str, tuple], tail: str) -> str:
    """``runs`` maps a prefix to (alpha, momentum, epochs, batches[, restarts[, shuffled]])."""
    first = next(iter(runs.values()))
    views = [v for run, options in runs.items() for v in _training_views(run, *options)]
    head = _shuffled_sql(first[3], first[2]) if len(first) > 5 and first[5] else _batches_sql(first[3])
    return ",\n".join([head, *views]) + "\n" + tail


def _in_order(data: DataFrame, batches: int, shuffle: bool = False, **conf):
    """A network and configuration that take ``data`` in stored order, or shuffled, in so many batches."""
    return flat_net(batch=-(-data.count() // batches), shuffle=shuffle, **conf)


def _trained(spark, sf, batches: int, epochs: int):
    data = images(spark, sf)
    net = _in_order(data, batches, epoch=epochs, alpha=ALPHA, momentum=MOMENTUM)
    return fit(data, data, None, net.config, start=net)


WHOLE = {"r": (ALPHA, MOMENTUM, STEPS, 1)}


@query("n11_fit_whole_set", _training_sql(WHOLE, _costs_sql("r", STEPS, 1)))
def _(spark, sf):
    return rounded(spark.createDataFrame(_trained(spark, sf, 1, STEPS).cost_rows), *COSTS)


@query("n10_sgd_weights", _training_sql(WHOLE, f"SELECT k, j, round(w, 7) + 0.0::DOUBLE AS w FROM rw{STEPS}"))
def _(spark, sf):
    weights, _ = weight_rows(_trained(spark, sf, 1, STEPS).network, 0, spark)
    return rounded(weights, "w", digits=7)


@query("n11_fit_in_order", _training_sql({"r": (ALPHA, MOMENTUM, 2, 4)}, _costs_sql("r", 2, 4)))
def _(spark, sf):
    return rounded(spark.createDataFrame(_trained(spark, sf, 4, 2).cost_rows), *COSTS)


@query("n13_resume", _training_sql({"r": (ALPHA, MOMENTUM, 2, 3, True)}, _costs_sql("r", 2, 3)))
def _(spark, sf):
    """One epoch, save, load, one more: counters go on, momentum starts anew."""
    data, path = images(spark, sf), shared_path(spark, "model")
    net = _in_order(data, 3, epoch=1, alpha=ALPHA, momentum=MOMENTUM)
    first = fit(data, data, None, net.config, start=net, run_id="first")
    save_model(spark, first.network, path, "first")
    second = fit(data, data, None, net.config, start=load_model(spark, path, "first", net.config), run_id="second")
    return rounded(spark.createDataFrame(first.cost_rows + second.cost_rows), *COSTS)


SWEEP = [(0.5, 0.0), (0.5, 0.9), (2.0, 0.0)]


@query(
    "n14_sweep_in_order",
    _training_sql(
        {f"r{i}": (a, m, 1, 2) for i, (a, m) in enumerate(SWEEP)},
        " UNION ALL ".join(_costs_sql(f"r{i}", 1, 2, f"{i} AS config_id, ") for i in range(len(SWEEP))),
    ),
)
def _(spark, sf):
    data = images(spark, sf)
    nets = {i: _in_order(data, 2, epoch=1, alpha=a, momentum=m) for i, (a, m) in enumerate(SWEEP)}
    return rounded(_sweep_rows(spark, data, nets), *COSTS)


def _sweep_rows(spark, data: DataFrame, nets: dict) -> DataFrame:
    runs = fit_many(data, data, None, {i: n.config for i, n in nets.items()}, start=nets)
    return spark.createDataFrame([{"config_id": i, **row} for i, run in runs.items() for row in run.cost_rows])


@query("n11_fit_mini_batches", _training_sql({"r": (0.5, 0.9, 2, 2, False, True)}, _costs_sql("r", 2, 2)))
def _(spark, sf):
    data = images(spark, sf)
    net = _in_order(data, 2, shuffle=True, epoch=2, alpha=0.5, momentum=0.9)
    return rounded(spark.createDataFrame(fit(data, data, None, net.config, start=net).cost_rows), *COSTS)


@query(
    "n14_sweep",
    _training_sql(
        {f"r{i}": (a, m, 2, 2, False, True) for i, (a, m) in enumerate(SWEEP)},
        " UNION ALL ".join(_costs_sql(f"r{i}", 2, 2, f"{i} AS config_id, ") for i in range(len(SWEEP))),
    ),
)
def _(spark, sf):
    data = images(spark, sf)
    nets = {i: _in_order(data, 2, shuffle=True, epoch=2, alpha=a, momentum=m) for i, (a, m) in enumerate(SWEEP)}
    return rounded(_sweep_rows(spark, data, nets), *COSTS)
