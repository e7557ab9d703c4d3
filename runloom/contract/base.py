"""The registry, table access, and the networks and SQL pieces several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.plans.network import NetConfig, Network

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLASSES = 10


def query(name: str, oracle: str | None = None):
    """Register a query, and the SQL it must agree with when there is one."""

    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a dataset of 1 x 8 x 8 images with ten classes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("data"), "label")


def double_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).withColumn("data", F.col("data").cast("array<double>"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Networks with weights stated by formulas, so that SQL can state them too.
def weight(layer, *index):
    """((7a + 13b + c' + layer) mod 11 - 5) / 10, c' mixing in the kernel cell."""
    first, second, *cell = index
    mixed = 7 * first + 13 * second + layer
    if cell:
        mixed = mixed + 3 * cell[0] + 5 * cell[1]
    return (mixed % 11 - 5) / 10.0


def bias(layer, j):
    return ((3 * j + layer) % 5 - 2) / 10.0


def _net(cost: str, image: bool, *layers: dict, **conf) -> Network:
    size = {"input_num_channels": 1, "input_image_size_y": 8, "input_image_size_x": 8} if image else {"input_num_channels": 64}
    raw = {"obj_name": "closed_form", "network": list(layers), "cost": cost, **size, **conf}
    return Network.closed_form(NetConfig.from_dict(raw), weight, bias)


SOFTMAX = {"type": "FC_SOFTMAX", "num_channels": CLASSES, "name": "output"}
CONV = {"type": "CONVOLUTION", "num_channels": 2, "kernel_size": 3, "stride": 1, "padding": 1, "name": "conv"}
POOL = {"type": "MAXPOOL", "num_channels": 2, "kernel_size": 2, "stride": 2, "padding": 0, "name": "pool"}


def flat_net(**conf) -> Network:
    """64 -> 10 softmax with cross-entropy."""
    return _net("CE", False, SOFTMAX, **conf)


def conv_net() -> Network:
    """conv 3x3 -> 10 softmax."""
    return _net("CE", True, CONV, SOFTMAX)


def pooled_net() -> Network:
    """conv 3x3 -> pool 2x2 -> 10 softmax."""
    return _net("CE", True, CONV, POOL, SOFTMAX)


def layer_net(layer: dict, image: bool) -> Network:
    return _net("SQR", image, layer)


# SQL pieces: inputs, and the flat network's probabilities and scored rows.
PIXELS = "SELECT vec_id AS id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings"
CELLS = "SELECT vec_id AS id, label, unnest(range(64)) // 8 AS y, unnest(range(64)) % 8 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings"
W0 = "((7 * k + 13 * j) % 11 - 5) / 10.0"
B0 = "((3 * j) % 5 - 2) / 10.0"
FLAT = f"""
px AS ({PIXELS}),
z AS (SELECT id, label, j, sum(v * {W0}) + any_value({B0}) AS z FROM px, range(10) r(j) GROUP BY id, label, j),
p AS (SELECT id, label, j, exp(least(z, 400.0)) / sum(exp(least(z, 400.0))) OVER (PARTITION BY id) AS y FROM z)"""
SCORED = f"""{FLAT},
best AS (SELECT id, j AS predicted, y AS top FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY y DESC, j) = 1),
scored AS (
  SELECT p.id, p.label, best.predicted, best.top, -ln(p.y + 1e-30) AS cost,
         CAST(p.label = best.predicted AS INTEGER) AS correct
  FROM p JOIN best ON p.id = best.id WHERE p.j = p.label)"""
CONV_OUT = f"""
cell AS ({CELLS}),
kern AS (SELECT e, ky, kx, ((13 * e + 3 * ky + 5 * kx) % 11 - 5) / 10.0 AS w
         FROM range(2) a(e), range(3) b(ky), range(3) c(kx)),
conv AS (
  SELECT id, label, e, y + 1 - ky AS i, x + 1 - kx AS j,
         greatest(sum(v * w) + any_value(((3 * e) % 5 - 2) / 10.0), 0.0) AS v
  FROM cell, kern
  WHERE y + 1 - ky BETWEEN 0 AND 7 AND x + 1 - kx BETWEEN 0 AND 7
  GROUP BY id, label, e, i, j)"""
