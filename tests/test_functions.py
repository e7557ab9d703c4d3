"""Golden values of column expressions, and their edges."""

import math

import pytest
from pyspark.sql import functions as F

from runloom.functions import arrays, neural, targets, text
from runloom.operators.configs import validate_configs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doubles(*vs):
    return F.array(*[F.lit(float(v)) for v in vs])


@pytest.mark.parametrize(
    "shown, number",
    [("3 ms", 0.003), ("2 min", 120.0), ("1.5 h", 5400.0), ("4 s", 4.0), ("2.5 KB", 2500.0), ("3 MB", 3e6), ("2.5 KB / 10", 2.5), ("1 GB", 1e9), ("7 mb", 0.007), ("", None)],
)
def test_units(spark, shown, number):
    got = value(spark, text.magnitude(F.lit(shown)))
    assert got == (number if number is None else pytest.approx(number))


def test_time_text_leaves_other_units(spark):
    assert value(spark, text.time_text(F.lit("2.5 KB"))) == "2.5 KB"
    assert value(spark, text.time_text(F.lit("2 min"))) == "120.0"
    assert value(spark, text.time_text(F.lit(""))) is None


def test_names(spark):
    row = spark.range(1).select(*text.image_name_parts(F.lit("img10_channel4_category9.png"))).first()
    assert tuple(row) == (10, 4, 9)
    row = spark.range(1).select(*text.app_name_parts(F.lit("batch_eval-dsize_500-partition_8-itr_1"))).first()
    assert tuple(row) == ("batch_eval", 500, 8, 1)
    assert value(spark, text.parent_dir(F.lit("a/b/c.png"))) == "a/b"
    assert value(spark, text.parent_dir(F.lit("c.png"))) == "."


def test_structure_strings(spark):
    parsed = value(spark, text.parse_structure(F.lit("15sig-1lin")))
    assert [tuple(p) for p in parsed] == [(15, "sig"), (1, "lin")]
    stamp = "2024.03.05-06.07.08"
    assert value(spark, text.run_stamp(text.stamp_time(F.lit(stamp)))) == stamp


def test_costs(spark):
    y, t = doubles(176, 242), doubles(5, 4)
    assert value(spark, neural.squared_cost(y, t)) == 42942.5
    assert value(spark, neural.squared_cost(doubles(332, 415), doubles(2, 5))) == 138500.0
    assert value(spark, neural.cost_slope(y, t, 2)) == [85.5, 119.0]
    assert value(spark, neural.cross_entropy(doubles(0, 1), doubles(1, 0))) == pytest.approx(-math.log(1e-30))


def test_clamps(spark):
    assert value(spark, neural.sigmoid(F.lit(-1e6))) == pytest.approx(1 / (1 + math.exp(400)))
    assert value(spark, neural.softmax(doubles(1e6, 1e6))) == [0.5, 0.5]
    assert value(spark, neural.softmax(doubles(-1e6, -1e6))) == [None, None]


def test_constant_images(spark):
    flat = doubles(2, 2, 2)
    assert value(spark, arrays.to_pixels(flat)) == [0, 0, 0]
    assert value(spark, arrays.to_unit_range(flat)) == [None, None, None]


def test_argmax_takes_the_first(spark):
    assert value(spark, arrays.argmax(doubles(1, 3, 3))) == 1


def test_channels_first(spark):
    # 2 channels, 1 x 3 pixels: (a0 b0 a1 b1 a2 b2) -> (a0 a1 a2 b0 b1 b2)
    assert value(spark, arrays.channels_first(doubles(0, 10, 1, 11, 2, 12), 2, 1, 3)) == [0, 1, 2, 10, 11, 12]


def test_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    assert targets.with_target(df, "lin", ["a", "b", "c"]).first()["y0"] == 4 * (2 + 6)
    assert targets.with_target(df, "lin", ["b"]).first()["xLin"] == 2.0
    row = targets.with_target(df, "random", ["a"], 2.0, 3.0).first()
    assert 2.0 <= row["y0"] <= 3.0
    with pytest.raises(ValueError):
        targets.with_target(df, "sin", ["a"], outputs=2)


def conf_row(size, *layers):
    return (size, size, [dict(zip(("type", "kernel_size", "stride", "padding"), l)) for l in layers])


def test_layer_sizes(spark):
    c, p = "CONVOLUTION", "MAXPOOL"
    schema = "input_image_size_y int, input_image_size_x int, network array<struct<type string, kernel_size int, stride int, padding int>>"
    rows = [
        conf_row(511, (c, 16, 5, 0)),
        conf_row(511, (c, 16, 5, 0), (p, 2, 2, 0), (c, 6, 2, 3), (p, 2, 2, 0), (c, 4, 1, 0), (p, 2, 2, 0), ("FC_SIG", 0, 0, 0)),
        conf_row(511, (c, 16, 4, 0)),
        conf_row(305, (c, 9, 3, 1)),
    ]
    got = validate_configs(spark.createDataFrame(rows, schema)).select("out_y", "out_x", "valid").collect()
    assert [tuple(r) for r in got] == [(100, 100, True), (5, 5, True), (None, None, False), (None, None, False)]


def test_own_width(spark):
    schema = "input_image_size_y int, input_image_size_x int, network array<struct<type string, kernel_size int, stride int, padding int>>"
    df = spark.createDataFrame([(8, 6, [("MAXPOOL", 2, 2, 0)])], schema)
    assert tuple(validate_configs(df).select("out_y", "out_x").first()) == (4, 3)
