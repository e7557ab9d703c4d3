"""A third of all rows under one key: results stay whole and the hot key is split."""

import re

import pytest
from pyspark.sql import functions as F

from runloom.operators import control, records, sets, skew

ROWS = 30000


@pytest.fixture
def no_size_limits(spark):
    """Make joins shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None).cast("string"))
    key = key.otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
    rows = spark.range(ROWS).select(key.alias("populate_time"), F.col("id").alias("epoch"), (F.col("id") % 97 + 1.0).alias("cost"))
    return rows.repartition(8)


def largest_part(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(spark, no_size_limits, skewed, how, null_safe):
    right = spark.createDataFrame([("hot", 1), (None, 2), ("k2", 3), ("absent", 4)], "populate_time string, v int")
    got = skew.salted_join(skewed, right, ["populate_time"], how, null_safe)
    plain = skew.salted_join(skewed, right, ["populate_time"], how, null_safe, split=False)
    assert got.columns == plain.columns
    assert sets.same_rows(got, plain)
    assert got.count() == plain.count()


def test_hot_key_is_spread(spark, no_size_limits, skewed):
    right = skewed.select("populate_time").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = skew.salted_join(skewed, right, ["populate_time"], "left", True, split=False)
        salted = skew.salted_join(skewed, right, ["populate_time"], "left", True)
        assert largest_part(plain) >= ROWS / 3
        assert largest_part(salted) < ROWS / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_one_row_are_spread(spark, no_size_limits):
    same = spark.range(8000, numPartitions=8).select(F.lit("hot").alias("k"), F.lit(1.0).alias("v"))
    right = spark.createDataFrame([("hot", 5)], "k string, w int")
    got = skew.salted_join(same, right, ["k"])
    assert got.count() == 8000 and got.select("w").distinct().count() == 1


def test_key_types_may_differ(spark, no_size_limits):
    left = spark.range(1000).select((F.col("id") % 2).cast("long").alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k int, w string")
    assert skew.salted_join(left, right, ["k"]).groupBy("w").count().orderBy("w").collect() == [("a", 500), ("b", 500)]


def test_normalize(spark, no_size_limits, skewed):
    out = records.normalize_col(skewed, "cost", "populate_time")
    assert out.count() == ROWS
    top = out.groupBy("populate_time").agg(F.max("cost_norm").alias("m"), F.count(F.lit(1)).alias("n"))
    assert top.where("m <> 1.0").count() == 0 and top.where("populate_time IS NULL").first()["n"] == ROWS / 3


def test_controlled_join(spark, no_size_limits, skewed):
    meta = skewed.select("populate_time").distinct().select("*", F.lit(0.1).alias("learn_rate"), F.lit(10).alias("batch_size"))
    out = control.control_dim(meta, skewed, "learn_rate")
    assert out.count() == ROWS * 2 // 3 and out.columns[:2] == ["control_key", "learn_rate"]


def test_matching_with_a_hot_key(spark, no_size_limits, skewed):
    keys = skewed.select("populate_time")
    assert sets.keep_matching(skewed, keys, ["populate_time"]).count() == ROWS * 2 // 3
    assert sets.drop_matching(skewed, keys.where("populate_time <> 'hot'"), ["populate_time"]).count() == ROWS * 2 // 3


def test_no_operator_numbers_rows_in_one_task(spark, skewed):
    """The only unpartitioned window runs over the block table."""
    from runloom.operators.scans import row_index

    plan = row_index(skewed, ["epoch"])._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert len(row_windows) == 1 and re.search(r"\], \[_scan_b1", row_windows[0])


def test_salts_do_not_overflow(spark, no_size_limits, monkeypatch):
    """A row's hash may be the largest integer."""
    monkeypatch.setattr(skew.F, "xxhash64", lambda *c: F.lit(2**63 - 1))
    left = spark.range(100, numPartitions=8).select(F.lit(1).alias("k"))
    assert skew.salted_join(left, spark.createDataFrame([(1, 2)], "k int, v int"), ["k"]).count() == 100


def test_hot_queries_split_at_every_size(spark, sf_dir):
    """The plans of the hot-key queries hold salts or blocks on the smallest tables too."""
    from runloom.contract import QUERIES

    for name, sign in {"j1_control_hot": "_salt", "j7_matching_hot": "_salt", "w2_best_hot": "_scan_b1"}.items():
        assert sign in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name
