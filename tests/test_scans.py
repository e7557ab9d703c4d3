"""Ordered scans against pandas, with hot keys, ties, empty and tiny inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom.operators import dataset, skew, stages
from runloom.operators.reports import best_checkpoint
from runloom.operators.scans import row_index, running


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, half of them one group."""
    n = 6000
    df = pd.DataFrame({"id": range(n)})
    df["p"] = [0.5 if i % 3 == 0 else (i * 7919 % 1000) / 1000 for i in range(n)]
    df["g"] = [7 if i % 2 == 0 else i % 50 for i in range(n)]
    return spark.createDataFrame(df).repartition(5), df


@pytest.mark.parametrize("blocks", [2, 16, 200])
@pytest.mark.parametrize("sampled", [1, 64])
def test_row_index_with_ties(skewed, monkeypatch, blocks, sampled):
    """Exact with good bounds and with those of a handful of sampled rows."""
    monkeypatch.setattr(skew, "SAMPLED", sampled)
    frame, df = skewed
    got = row_index(frame, ["p", "id"], blocks=blocks).toPandas().sort_values("idx")
    assert got.idx.tolist() == list(range(len(df)))
    assert got.id.tolist() == df.sort_values(["p", "id"]).id.tolist()


def test_row_index_in_groups(skewed):
    frame, df = skewed
    got = row_index(frame, ["p", "id"], groups=["g"], start=1).toPandas().sort_values("idx")
    assert got.id.tolist() == df.sort_values(["g", "p", "id"]).id.tolist()
    assert got.idx.iloc[0] == 1


def test_hot_value_is_cut_into_blocks(skewed):
    """No block of the scan holds the whole third that shares one value."""
    from runloom.operators.scans import with_blocks

    frame, df = skewed
    sizes = with_blocks(frame, [F.col("p"), F.col("id")], 32).groupBy("_scan_b1", "_scan_b2").count().toPandas()
    assert sizes["count"].max() < len(df) / 8


def test_row_index_edges(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert row_index(empty, ["id"]).count() == 0
    one = spark.createDataFrame([(5, None)], "id long, v double")
    assert row_index(one, ["v", "id"]).first()["idx"] == 0
    nulls = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 1.0)], "id long, v double")
    assert [r["id"] for r in row_index(nulls, ["v", "id"]).orderBy("idx").collect()] == [2, 4, 1, 3]


@pytest.mark.parametrize("partitions", [1, 8])
def test_partition_count_does_not_matter(skewed, partitions):
    frame, df = skewed
    got = dataset.shuffle(frame.select("id").repartition(partitions), seed=3, epoch=2).toPandas()
    assert sorted(got.idx) == list(range(len(df)))
    first = got.sort_values("idx").id.head(5).tolist()
    again = dataset.shuffle(frame.select("id").coalesce(1), seed=3, epoch=2).orderBy("idx").limit(5)
    assert [r["id"] for r in again.collect()] == first
    other = dataset.shuffle(frame.select("id"), seed=3, epoch=3).orderBy("idx").limit(5)
    assert [r["id"] for r in other.collect()] != first


def test_hot_keys(skewed):
    frame, _ = skewed
    hot = skew.hot_keys(frame, ["g"], 16)
    assert [r["g"] for r in frame.where(skew.is_hot(["g"], hot)).select("g").distinct().collect()] == [7]
    assert 2000 <= list(hot.counts.values())[0] <= 4000
    assert skew.hot_keys(frame.limit(0), ["g"], 16).counts == {}
    assert skew.hot_keys(frame.select("id"), ["id"], 16).counts == {}


@pytest.mark.parametrize("share", [1, 16, 64])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_in_hot_groups(skewed, share, inclusive):
    frame, df = skewed
    outputs = {"m": ("max", F.col("p")), "lo": ("min", F.col("p")), "n": ("sum", F.lit(1))}
    got = running(frame, ["g"], ["id"], outputs, inclusive, share=share).toPandas().sort_values("id")
    by = df.groupby("g").p
    want = pd.DataFrame({"m": by.cummax(), "lo": by.cummin(), "n": df.groupby("g").cumcount() + 1.0})
    if not inclusive:
        want = want.groupby(df.g).shift(1)
    pd.testing.assert_frame_equal(got[["m", "lo", "n"]].astype(float).reset_index(drop=True), want, check_names=False)


def test_checkpoints_are_strict_improvements(spark):
    rows = [("a", 1, 0.0), ("a", 2, 0.4), ("a", 3, 0.4), ("a", 4, 0.5), ("b", 1, 0.2)]
    df = spark.createDataFrame(rows, "run string, epoch long, acc double")
    got = {(r["run"], r["epoch"]): r["is_checkpoint"] for r in best_checkpoint(df, "run", "epoch", "acc").collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 4): True, ("b", 1): True}


def test_exact_median_of_a_hot_stage(skewed):
    frame, df = skewed
    got = stages.exact_median(frame, ["g"], "p", share=16).toPandas().set_index("g")["median"].sort_index()
    pd.testing.assert_series_equal(got, df.groupby("g").p.median(), check_names=False)


def test_order_by_time_and_by_three_columns(spark):
    rows = [(f"2024-01-0{1 + i % 3}", i % 2, i) for i in range(60)]
    df = spark.createDataFrame(rows, "d string, flag int, id long").select(F.col("d").cast("timestamp_ntz").alias("t"), "flag", "id")
    got = row_index(df, ["t", "flag", "id"], blocks=20).orderBy("idx").collect()
    assert [r["id"] for r in got] == [r[2] for r in sorted(rows)]
    with pytest.raises(ValueError):
        row_index(df.withColumn("s", F.lit("x")), ["s", "id"])


def test_constant_sort_key_keeps_every_row(spark):
    """All rows tie: the order falls to the ids, then the source."""
    a, b = spark.range(500), spark.range(250, 750)
    got = dataset.concat_shuffle(a, b, sort_key=F.lit(1)).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["id"] for r in got] == sorted([*range(500), *range(250, 750)])


def test_zoneless_times_order_alike_in_every_zone(spark):
    """Over the change to daylight saving of the session's zone, a minute apart."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = F.lit("2024-03-10 00:00:30.25").cast("timestamp_ntz")
        df = spark.range(240).select("id", (start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("t"))
        assert all(r["idx"] == r["id"] for r in row_index(df, ["t"], blocks=32).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
