"""Profile operators and the store."""

import os

import pytest
from pyspark.sql import functions as F

from runloom.operators import control, records
from runloom.operators.sets import same_rows
from runloom.plans.network import NetConfig
from runloom.plans.profile_store import ProfileStore


@pytest.fixture
def demo(spark):
    rows = spark.createDataFrame([("zero", 0.0), ("two", 0.2), ("one", 0.1)], "`is` string, cool double")
    return records.profile_rows(rows, {"this": 0}, "2024.01.01-00.00.00")


def test_constants_repeat(demo):
    assert demo.columns == ["populate_time", "this", "is", "cool"]
    assert [r["this"] for r in demo.collect()] == [0, 0, 0]


def test_delete(demo):
    once = records.delete_where(demo, "is", "zero")
    assert once.count() == 2
    assert records.delete_where(once, ["is"], ["zero"]).count() == 2
    with pytest.raises(ValueError):
        records.delete_where(once, "shhhh", 1)


def test_delete_keeps_nulls_and_escapes(spark):
    df = spark.createDataFrame([(None,), ("it's",), ("b",)], "a string")
    assert records.delete_where(df, "a", "it's").count() == 2
    assert records.delete_where(df, "a", None).count() == 2


def test_last_runs_clamps(spark):
    a = spark.createDataFrame([("2024.01.01-00.00.00", 1), ("2024.01.02-00.00.00", 2)], "populate_time string, v int")
    b = spark.createDataFrame([("2024.01.03-00.00.00", 3)], "populate_time string, v int")
    plain = spark.range(2)
    left = records.without_last_runs({"a": a, "b": b, "plain": plain}, 2)
    assert [left[k].count() for k in ("a", "b", "plain")] == [1, 0, 2]
    assert records.without_last_runs({"a": a}, 9)["a"].count() == 0


def test_normalize_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 2.0), ("b", None), (None, 4.0), (None, 1.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["v_norm"] for r in records.normalize_col(df, "v", "k").collect()}
    assert got == {("a", 0.0): None, ("b", 2.0): 1.0, ("b", None): None, (None, 4.0): 1.0, (None, 1.0): 0.25}


def test_existing_columns_are_not_replaced(demo):
    with pytest.raises(ValueError):
        records.add_col(demo, "cool", "double", lambda a: a, "this")
    with pytest.raises(ValueError):
        records.normalize_col(demo.withColumn("cool_norm", F.lit(1.0)), "cool", "is")


def test_normalize_needs_no_window(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
    plan = records.normalize_col(df, "v", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_export_order(spark):
    df = spark.createDataFrame([("b", 1, 3), ("a", 2, 2), ("b", 1, 1), ("c", None, 9)], "x string, y int, t int")
    assert [r["line"] for r in records.export_lines(df, "t", "x", "y").collect()] == ["b, 1", "a, 2", "c, None"]


def test_control_groups(spark):
    meta = spark.createDataFrame(
        [("r1", 0.1, 10, None), ("r2", 0.2, 10, None), ("r3", 0.1, 20, "x")],
        "populate_time string, learn_rate double, batch_size int, note string",
    )
    data = spark.createDataFrame([("r1", 1, 0.5), ("r1", 2, 0.6), ("r2", 1, 0.7)], "populate_time string, epoch int, cost double")
    joined = control.control_dim(meta, data, "learn_rate")
    assert joined.columns == ["control_key", "learn_rate", "populate_time", "epoch", "cost"]
    assert {r["control_key"] for r in joined.collect()} == {"batch_size=10,note=NULL"}
    listed = {r["control_key"]: (r["num_runs"], r["num_rows"]) for r in control.control_catalogue(meta, data, "learn_rate").collect()}
    assert listed == {"batch_size=10,note=NULL": (2, 3), "batch_size=20,note=x": (1, 0)}


def test_unknown_category_fails(spark):
    df = spark.createDataFrame([("MCF7",), ("nope",)], "c string")
    lookup = spark.createDataFrame([("MCF7", 1)], "name string, label int")
    with pytest.raises(Exception, match="unknown category: nope"):
        control.category_lookup(df, "c", lookup, "name", "label").collect()


def test_same_rows(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    assert same_rows(a, a.orderBy(F.desc("i")))
    assert not same_rows(a, a.union(a))
    assert not same_rows(a, a.limit(1))


def cost_row(epoch, correct=0.4):
    return {"epoch_num": epoch, "batch_num": 2, "cost_batch": 0.1, "correct_batch": 0.2, "cost_val": 0.3, "correct_val": correct}


@pytest.fixture
def store(spark, tmp_path):
    name = f"db_{os.path.basename(tmp_path).replace('-', '_')}"
    return ProfileStore(spark, str(tmp_path), name)


def test_store_round_trip(spark, store):
    conf = NetConfig.from_dict(
        {"obj_name": "demo", "network": [{"type": "FC_SOFTMAX", "num_channels": 3}], "input_num_channels": 4, "batch": 5, "alpha": 0.1}
    )
    for day in (1, 2):
        store.add_run(conf, f"2024.01.0{day}-00.00.00", 30, 10)
        store.add_costs(f"2024.01.0{day}-00.00.00", [cost_row(i, i / 10) for i in range(3)])
    assert store.list_tables("meta") == ["meta_ann"] and store.list_tables("ann") == []
    assert store.table_exists("profile_cost_ann") and not store.table_exists("nothing")
    meta = store.read("meta_ann").orderBy("populate_time").first()
    assert tuple(meta) == ("2024.01.01-00.00.00", "4FC_LIN-3FC_SOFTMAX", "CE", "demo", 30, 10, 5, 0.1, 0.9)
    assert store.count_rows("profile_cost_ann") == 6
    assert store.table_schema("meta_ann")["train_size"] == "bigint"

    assert store.delete_where("profile_cost_ann", ["epoch_num", "populate_time"], [1, "2024.01.01-00.00.00"]) == 1
    assert store.delete_where("profile_cost_ann", "populate_time", "2024.01.01-00.00.00") == 2
    with pytest.raises(ValueError):
        store.delete_where("profile_cost_ann", "shhhh", 1)
    assert store.count_rows("profile_cost_ann") == 3

    store.add_col("profile_cost_ann", "both", "double", lambda a, b: a + b, "cost_val", "correct_val")
    store.normalize_col("profile_cost_ann", "correct_val", "batch_num")
    norm = [r["correct_val_norm"] for r in store.read("profile_cost_ann").orderBy("epoch_num").collect()]
    assert norm == [0.0, 0.5, 1.0]
    store.drop_col("profile_cost_ann", "both", "unknown")
    assert "both" not in store.read("profile_cost_ann").columns

    assert store.delete_last_runs("meta_ann") == ["2024.01.02-00.00.00"]
    assert store.count_rows("meta_ann") == 1 and store.count_rows("profile_cost_ann") == 3
    assert store.delete_last_runs(num_run=5) == ["2024.01.01-00.00.00", "2024.01.02-00.00.00"]
    assert store.count_rows("meta_ann") == store.count_rows("profile_cost_ann") == 0


def test_store_refuses_other_schema(spark, store):
    store.append("t", spark.createDataFrame([(1, 2.0)], "a long, b double"), run_id="r1")
    with pytest.raises(ValueError):
        store.append("t", spark.createDataFrame([(1, "x")], "a long, b string"), run_id="r2")
    with pytest.raises(ValueError):
        store.append("t", spark.createDataFrame([(1, 2.0)], "a long, b double"), run_id="a/b")
    assert store.count_rows("t") == 1


def test_store_reopens(spark, store):
    store.add_costs("2024.01.01-00.00.00", [cost_row(1)])
    again = ProfileStore(spark, store.root, store.database + "_again")
    again.open("profile_cost_ann", store.read("profile_cost_ann").drop("populate_time").schema)
    assert again.count_rows("profile_cost_ann") == 1
    third = ProfileStore(spark, store.root, store.database + "_third")
    assert third.open_stored("profile_cost_ann") and not third.open_stored("nothing")
    assert third.read("profile_cost_ann").collect() == store.read("profile_cost_ann").collect()


def test_inputs_and_outputs_join(spark, store):
    data = spark.createDataFrame([(3, [1.0, 2.0]), (9, [3.0, 4.0])], "id long, data array<double>")
    store.add_inputs(data, "r1", 2)
    store.add_outputs(data.withColumnRenamed("data", "y"), "r1", 1, 5, 2)
    joined = control.join_input_output(store.read("output_data_ann"), store.read("input_data_ann"))
    assert joined.columns == ["x0", "x1", "populate_time", "idx", "epoch", "batch", "y0", "y1"]
    assert sorted(tuple(r) for r in joined.collect()) == [(1.0, 2.0, "r1", 1, 1, 5, 1.0, 2.0), (3.0, 4.0, "r1", 2, 1, 5, 3.0, 4.0)]
