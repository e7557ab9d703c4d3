"""Readers, the event log, streaming."""

import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.contract import QUERIES
from runloom.operators import dataset
from runloom.plans.profile_store import ProfileStore
from runloom.sources import event_log, sets
from runloom.streaming.mirror import mirror, mirrored, running_best


def archive(path, rows, shape=(1, 2, 3), seed=0):
    rng = np.random.RandomState(seed)
    data, target = rng.randn(rows, *shape), np.eye(3)[rng.randint(0, 3, rows)]
    np.savez(path, data=data, target=target)
    return data, target


def test_npz_folder(spark, tmp_path):
    kept = {s: archive(tmp_path / f"{s}.npz", n, seed=n) for s, n in (("train", 5), ("valid", 2), ("test", 3))}
    (tmp_path / ".hidden").write_text("x")
    frames, sizes = sets.load_npz(spark, str(tmp_path))
    assert sizes == {"train_size": 5, "valid_size": 2, "test_size": 3}
    rows = frames["train"].orderBy("row").collect()
    np.testing.assert_array_equal([r["data"] for r in rows], kept["train"][0].reshape(5, -1))
    np.testing.assert_array_equal([r["target"] for r in rows], kept["train"][1])
    assert rows[0]["shape"] == [1, 2, 3] and rows[0]["set"] == "train"
    archive(tmp_path / "extra.npz", 1)
    with pytest.raises(ValueError):
        sets.load_npz(spark, str(tmp_path))


def test_npz_rows_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    data, _ = archive(tmp_path / "a.npz", 50)
    monkeypatch.setattr(sets, "ROWS_PER_BATCH_BYTES", 100)
    got = sets.npz_sets(spark, str(tmp_path / "*.npz")).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(50)) and {r["set"] for r in got} == {"a.npz"}
    np.testing.assert_array_equal([r["data"] for r in got], data.reshape(50, -1))


def test_parquet_splits(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "idx")
    for name in ("train", "valid", "test"):
        df.write.parquet(str(tmp_path / name))
    frames, sizes = sets.load_parquet(spark, str(tmp_path))
    assert sizes["valid_size"] == 10 and frames["test"].first()["set"] == "test"


def test_parquet_sets_are_files_or_tables(spark, tmp_path):
    """A folder of parts is one set, even where parts share names; files keep theirs, whatever lies above."""
    base = tmp_path / "old.parquet" / "of sets"
    for name, rows in (("a.parquet", 10), ("b.parquet", 20)):
        spark.range(rows).repartition(3).write.parquet(str(base / name))
        for i, part in enumerate(sorted((base / name).glob("part-*"))):
            part.rename(base / name / f"part-{i}.parquet")
    (base / "files").mkdir()
    for name in ("c.parquet", "d", "e f.parquet"):
        shutil.copy(base / "a.parquet" / "part-0.parquet", base / "files" / name)
    found = lambda path: {r["set"]: r["count"] for r in sets.parquet_sets(spark, str(path)).groupBy("set").count().collect()}
    n = spark.read.parquet(str(base / "files/c.parquet")).count()
    assert found(base / "*.parquet") == found(f"{base}/{{a,b}}.parquet") == {"a.parquet": 10, "b.parquet": 20}
    assert found(base / "a.parquet") == found(f"{base}/a.parquet/") == {"a.parquet": 10}
    files = found(base / "files")
    assert set(files.values()) == {n} and len(files) == 3 and {"c.parquet", "d"} < set(files)
    assert found(base / "files" / "c*") == found(base / "files" / "c.parquet") == {"c.parquet": n}
    assert found(os.path.relpath(base / "?.parquet")) == {"a.parquet": 10, "b.parquet": 20}


def test_input_types():
    assert sets.check_input_type(["a.npz", "b.npz", ".hidden.png"]) == "npz"
    for bad in (["a.npz", "b.png"], ["a.xyz"], []):
        with pytest.raises(ValueError):
            sets.check_input_type(bad)


def test_libsvm(spark, tmp_path):
    (tmp_path / "d.txt").write_text("3 1:0.5 4:2\n1 2:1\n")
    rows = sets.libsvm_to_dataset(spark, str(tmp_path / "d.txt"), 1, 2, 2).collect()
    assert [(r["label"], r["data"]) for r in rows] == [(3.0, [0.5, 0, 0, 2.0]), (1.0, [0, 1.0, 0, 0])]
    with pytest.raises(Exception):
        sets.libsvm_to_dataset(spark, str(tmp_path / "d.txt"), 1, 1, 2).collect()


def test_category_folders(spark, tmp_path):
    for name, label in (("MCF7", 1), ("THP1", 3), ("edu", 2)):
        os.makedirs(tmp_path / name)
        for i in range(3):
            (tmp_path / name / f"{i}.raw").write_bytes(bytes([label, 100 + i] * 6))
    got = sets.category_dir_ingest(spark, str(tmp_path), 2, 2, 3)
    rows = got.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(9))
    assert all(r["data"][:6] == [float(r["label"])] * 6 and r["data"][6] >= 100 for r in rows)
    os.makedirs(tmp_path / "unknown")
    (tmp_path / "unknown" / "0.raw").write_bytes(b"123456123456")
    with pytest.raises(Exception, match="unknown category"):
        sets.category_dir_ingest(spark, str(tmp_path), 2, 2, 3).collect()


def test_images(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"img{i}_channel2_category{i}.raw").write_bytes(bytes([0, 255] + [51 * i] * 6))
    rows = sets.image_ingest(spark, str(tmp_path), 2, 2).orderBy("img").collect()
    assert [(r["img"], r["channel"], r["category"]) for r in rows] == [(0, 2, 0), (1, 2, 1), (2, 2, 2)]
    assert rows[1]["data"][:2] == [-1.0, 1.0] and rows[1]["data"][2] == 51 / 127.5 - 1
    with pytest.raises(Exception, match="expected 24 bytes, found 8"):
        sets.image_ingest(spark, str(tmp_path), 3, 4).collect()
    (tmp_path / "img9_channel1_category0.raw").write_bytes(bytes(8))
    with pytest.raises(ValueError, match="disagree"):
        sets.image_ingest(spark, str(tmp_path), 2, 2)


def test_colour_pictures(spark, tmp_path):
    """A 2 x 1 bitmap: one red pixel, one blue."""
    header = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little")
    info += (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "p.bmp").write_bytes(header + info + bytes([0, 0, 255, 255, 0, 0, 0, 0]))
    row = sets.rgb_images(spark, str(tmp_path), 1, 2).first()
    assert row["name"] == "p.bmp" and row["data"] == [1.0, -1.0, -1.0, -1.0, -1.0, 1.0]


def test_written_parts(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("label"))
    dataset.write_parts(df, str(tmp_path / "a"), "label")
    dataset.write_parts(df, str(tmp_path / "b"), "label", files_per_part=2)
    for name in "ab":
        assert spark.read.parquet(str(tmp_path / name)).count() == 100
    assert max(len([f for f in os.listdir(tmp_path / "b" / f"label={k}") if f.endswith(".parquet")]) for k in range(3)) <= 2


def test_concatenation_checks(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0])], "id long, data array<double>")
    wide = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, data array<double>")
    floats = spark.createDataFrame([(0, [1.0, 2.0])], "id long, data array<float>")
    assert [r["src_no"] for r in dataset.concat_ordered(a, a).orderBy("idx").collect()] == [0, 1]
    for other in (wide, floats):
        with pytest.raises(ValueError):
            dataset.concat_ordered(a, other)
    with pytest.raises(ValueError):
        dataset.concat_shuffle(a, spark.range(1))
    assert sorted(r["idx"] for r in dataset.concat_shuffle(a, wide, a).collect()) == [0, 1, 2]


def test_eight_bit_needs_the_full_range(spark):
    df = spark.createDataFrame([([-1.0, 1.0, 0.1],)], "data array<double>")
    assert dataset.eight_bit(df).first()["data"] == pytest.approx([-1, 1, (140 / 255 - 0.5) * 2])
    with pytest.raises(ValueError):
        dataset.eight_bit(spark.createDataFrame([([0.0, 1.0],)], "data array<double>"))


def task_end(stage, run_ms, launch, finish, read):
    return {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage,
        "Task Info": {"Launch Time": launch, "Finish Time": finish, "Getting Result Time": 0},
        "Task Metrics": {
            "Executor Deserialize Time": 5,
            "Executor Run Time": run_ms,
            "JVM GC Time": 1,
            "Result Serialization Time": 2,
            "Peak Execution Memory": 1000,
            "Input Metrics": {"Bytes Read": read, "Records Read": 10},
            "Shuffle Read Metrics": {"Remote Bytes Read": 7, "Local Bytes Read": 3, "Fetch Wait Time": 4},
        },
    }


@pytest.fixture
def events(spark, tmp_path):
    stage = lambda i: {"Stage ID": i, "Stage Name": f"collect at {i}", "Number of Tasks": 2, "Submission Time": 1000, "Completion Time": 3000}
    lines = [
        {"Event": "SparkListenerApplicationStart", "App Name": "batch_eval-dsize_500-partition_8-itr_1", "App ID": "app-20240101000000-0001", "Timestamp": 1000},
        {"Event": "SparkListenerExecutorAdded", "Timestamp": 1100, "Executor Info": {"Host": "a", "Total Cores": 4}},
        {"Event": "SparkListenerExecutorAdded", "Timestamp": 1100, "Executor Info": {"Host": "b", "Total Cores": 4}},
        {"Event": "SparkListenerExecutorAdded", "Timestamp": 1300, "Executor Info": {"Host": "b", "Total Cores": 4}},
        {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"spark.executor.memory": "4g", "spark.app.name": "x"}},
        {"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 1500, "Stage IDs": [0, 1, 2]},
        task_end(0, 100, 1500, 1620, 11),
        task_end(0, 300, 1500, 1810, 22),
        task_end(1, 50, 1900, 1960, 0),
        task_end(2, 10, 1900, 1920, 0),
        {"Event": "SparkListenerStageCompleted", "Stage Info": stage(0)},
        {"Event": "SparkListenerStageCompleted", "Stage Info": stage(1)},
        {"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": 4000},
        {"Event": "SparkListenerApplicationEnd", "Timestamp": 6000},
        {"Event": "SomethingElse", "Odd": {"nested": 1}},
    ]
    (tmp_path / "app-20240101000000-0001").write_text("\n".join(json.dumps(line) for line in lines))
    return event_log.read_events(spark, str(tmp_path))


def test_event_log(events):
    app = event_log.app_summary(events).first()
    assert tuple(app) == ("app-20240101000000-0001", "batch_eval-dsize_500-partition_8-itr_1", 5.0, 1, 2, 2, 8, 4096)
    job = event_log.job_summary(events).first()
    assert tuple(job)[1:] == (0, 2.5, 2, 3)
    rows = event_log.stage_rows(events, "small", "2024.01.01-00.00.00").orderBy("stage_id").collect()
    assert [(r["stage_id"], r["descp"]) for r in rows] == [(0, "collect at 0"), (1, "collect at 1"), (2, None)]
    first = rows[0].asDict()
    assert first["Duration"] == pytest.approx(0.4) and first["Input_Size"] == 33 and first["Shuffle_Read_Size"] == 20
    assert first["Scheduler_Delay"] == pytest.approx((13 + 3) / 1000)
    assert (first["clt_size"], first["num_cores"], first["app_name"], first["data_size"]) == (2, 8, "batch_eval", 500)
    medians = {(r["stage_id"], r["metric"]): r["median"] for r in event_log.stage_medians(events).collect()}
    assert medians[(0, "Duration")] == pytest.approx(0.2) and medians[(1, "Input_Size")] == 0


def test_mirror_copies_only_what_is_new(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("source", "target", "state"))
    rows = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 2).cast("string").alias("run"), F.col("id").cast("double").alias("metric"))
    rows(0, 10).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    mirror(spark, source, schema, target, state, partition_by="run")
    assert spark.read.parquet(target).count() == 10
    mirror(spark, source, schema, target, state, partition_by="run")
    assert spark.read.parquet(target).count() == 10
    best = running_best(spark, source, schema, str(tmp_path / "best"))
    assert {r["run"]: r["best"] for r in best.collect()} == {"0": 8.0, "1": 9.0}
    rows(10, 12).coalesce(1).write.mode("append").parquet(source)
    mirror(spark, source, schema, target, state, partition_by="run")
    assert spark.read.parquet(target).count() == 12 == mirrored(spark, target).count()
    best = running_best(spark, source, schema, str(tmp_path / "best"))
    assert {r["run"]: r["best"] for r in best.collect()} == {"0": 10.0, "1": 11.0}


def test_streams_read_tables_of_one_file_or_of_many(spark, tmp_path):
    """A table is a folder of parts or a single file; others lie beside it."""
    talks = spark.createDataFrame([(i // 2, "x" * i) for i in range(20)], "conv_id long, text string")
    events = spark.range(20).selectExpr("id AS event_id", "id % 3 AS user_id", "'view' AS event_type", "id / 2 AS value")
    for name, rows in (("conversations", talks), ("events", events)):
        rows.repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    best = {r["run"]: r["best"] for r in QUERIES["s18_running_best"](spark, str(tmp_path)).collect()}
    assert best == {i: 2 * i + 1 for i in range(10)}
    copied = QUERIES["s18_mirror"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in copied) == sorted(tuple(r) for r in events.collect())
    talks.coalesce(1).write.parquet(str(tmp_path / "written"))
    for name in ("one.parquet", "other.parquet"):
        shutil.copy(next((tmp_path / "written").glob("*.parquet")), tmp_path / name)
    mirror(spark, str(tmp_path / "one.parquet"), talks.schema, str(tmp_path / "copy"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in mirrored(spark, str(tmp_path / "copy")).collect()) == sorted(tuple(r) for r in talks.collect())


def test_mirror_shrinks_with_the_table(spark, tmp_path):
    """Dead parts go, thin ones are written anew, and a call that was cut short loses and doubles nothing."""
    source, target, state = (str(tmp_path / n) for n in ("source", "target", "state"))
    for n in range(4):
        spark.range(1000 * n, 1000 * n + 1000).withColumn("k", F.col("id") % 4).write.mode("append").partitionBy("k").parquet(source)
    schema = spark.read.parquet(source).schema
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "target").rglob("*.parquet"))
    rows = lambda: sorted(r["id"] for r in mirrored(spark, target).collect())
    mirror(spark, source, schema, target, state)
    full = size()
    assert rows() == list(range(4000))
    for k in (0, 1, 2):
        shutil.rmtree(tmp_path / f"source/k={k}")
    mirror(spark, source, schema, target, state)
    assert rows() == list(range(3, 4000, 4)) and size() < 0.5 * full
    spark.range(5000, 5010).withColumn("k", F.lit(3).cast("long")).write.mode("append").partitionBy("k").parquet(source)
    (tmp_path / "target/_mirror_part=c9").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "target/_mirror_part=c9"))  # left by a broken call
    mirror(spark, source, schema, target, state)
    assert rows() == [*range(3, 4000, 4), *range(5000, 5010)] and not (tmp_path / "target/_mirror_part=c9").exists()
    assert len(list((tmp_path / "target-manifest").glob("_version=*"))) == 1
    shutil.rmtree(tmp_path / "source/k=3")
    spark.range(2).withColumn("k", F.lit(0).cast("long")).write.mode("append").partitionBy("k").parquet(source)
    mirror(spark, source, schema, target, state)
    assert rows() == [0, 1]


def test_mirror_of_the_profile_store(spark, tmp_path):
    """Runs are partitions of the source and of the copy."""
    store = ProfileStore(spark, str(tmp_path / "store"), "db_mirror")
    row = {"epoch_num": 1, "batch_num": 2, "cost_batch": 0.1, "correct_batch": 0.2, "cost_val": 0.3, "correct_val": 0.4}
    target, state = str(tmp_path / "copy"), str(tmp_path / "state")
    for day in (1, 2):
        store.add_costs(f"2024.01.0{day}-00.00.00", [row])
        schema = store.read("profile_cost_ann").schema
        mirror(spark, f"{store.root}/profile_cost_ann", schema, target, state, partition_by="populate_time")
        copied = spark.read.parquet(target)
        assert copied.count() == day and copied.select("populate_time").distinct().count() == day
    store.delete_where("profile_cost_ann", "populate_time", "2024.01.01-00.00.00")
    store.append("profile_cost_ann", spark.createDataFrame([(1, 2.5)], "a long, b double").selectExpr("a AS epoch_num", "a AS batch_num", "b AS cost_batch", "b AS correct_batch", "b AS cost_val", "b AS correct_val"), run_id="2024.01.03-00.00.00")
    mirror(spark, f"{store.root}/profile_cost_ann", schema, target, state, partition_by="populate_time")
    rows = mirrored(spark, target).select(*schema.names).collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in store.read("profile_cost_ann").collect())
    assert {r["populate_time"] for r in rows} == {"2024.01.02-00.00.00", "2024.01.03-00.00.00"}


def test_runs_of_other_writers_can_be_deleted(spark, tmp_path):
    """Their stamps may be escaped in folder names; our own are checked before they are written."""
    store = ProfileStore(spark, str(tmp_path / "store"), "db_stamps")
    rows = spark.createDataFrame([(1, "a:b"), (2, "it's"), (3, "plain")], "x long, populate_time string")
    with pytest.raises(Exception, match="cannot name a folder"):
        store.append_runs("t", rows)
    rows.write.partitionBy("populate_time").mode("overwrite").parquet(f"{store.root}/other")
    assert store.open_stored("other")
    assert store.delete_last_runs("other", num_run=2) == ["it's", "plain"]
    assert [r["x"] for r in store.read("other").collect()] == [1]
    assert store.delete_last_runs("other") == ["a:b"] and store.count_rows("other") == 0
