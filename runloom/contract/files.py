"""File sources and the profile store, on files and tables derived from the given tables."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runloom.contract.base import double_images, images, query, rounded, table
from runloom.functions import arrays, text
from runloom.operators import dataset, stages
from runloom.operators.records import RUN_KEY
from runloom.plans.profile_store import META, ProfileStore
from runloom.plans.score import as_matrix
from runloom.session import shared_path
from runloom.sources import event_log, sets

# -- dataset files -----------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch as one archive."""
    for batch in batches:
        x = as_matrix(batch.column("data"))
        buffer = io.BytesIO()
        np.savez(buffer, data=x.reshape(-1, 1, 8, 8), target=np.eye(10)[batch.column("label").to_numpy()])
        name = f"sets/{batch.column('id')[0].as_py()}.npz"
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([buffer.getvalue()])], names=["path", "content"])


LABEL_SUMS = """SELECT label, count(*) AS num_rows, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY label"""


def _label_sums(df: DataFrame, label) -> DataFrame:
    sums = df.groupBy(label.cast("int").alias("label"))
    return rounded(sums.agg(F.count(F.lit(1)).alias("num_rows"), F.sum(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).alias("total")), "total", digits=4)


@query("s1_npz_sets", LABEL_SUMS)
def _(spark, sf):
    archives = images(spark, sf).mapInArrow(_encode, "path string, content binary")
    return _label_sums(sets.archive_rows(archives), arrays.argmax(F.col("target")))


@query("s2_parquet_splits", LABEL_SUMS)
def _(spark, sf):
    """Write the three splits, then scan them out of core."""
    path, third = shared_path(spark, "splits"), F.pmod("id", F.lit(3))
    for i, name in enumerate(dataset.SPLITS):
        double_images(spark, sf).where(third == i).write.parquet(f"{path}/{name}")
    frames, _sizes = sets.load_parquet(spark, path)
    return _label_sums(frames["train"].unionByName(frames["valid"]).unionByName(frames["test"]), F.col("label"))


@query("s4_libsvm", LABEL_SUMS)
def _(spark, sf):
    path = shared_path(spark, "libsvm")
    pairs = F.transform("data", lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string")))
    lines = double_images(spark, sf).select(F.concat_ws(" ", F.col("label").cast("string"), F.concat_ws(" ", pairs)))
    lines.write.text(path)
    return _label_sums(sets.libsvm_to_dataset(spark, path, 1, 8, 8), F.col("label"))


def _raw_files(spark, sf, path) -> DataFrame:
    """Every image as raw bytes, under the given path expression."""
    pixels = arrays.to_pixels(F.col("data"))
    code = F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    return double_images(spark, sf).select(path.alias("path"), F.unhex(code).alias("content"))


BYTES = """px AS (SELECT vec_id AS id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
raw AS (SELECT id, label, k, floor(255.0::DOUBLE / nullif(max(v) OVER w - min(v) OVER w, 0) * (v - min(v) OVER w)) AS v
        FROM px WINDOW w AS (PARTITION BY id))"""


@query(
    "s5_category_folders",
    f"""WITH {BYTES} SELECT label % 4 AS label, count(DISTINCT id) AS num_rows, sum(v) AS total,
sum(CASE WHEN k % 4 = 3 THEN v ELSE 0 END) AS last_channel FROM raw GROUP BY label % 4""",
)
def _(spark, sf):
    """Interleaved 4 x 4 images of 4 channels below class folders."""
    names = F.array(*[F.lit(n) for n in ("Debris", "MCF7", "PBMC", "THP1")])
    folder = F.get(names, F.pmod("label", F.lit(4)))
    files = _raw_files(spark, sf, F.concat(F.lit("cell/"), folder, F.lit("/"), F.col("id").cast("string"), F.lit(".raw")))
    rows = sets.category_images(sets.with_category(files), 4, 4, 4)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("num_rows"), F.sum(total(F.col("data"))).alias("total"), F.sum(total(F.slice("data", 49, 16))).alias("last_channel")
    )


@query(
    "s6_image_files",
    f"""WITH {BYTES} SELECT CAST(id AS INTEGER) AS img, 1 AS channel, label AS category, CAST(k AS INTEGER) AS k, round(v / 127.5 - 1, 6) AS v FROM raw""",
)
def _(spark, sf):
    name = F.format_string("pics/img%d_channel1_category%d.raw", F.col("id"), F.col("label"))
    made = sets.named_images(_raw_files(spark, sf, name), 8, 8)
    return rounded(made.select("img", "channel", "category", F.posexplode("data").alias("k", "v")), "v")


# -- the profile store ----------------------------------------------------------------------


def _store(spark) -> ProfileStore:
    path = shared_path(spark, "store")
    return ProfileStore(spark, path, os.path.basename(path).replace("-", "_"))


DAYS = """stamped AS (SELECT strftime(date_trunc('day', ts), '%Y.%m.%d-%H.%M.%S') AS populate_time, event_id, event_type, value FROM events)"""


def _filled(spark, sf) -> ProfileStore:
    """``events`` as a table of runs, one per day."""
    store = _store(spark)
    stamp = text.run_stamp(F.date_trunc("day", F.col("ts"))).alias(RUN_KEY)
    store.append_runs("profile", table(spark, sf, "events").select(stamp, "event_id", "event_type", "value"))
    return store


@query(
    "s10_store_append_and_delete",
    f"""WITH {DAYS} SELECT populate_time, event_id, event_type, value FROM stamped WHERE event_type <> 'error'
AND populate_time NOT IN (SELECT DISTINCT populate_time FROM stamped ORDER BY 1 DESC LIMIT 2)""",
)
def _(spark, sf):
    store = _filled(spark, sf)
    store.delete_where("profile", "event_type", "error")
    store.delete_last_runs("profile", num_run=2)
    return store.read("profile")


@query(
    "s10_store_columns",
    f"""WITH {DAYS} SELECT populate_time, event_id, value, round(value * 2, 4) AS doubled,
value / max(value) OVER (PARTITION BY populate_time) AS value_norm FROM stamped""",
)
def _(spark, sf):
    store = _filled(spark, sf)
    store.add_col("profile", "doubled", "double", lambda v: F.round(v * 2, 4), "value")
    store.normalize_col("profile", "value", RUN_KEY)
    store.drop_col("profile", "event_type")
    return store.read("profile")


@query(
    "s8_run_configurations",
    """SELECT '2024.01.01-00.00.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS populate_time, '64FC_LIN-' || p_size || 'FC_SIG-10FC_SOFTMAX' AS struct,
'CE' AS cost_type, p_type AS train_func, count(*) AS train_size, CAST(10 AS BIGINT) AS test_size, CAST(100 AS BIGINT) AS batch_size,
0.02::DOUBLE AS learn_rate, 0.9::DOUBLE AS momentum FROM part GROUP BY p_size, p_type""",
)
def _(spark, sf):
    layer = lambda n, t: F.struct(n.alias("num_channels"), F.lit(t).alias("type"))
    network = F.array(layer(F.col("p_size"), "FC_SIG"), layer(F.lit(10), "FC_SOFTMAX"))
    sizes = table(spark, sf, "part").groupBy("p_size", "p_type").agg(F.count(F.lit(1)).alias("train_size"))
    values = {
        "struct": text.structure_string(F.lit(64), network),
        "cost_type": F.lit("CE"),
        "train_func": F.col("p_type"),
        "train_size": F.col("train_size"),
        "test_size": F.lit(10),
        "batch_size": F.lit(100),
        "learn_rate": F.lit(0.02),
        "momentum": F.lit(0.9),
    }
    stamp = F.format_string("2024.01.01-00.00.%02d", "p_size").alias(RUN_KEY)
    rows = sizes.select(stamp, *[values[f.name].cast(f.dataType).alias(f.name) for f in META.fields])
    store = _store(spark)
    store.append_runs("meta_ann", rows)
    return store.read("meta_ann")


# -- event logs --------------------------------------------------------------------------------


def _event_log(spark, sf) -> DataFrame:
    """``events`` written as the lines of an application's log, and read back.

    A stage is a user, and so is a job, which plans one more stage that never runs; a task runs for
    1000 x value milliseconds. Every region is a host, whose first executor is replaced by a smaller one.
    """
    path = f"{shared_path(spark, 'log')}/app-20240101000000-0001"
    rows = table(spark, sf, "events")
    run = F.floor(F.round(F.col("value") * 1000)).cast("long")
    task = F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.col("user_id").alias("Stage ID"),
        F.struct(F.lit(0).alias("Launch Time"), (run + 50).alias("Finish Time"), F.lit(0).alias("Getting Result Time")).alias("Task Info"),
        F.struct(
            run.alias("Executor Run Time"),
            F.lit(20).alias("Executor Deserialize Time"),
            F.lit(5).alias("Result Serialization Time"),
            F.length("props").alias("Peak Execution Memory"),
            F.struct(F.col("event_id").alias("Bytes Read")).alias("Input Metrics"),
        ).alias("Task Metrics"),
    )
    info = F.struct(
        F.col("user_id").alias("Stage ID"),
        F.lit("collect").alias("Stage Name"),
        F.col("n").alias("Number of Tasks"),
        F.lit(0).alias("Submission Time"),
        (F.col("n") * 10).alias("Completion Time"),
    )
    stage = F.struct(F.lit("SparkListenerStageCompleted").alias("Event"), info.alias("Stage Info"))
    per_stage = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    job = F.col("user_id").alias("Job ID")
    more = F.array("user_id", F.col("user_id") + 1_000_000).alias("Stage IDs")
    begin = F.struct(F.lit("SparkListenerJobStart").alias("Event"), job, F.col("user_id").alias("Submission Time"), more)
    end = F.struct(F.lit("SparkListenerJobEnd").alias("Event"), job, (F.col("user_id") + F.col("n") * 10).alias("Completion Time"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"))
    start = F.struct(F.lit("SparkListenerApplicationStart").alias("Event"), F.lit("batch_eval-dsize_500-partition_8-itr_1").alias("App Name"), F.lit(500).alias("Timestamp"))
    close = F.struct(F.lit("SparkListenerApplicationEnd").alias("Event"), (F.col("n") + 500).alias("Timestamp"))
    memory = F.struct(F.lit("SparkListenerEnvironmentUpdate").alias("Event"), F.create_map(F.lit("spark.executor.memory"), F.lit("4g")).alias("Spark Properties"))

    def executor(cores):
        return F.struct(F.lit("SparkListenerExecutorAdded").alias("Event"), F.struct(F.col("r_name").alias("Host"), cores.alias("Total Cores")).alias("Executor Info"))

    hosts = table(spark, sf, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("long"))
    parts = [(per_stage, stage), (per_stage, begin), (per_stage, end), (whole, start), (whole, close), (whole, memory)]
    parts += [(hosts, executor(F.col("r_regionkey") + 4)), (hosts, executor(F.lit(1)))]
    lines = rows.select(F.to_json(task).alias("value"))
    for frame, line in parts:
        lines = lines.union(frame.select(F.to_json(line)))
    lines.write.text(path)
    return event_log.read_events(spark, path)


@query(
    "a12_event_log_sums",
    """SELECT 'app-20240101000000-0001' AS app_id, user_id AS stage_id, round(sum(round(value * 1000) / 1000.0), 3) AS "Duration",
round(count(*) * 0.025::DOUBLE, 3) AS "Scheduler_Delay", CAST(sum(event_id) AS DOUBLE) AS "Input_Size", CAST(sum(length(props)) AS DOUBLE) AS "Peak_Execution_Memory"
FROM events GROUP BY user_id""",
)
def _(spark, sf):
    wanted = ["Duration", "Scheduler_Delay", "Input_Size", "Peak_Execution_Memory"]
    sums = event_log.task_sums(_event_log(spark, sf), wanted)
    return rounded(sums, "Duration", "Scheduler_Delay", digits=3)


@query(
    "a14_stage_summary",
    """SELECT 'app-20240101000000-0001' AS app_id, user_id AS stage_id, 'collect' AS descp, round(count(*) / 100.0, 3) AS duration, count(*) AS num_tasks
FROM events GROUP BY user_id""",
)
def _(spark, sf):
    return rounded(event_log.stage_summary(_event_log(spark, sf)), "duration", digits=3)


@query(
    "a13_event_log_medians",
    """SELECT user_id AS stage_id, round(median(round(value * 1000) / 1000.0), 4) AS median FROM events GROUP BY user_id""",
)
def _(spark, sf):
    medians = event_log.stage_medians(_event_log(spark, sf), ["Duration"])
    return rounded(medians.select("stage_id", "median"), "median", digits=4)


@query(
    "a14_app_summary",
    """SELECT 'app-20240101000000-0001' AS app_id, 'batch_eval-dsize_500-partition_8-itr_1' AS name, count(*) / 1000.0::DOUBLE AS tot_dur,
count(DISTINCT user_id) AS num_jobs, count(DISTINCT user_id) AS num_stages, (SELECT count(*) FROM region) AS num_workers,
(SELECT CAST(sum(r_regionkey + 4) AS BIGINT) FROM region) AS num_cores, 4096.0::DOUBLE AS mem_per_node FROM events""",
)
def _(spark, sf):
    return event_log.app_summary(_event_log(spark, sf))


@query(
    "a14_job_summary",
    """SELECT 'app-20240101000000-0001' AS app_id, user_id AS job_id, count(*) / 100.0::DOUBLE AS duration, 1::BIGINT AS stages_done, 2::BIGINT AS stages_total
FROM events GROUP BY user_id""",
)
def _(spark, sf):
    return event_log.job_summary(_event_log(spark, sf))


@query(
    "s17_stage_rows",
    """SELECT '2024.01.01-00.00.00' AS populate_time, (SELECT count(*) FROM region) AS clt_size, 'node' AS node_type,
(SELECT CAST(sum(r_regionkey + 4) AS BIGINT) FROM region) AS num_cores, 4096.0::DOUBLE AS mem_per_node, 'app-20240101000000-0001' AS app_id,
'batch_eval' AS app_name, 500::BIGINT AS data_size, 8::BIGINT AS num_partition, 1::BIGINT AS itr,
(SELECT count(*) FROM events) / 1000.0::DOUBLE AS tot_dur, user_id AS stage_id, 'collect' AS descp,
round(sum(round(value * 1000) / 1000.0), 3) AS "Duration", round(count(*) * 0.025::DOUBLE, 3) AS "Scheduler_Delay",
round(count(*) * 0.02::DOUBLE, 3) AS "Task_Deserialization_Time", NULL::DOUBLE AS "GC_Time", round(count(*) * 0.005::DOUBLE, 3) AS "Result_Serialization_Time",
0.0::DOUBLE AS "Getting_Result_Time", CAST(sum(length(props)) AS DOUBLE) AS "Peak_Execution_Memory", CAST(sum(event_id) AS DOUBLE) AS "Input_Size",
NULL::DOUBLE AS "Shuffle_Read_Size", NULL::DOUBLE AS "Shuffle_Read_Blocked_Time", NULL::DOUBLE AS "Shuffle_Remote_Reads", NULL::DOUBLE AS "Input_Size___Records"
FROM events GROUP BY user_id""",
)
def _(spark, sf):
    rows = event_log.stage_rows(_event_log(spark, sf), "node", "2024.01.01-00.00.00")
    return rounded(rows, "Duration", "Scheduler_Delay", "Task_Deserialization_Time", "Result_Serialization_Time", digits=3)


FILES = """files AS (SELECT source AS set, CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 1 THEN '.' ELSE '' END || 'f' || doc_id || '.' ||
CASE WHEN source IN ('src0', 'src1') AND doc_id % 5 = 0 THEN 'txt' WHEN source = 'src2' THEN 'doc' WHEN source = 'src3' THEN 'npz' ELSE 'parquet' END AS name
FROM documents)"""


@query(
    "p8_input_sets",
    f"""WITH {FILES}, kinds AS (SELECT DISTINCT set, regexp_extract(name, '([^.]*)$', 1) AS kind FROM files WHERE name NOT LIKE '.%')
SELECT set, string_agg(kind, ' ' ORDER BY kind) AS kinds, count(*) = 1 AND bool_and(kind IN ('npz', 'parquet')) AS accepted FROM kinds GROUP BY set""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    hidden = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 2 == 1), ".").otherwise("")
    mixed = F.col("source").isin("src0", "src1") & (F.col("doc_id") % 5 == 0)
    kind = F.when(mixed, "txt").when(F.col("source") == "src2", "doc").when(F.col("source") == "src3", "npz").otherwise("parquet")
    files = docs.select(F.col("source").alias("set"), F.concat(hidden, F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("name"))
    return sets.input_types(files).withColumn("kinds", F.array_join("kinds", " "))
