"""Cluster metrics from Spark event logs (JSON lines)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runloom.functions import text
from runloom.operators.records import profile_rows
from runloom.operators.stages import METRICS, exact_median

# The event fields that are read, as Spark writes them.
_SCHEMA = """
  Event string, Timestamp long, `App Name` string, `App ID` string,
  `Job ID` long, `Submission Time` long, `Completion Time` long, `Stage IDs` array<long>,
  `Stage ID` long,
  `Stage Info` struct<`Stage ID`: long, `Stage Name`: string, `Number of Tasks`: long, `Submission Time`: long, `Completion Time`: long>,
  `Executor Info` struct<`Host`: string, `Total Cores`: long>, `Spark Properties` map<string, string>,
  `Task Info` struct<`Launch Time`: long, `Finish Time`: long, `Getting Result Time`: long>,
  `Task Metrics` struct<
    `Executor Deserialize Time`: long, `Executor Run Time`: long, `JVM GC Time`: long,
    `Result Serialization Time`: long, `Peak Execution Memory`: long,
    `Input Metrics`: struct<`Bytes Read`: long, `Records Read`: long>,
    `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long, `Fetch Wait Time`: long>>
"""
_APP_ID = r"((?:app|application|local)[-_][0-9]+(?:[-_][0-9]+)?)"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events, with the application id taken from the log's path."""
    events = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").json(path)
    return events.select(F.regexp_extract("_metadata.file_path", _APP_ID, 1).alias("app_id"), "*")


def task_columns(events: DataFrame) -> DataFrame:
    """A row per task: app_id, stage_id and a column per metric, times in seconds, sizes in bytes."""
    info, m = F.col("Task Info"), F.col("Task Metrics")
    shuffle = m["Shuffle Read Metrics"]
    seconds = lambda c: c / 1000.0
    span = info["Finish Time"] - info["Launch Time"]
    getting = F.when(info["Getting Result Time"] > 0, info["Finish Time"] - info["Getting Result Time"]).otherwise(0)
    worked = m["Executor Run Time"] + m["Executor Deserialize Time"] + m["Result Serialization Time"] + getting
    values: dict[str, Column] = {
        "Duration": seconds(m["Executor Run Time"]),
        "Scheduler_Delay": seconds(F.greatest(span - worked, F.lit(0))),
        "Task_Deserialization_Time": seconds(m["Executor Deserialize Time"]),
        "GC_Time": seconds(m["JVM GC Time"]),
        "Result_Serialization_Time": seconds(m["Result Serialization Time"]),
        "Getting_Result_Time": seconds(getting),
        "Peak_Execution_Memory": m["Peak Execution Memory"],
        "Input_Size": m["Input Metrics"]["Bytes Read"],
        "Shuffle_Read_Size": shuffle["Remote Bytes Read"] + shuffle["Local Bytes Read"],
        "Shuffle_Read_Blocked_Time": seconds(shuffle["Fetch Wait Time"]),
        "Shuffle_Remote_Reads": shuffle["Remote Bytes Read"],
        "Input_Size___Records": m["Input Metrics"]["Records Read"],
    }
    ends = events.where(F.col("Event") == "SparkListenerTaskEnd")
    return ends.select("app_id", F.col("Stage ID").alias("stage_id"), *[values[n].cast("double").alias(n) for n in METRICS])


def task_metrics(events: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Long rows (app_id, stage_id, metric, value) of the metrics asked for."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])
    return task_columns(events).select("app_id", "stage_id", F.inline(pairs))


def task_sums(events: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Sum of each metric over the tasks of a stage: one row per task goes in, as it was logged."""
    return task_columns(events).groupBy("app_id", "stage_id").agg(*[F.sum(m).alias(m) for m in metrics])


def app_summary(events: DataFrame) -> DataFrame:
    """Per application: name, seconds, jobs, stages completed, workers, cores, executor memory in MB.

    A worker is a host, with the cores of its largest executor: an executor that replaces a lost
    one on the same host adds nothing. Without a set memory Spark's 1024 MB hold.
    """
    is_ = lambda e: F.col("Event") == f"SparkListener{e}"
    start, end = F.max(F.when(is_("ApplicationStart"), F.col("Timestamp"))), F.max(F.when(is_("ApplicationEnd"), F.col("Timestamp")))
    added = events.where(is_("ExecutorAdded"))
    hosts = added.groupBy("app_id", F.col("Executor Info")["Host"].alias("_host")).agg(F.max(F.col("Executor Info")["Total Cores"]).alias("_cores"))
    workers = hosts.groupBy("app_id").agg(F.count(F.lit(1)).alias("num_workers"), F.sum("_cores").alias("num_cores"))
    memory = F.max(F.when(is_("EnvironmentUpdate"), megabytes(F.col("Spark Properties")["spark.executor.memory"])))
    apps = events.groupBy("app_id").agg(
        F.max("App Name").alias("name"),
        ((end - start) / 1000.0).alias("tot_dur"),
        F.count(F.when(is_("JobStart"), 1)).alias("num_jobs"),
        F.count(F.when(is_("StageCompleted"), 1)).alias("num_stages"),
        F.coalesce(memory, F.lit(1024.0)).alias("mem_per_node"),
    )
    joined = apps.join(workers, "app_id", "left")
    return joined.select(
        "app_id", "name", "tot_dur", "num_jobs", "num_stages", F.coalesce("num_workers", F.lit(0)).alias("num_workers"),
        F.coalesce("num_cores", F.lit(0)).alias("num_cores"), "mem_per_node",
    )


def megabytes(size: Column) -> Column:
    """A Spark memory setting such as ``4g`` in MB; MB where no unit is given."""
    unit = F.lower(F.regexp_extract(size, r"([A-Za-z]?)[bB]?$", 1))
    factor = F.when(unit == "k", 2.0**-10).when(unit == "g", 2.0**10).when(unit == "t", 2.0**20).otherwise(1.0)
    return F.regexp_extract(size, r"^\s*([0-9]+)", 1).cast("double") * factor


def job_summary(events: DataFrame) -> DataFrame:
    """Per job: seconds, stages planned and stages done."""
    event = F.col("Event")
    starts = events.where(event == "SparkListenerJobStart").select("app_id", "Job ID", "Submission Time", F.explode("Stage IDs").alias("stage_id"))
    ends = events.where(event == "SparkListenerJobEnd").select("app_id", "Job ID", "Completion Time")
    done = stage_summary(events).select("app_id", "stage_id", F.lit(1).alias("_done"))
    per_job = starts.join(done, ["app_id", "stage_id"], "left").groupBy("app_id", "Job ID").agg(
        F.min("Submission Time").alias("_start"), F.count(F.lit(1)).alias("stages_total"), F.count("_done").alias("stages_done")
    )
    return per_job.join(ends, ["app_id", "Job ID"], "left").select(
        "app_id", F.col("Job ID").alias("job_id"), ((F.col("Completion Time") - F.col("_start")) / 1000.0).alias("duration"), "stages_done", "stages_total"
    )


def stage_summary(events: DataFrame) -> DataFrame:
    """Per stage: description, seconds, tasks. A retried stage counts once, with all its time."""
    stage = F.col("Stage Info")
    done = events.where(F.col("Event") == "SparkListenerStageCompleted")
    return done.groupBy("app_id", stage["Stage ID"].alias("stage_id")).agg(
        F.max(stage["Stage Name"]).alias("descp"),
        (F.sum(stage["Completion Time"] - stage["Submission Time"]) / 1000.0).alias("duration"),
        F.max(stage["Number of Tasks"]).alias("num_tasks"),
    )


def stage_rows(events: DataFrame, node_type: str, stamp: str | None = None) -> DataFrame:
    """Profile rows per (application, stage): cluster, application, stage and metric sums.

    A stage with tasks that never completed has no description.
    """
    apps = app_summary(events).select("app_id", "num_workers", "num_cores", "mem_per_node", "name", "tot_dur")
    joined = task_sums(events).join(stage_summary(events).select("app_id", "stage_id", "descp"), ["app_id", "stage_id"], "left").join(apps, "app_id")
    rows = joined.select(
        F.col("num_workers").alias("clt_size"),
        F.lit(node_type).alias("node_type"),
        "num_cores",
        F.col("mem_per_node").cast("double").alias("mem_per_node"),
        "app_id",
        *text.app_name_parts(F.col("name")),
        "tot_dur",
        "stage_id",
        "descp",
        *METRICS,
    )
    return profile_rows(rows, stamp=stamp)


def stage_medians(events: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Exact median of each metric asked for per stage, as rows."""
    return exact_median(task_metrics(events, metrics), ["app_id", "stage_id", "metric"], "value")
