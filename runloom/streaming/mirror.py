"""Structured Streaming over profile tables: a mirror, and the running best of each run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from runloom.session import cut_lineage

FILE, PART, VERSION = "_source_file", "_mirror_part", "_version"
MANIFEST = "-manifest"  # beside the mirror: a version for each call
# A part of the mirror of whose rows more than this share is dead is written anew without them.
DEAD_SHARE = 0.5


def _source(spark: SparkSession, path: str, schema: StructType, pattern: str | None, files_per_trigger: int) -> DataFrame:
    """New files of a table: a folder's, or a single file, which a stream finds by its name in its folder."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(file):
        path, pattern = file.getParent().toString(), file.getName()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The files below a folder as a listing gives them; no content or footer is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("_metadata.file_path").alias(FILE))


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _parts(spark: SparkSession, target: str) -> set[str]:
    found = _files(spark, target).select(F.regexp_extract(FILE, f"/{PART}=([^/]+)/", 1).alias("p")).distinct()
    return {r["p"] for r in found.where("p <> ''").collect()}


def _manifest(spark: SparkSession, target: str) -> tuple[int, DataFrame | None]:
    """Number and rows (part, file, rows, last) of the latest version; 0 and None before the first call."""
    try:
        stored = spark.read.parquet(f"{target}{MANIFEST}")
    except AnalysisException:
        return 0, None
    version = stored.agg(F.max(VERSION)).first()[0]
    return version, stored.where(F.col(VERSION) == version).drop(VERSION)


def mirror(
    spark: SparkSession,
    path: str,
    schema: StructType,
    target: str,
    state: str,
    pattern: str | None = None,
    partition_by: str | None = None,
    files_per_trigger: int = 1000,
) -> None:
    """Bring the mirror up to the table's present rows; ``mirrored`` reads them.

    The stream copies the files that are new since the last call, each batch as a part of its own whose
    rows keep the file they came from; the checkpoint in ``state`` remembers the files copied. A
    listing of the table then tells which of the copied files are still there. The manifest, one
    small file, names them by part and is replaced in one step: until then readers see the state
    of the last call. Parts with no live row are removed, and those mostly dead written anew, so the
    mirror shrinks with the table. A call that was cut short is repeated without doubling rows:
    batches overwrite themselves, and parts that no manifest names are removed or, if they
    are new batches, taken up.
    """

    def copy(rows: DataFrame, number: int) -> None:
        writer = rows.write.mode("overwrite")
        if partition_by is not None:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{target}/{PART}=b{number}")

    source = _source(spark, path, schema, pattern, files_per_trigger).withColumn(FILE, F.col("_metadata.file_path"))
    query = source.writeStream.foreachBatch(copy).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()

    version, known = _manifest(spark, target)
    last = -1 if known is None else known.agg(F.max("last")).first()[0]
    there = _parts(spark, target)
    fresh = sorted(int(p[1:]) for p in there if p.startswith("b") and int(p[1:]) > last)
    rows = spark.createDataFrame([], f"part string, {FILE} string, n long") if known is None else known.select("part", FILE, "n")
    if fresh:
        copied = spark.read.option("basePath", target).parquet(*[f"{target}/{PART}=b{n}" for n in fresh])
        rows = rows.unionByName(copied.groupBy(F.col(PART).cast("string").alias("part"), FILE).agg(F.count(F.lit(1)).alias("n")))
    marked = cut_lineage(rows.join(_files(spark, path, pattern).distinct().withColumn("live", F.lit(True)), FILE, "left"))
    sizes = marked.groupBy("part").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("live"), F.col("n"))), F.lit(0)).alias("live"))
    sizes = {r["part"]: (r["live"], r["n"]) for r in sizes.collect()}
    thin = [p for p, (live, n) in sizes.items() if 0 < live < n * (1 - DEAD_SHARE)]
    live = marked.where("live").select("part", FILE, "n")
    anew = f"c{version + 1}"
    if thin:
        kept = spark.read.option("basePath", target).parquet(*[f"{target}/{PART}={p}" for p in thin])
        kept = kept.join(live.where(F.col("part").isin(thin)).select(FILE).distinct(), FILE, "left_semi").drop(PART)
        writer = kept.select(*schema.names, FILE).write.mode("overwrite")
        (writer if partition_by is None else writer.partitionBy(partition_by)).parquet(f"{target}/{PART}={anew}")
        live = live.withColumn("part", F.when(F.col("part").isin(thin), anew).otherwise(F.col("part")))
    newest = max([last, *fresh])
    # A row without part keeps the number of the last batch where nothing is live.
    nothing = spark.createDataFrame([(None, None, 0)], f"part string, {FILE} string, n long")
    written = live.unionByName(nothing).withColumn("last", F.lit(newest).cast("long"))
    written.coalesce(1).write.mode("overwrite").parquet(f"{target}{MANIFEST}/{VERSION}={version + 1}")
    if version:
        _remove(spark, f"{target}{MANIFEST}/{VERSION}={version}")
    named = {p for p, (n, _) in sizes.items() if n} - set(thin)
    for part in there - named - {anew}:
        _remove(spark, f"{target}/{PART}={part}")


def mirrored(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a mirror that belong to files the table had at the last call; the manifest names their parts."""
    _, known = _manifest(spark, target)
    parts = [r["part"] for r in known.where("part IS NOT NULL").select("part").distinct().collect()]
    if not parts:
        raise ValueError(f"the mirror {target} holds no rows")
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/{PART}={p}" for p in parts])
    live = known.where("part IS NOT NULL").select(F.col("part").alias(PART), FILE)
    return rows.withColumn(PART, F.col(PART).cast("string")).join(live, [PART, FILE], "left_semi").drop(PART, FILE)


def running_best(
    spark: SparkSession,
    path: str,
    schema: StructType,
    work: str,
    pattern: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda s: s,
    run: str = "run",
    metric: str = "metric",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Best metric of each run so far; state is one value per run, kept between calls.

    Each micro-batch writes the runs it improved under its batch number (a repeated batch
    overwrites itself); the answer is the largest value of a run over all of them.
    """
    best = prepare(_source(spark, path, schema, pattern, files_per_trigger)).groupBy(run).agg(F.max(metric).alias("best"))

    def keep(updates: DataFrame, number: int) -> None:
        updates.write.mode("overwrite").parquet(f"{work}/best/batch={number}")

    query = (
        best.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{work}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{work}/best").groupBy(run).agg(F.max("best").alias("best"))


