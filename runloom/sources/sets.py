"""Dataset files: Parquet sets, NumPy archives, sparse text, class folders, images."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from runloom.functions import text
from runloom.operators import dataset
from runloom.operators.control import category_lookup
from runloom.operators.dataset import SPLITS
from runloom.plans.score import as_lists

# Class index of each category folder; two data sets share indexes.
CATEGORY_INDEX = {
    "cha": 0,
    "chg": 1,
    "edu": 2,
    "gym": 3,
    "mer": 4,
    "nav": 5,
    "por": 6,
    "sce": 7,
    "tha": 8,
    "Debris": 0,
    "MCF7": 1,
    "PBMC": 2,
    "THP1": 3,
}

# File types a scoring run accepts.
FILE_TYPES = ("png", "npz", "h5", "parquet")

_ARCHIVE = "path string, row long, shape array<int>, data array<double>, target array<double>"
ROWS_PER_BATCH_BYTES = 32 << 20


def parquet_sets(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of every matching file, with the file name as ``set``.

    A folder named ``*.parquet`` holds the parts of one table, so it is one set of that name.
    """
    df = spark.read.parquet(pattern)
    # Folders above the first name that the pattern leaves open, or above its last name, tell nothing.
    first = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(re.split(r"[*?\[{\\]", pattern.rstrip("/"))[0] + "x")
    depth = first.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(first).depth()
    names = F.split(F.regexp_replace("_metadata.file_path", "^[^/]+:(//[^/]*)?", ""), "/")
    tables = F.filter(names, lambda n, i: (i >= depth) & n.endswith(".parquet"))
    return df.select(F.coalesce(F.get(tables, F.lit(0)), F.col("_metadata.file_name")).alias("set"), "*")


def _archive_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode archives, a bounded number of rows at a time."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as archive:
                data, target = archive["data"], archive["target"]
            if len(data) != len(target):
                raise ValueError(f"{path}: {len(data)} data rows, {len(target)} targets")
            shape = list(data.shape[1:])
            flat = data.reshape(len(data), -1)
            goal = target.reshape(len(target), -1)
            step = max(1, ROWS_PER_BATCH_BYTES // max(8, 8 * flat.shape[1]))
            for i in range(0, len(flat), step):
                part, wanted = flat[i : i + step], goal[i : i + step]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n),
                        pa.array(np.arange(i, i + n)),
                        pa.array([shape] * n, pa.list_(pa.int32())),
                        as_lists(part.astype(np.float64)),
                        as_lists(wanted.astype(np.float64)),
                    ],
                    names=["path", "row", "shape", "data", "target"],
                )


def npz_sets(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """Archives with ``data`` and ``target`` as rows (set, row, shape, data, target).

    Each archive is one binary row, decoded where it is read. Archives are meant to be
    small sets; store large ones as Parquet, which splits.
    """
    return archive_rows(spark.read.format("binaryFile").load(pattern))


def archive_rows(files: DataFrame) -> DataFrame:
    """Decode (path, content) rows of archives."""
    rows = files.select("path", "content").mapInArrow(_archive_rows, _ARCHIVE)
    return rows.select(text.base_name(F.col("path")).alias("set"), "row", "shape", "data", "target")


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Visible file names of a folder; hidden ones are skipped by the reader too."""
    found = spark.read.format("binaryFile").load(folder).select(text.base_name(F.col("path")).alias("f"))
    return sorted(r["f"] for r in found.where(~F.col("f").startswith(".")).collect())


def check_input_type(names: Sequence[str]) -> str:
    """The one file type of an input set; mixed or unknown types are refused."""
    kinds = {n.rsplit(".", 1)[-1] for n in names if not n.startswith(".")}
    if len(kinds) != 1:
        raise ValueError(f"one file type is needed, found {sorted(kinds)}")
    kind = kinds.pop()
    if kind not in FILE_TYPES:
        raise ValueError(f"file type {kind!r} is not supported")
    return kind


def input_types(files: DataFrame, set_col: str = "set", name: str = "name") -> DataFrame:
    """Per input set of a table of file names: its visible files' types, and whether it holds one known type only."""
    shown = files.where(~F.col(name).startswith(".")).select(set_col, F.substring_index(name, ".", -1).alias("_kind"))
    kinds = shown.groupBy(set_col).agg(F.sort_array(F.collect_set("_kind")).alias("kinds"))
    known = (F.size("kinds") == 1) & F.array_contains(F.array(*[F.lit(k) for k in FILE_TYPES]), F.col("kinds")[0])
    return kinds.withColumn("accepted", known)


def load_npz(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The train, valid and test archives of a folder, and ``<split>_size`` of each."""
    names = list_files(spark, folder)
    if names != sorted(f"{s}.npz" for s in SPLITS):
        raise ValueError(f"{folder} must hold exactly {[f'{s}.npz' for s in SPLITS]}, has {names}")
    frames = {s: npz_sets(spark, f"{folder}/{s}.npz").withColumn("set", F.lit(s)) for s in SPLITS}
    return frames, {f"{s}_size": frames[s].count() for s in SPLITS}


def load_parquet(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Out-of-core form of the same: ``<folder>/<split>`` Parquet, scanned in partitions."""
    frames = {s: spark.read.parquet(f"{folder}/{s}").withColumn("set", F.lit(s)) for s in SPLITS}
    return frames, {f"{s}_size": frames[s].count() for s in SPLITS}


def libsvm_to_dataset(spark: SparkSession, path: str, channels: int, height: int, width: int) -> DataFrame:
    """Sparse ``label index:value`` lines as dense rows; the size must be C x H x W."""
    wanted = channels * height * width
    rows = spark.read.format("libsvm").option("numFeatures", str(wanted)).load(path)
    return rows.select(F.col("label"), vector_to_array("features").alias("data"))


def category_files(spark: SparkSession, root: str, lookup: dict[str, int] | None = None) -> DataFrame:
    """Files of ``root/<category>/<file>`` with their class index; unknown folders fail."""
    return with_category(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), lookup)


def with_category(files: DataFrame, lookup: dict[str, int] | None = None) -> DataFrame:
    """Class index of (path, content) rows from the folder name."""
    named = files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("category"))
    known = files.sparkSession.createDataFrame(sorted((lookup or CATEGORY_INDEX).items()), "name string, label int")
    # A dictionary held by the caller: broadcasting it keeps file contents from being shuffled.
    return category_lookup(named, "category", F.broadcast(known), "name", "label")


def category_dir_ingest(
    spark: SparkSession, root: str, channels: int, height: int, width: int, lookup: dict[str, int] | None = None, seed: int = 0
) -> DataFrame:
    """Raw byte images (y, x, channel) by class folder, as shuffled channel-first rows."""
    return category_images(category_files(spark, root, lookup), channels, height, width, seed)


def category_images(files: DataFrame, channels: int, height: int, width: int, seed: int = 0) -> DataFrame:
    """Decode and shuffle (path, content, label) rows."""
    named = files.select("path", "label", F.xxhash64("path").alias("id"), "content")
    rows = decode_images(named, "content", channels, height, width, interleaved=True)
    return dataset.shuffle(rows, seed, id_col="id").drop("id")


def decode_images(
    df: DataFrame, content: str, channels: int, height: int, width: int,
    interleaved: bool = False, scaled: bool = False, reverse: bool = False,
) -> DataFrame:
    """Replace a column of raw unsigned bytes by ``data``: channel-first doubles.

    ``interleaved`` input is (y, x, channel), otherwise (channel, y, x); ``reverse`` swaps the
    channel order; ``scaled`` maps 0..255 to [-1, 1]. An image of another length fails. Whole
    Arrow batches are decoded, in steps of bounded size.
    """
    count = channels * height * width
    kept = [f for f in df.schema.fields if f.name != content]
    schema = StructType([*kept, StructField("data", ArrayType(DoubleType()))])
    step = max(1, ROWS_PER_BATCH_BYTES // (8 * count))

    def decode(raw: list[pa.Buffer]) -> pa.Array:
        wrong = [len(b) for b in raw if len(b) != count]
        if wrong:
            raise ValueError(f"expected {count} bytes, found {wrong[0]}")
        values = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), count)
        if interleaved:
            values = np.moveaxis(values.reshape(-1, height, width, channels), 3, 1)
        planes = values.reshape(len(raw), channels, height * width)
        planes = planes[:, ::-1] if reverse else planes
        flat = planes.reshape(len(raw), count).astype(np.float64)
        return as_lists(flat / 127.5 - 1.0 if scaled else flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                data = decode([c.as_buffer() for c in part.column(content)])
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], data], names=schema.fieldNames())

    return df.select(*[f.name for f in kept], content).mapInArrow(run, schema)


def image_ingest(spark: SparkSession, pattern: str, height: int, width: int) -> DataFrame:
    """Raw byte images scaled to [-1, 1]; channels and class come from the file name.

    A grey stack holds its channels one below the other, so its rows are channel-first
    already. All files must agree on the number of channels.
    """
    return named_images(spark.read.format("binaryFile").load(pattern), height, width)


def named_images(files: DataFrame, height: int, width: int) -> DataFrame:
    """Decode (path, content) rows; see ``image_ingest``."""
    named = files.select(text.base_name(F.col("path")).alias("name"), "content")
    tagged = named.select("name", *text.image_name_parts(F.col("name")), "content")
    counts = [r["channel"] for r in tagged.select("channel").distinct().limit(2).collect()]
    if len(counts) != 1:
        raise ValueError(f"files disagree on the number of channels: {sorted(counts)}")
    return decode_images(tagged, "content", counts[0], height, width, scaled=True)


def rgb_images(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """Encoded colour pictures through Spark's image source, scaled and channel-first (R, G, B)."""
    rows = spark.read.format("image").load(path).select("image.*")
    named = rows.select(text.base_name(F.col("origin")).alias("name"), F.col("data").alias("content"))
    # Spark stores pixels as B, G, R.
    return decode_images(named, "content", 3, height, width, interleaved=True, scaled=True, reverse=True)
