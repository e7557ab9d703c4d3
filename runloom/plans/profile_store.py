"""The profile store: catalog tables over Parquet, one partition per run."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from runloom.functions import arrays
from runloom.operators.records import (
    RUN_KEY,
    add_col,
    delete_where,
    drop_col,
    equals_all,
    last_runs,
    new_stamp,
    normalize_col,
    profile_rows,
    require_columns,
    require_same_schema,
)
from runloom.operators.scans import row_index
from runloom.plans.network import NetConfig
from runloom.session import cut_lineage


# Characters a run stamp may have, as it names a folder.
STAMP_CHARACTERS = r"[\w.\-]+"

# The columns of the run table and of the cost table, in their stored order.
META = StructType(
    [
        StructField("struct", StringType()),
        StructField("cost_type", StringType()),
        StructField("train_func", StringType()),
        StructField("train_size", LongType()),
        StructField("test_size", LongType()),
        StructField("batch_size", LongType()),
        StructField("learn_rate", DoubleType()),
        StructField("momentum", DoubleType()),
    ]
)
COSTS = StructType(
    [
        StructField("epoch_num", LongType()),
        StructField("batch_num", LongType()),
        StructField("cost_batch", DoubleType()),
        StructField("correct_batch", DoubleType()),
        StructField("cost_val", DoubleType()),
        StructField("correct_val", DoubleType()),
    ]
)


class ProfileStore:
    """Append-only tables keyed by run stamp, with explicit deletes.

    Every table is partitioned by run, so appends never rewrite, reading a run prunes, and
    removing a run drops its partition. Tables are external: a new session sees what is
    already in the folder.
    """

    def __init__(self, spark: SparkSession, root: str, database: str | None = None):
        """Without a name the database is named after the folder, so that stores do not meet."""
        self.spark, self.root = spark, root.rstrip("/")
        self.database = database or f"profiles_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{self.root}'")

    # -- catalog -----------------------------------------------------------------

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def table_exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{table}")

    def list_tables(self, pattern: str = "") -> list[str]:
        """Names whose beginning matches the regular expression."""
        tables = self.spark.sql(f"SHOW TABLES IN `{self.database}`").where(~F.col("isTemporary"))
        found = tables.where(F.col("tableName").rlike(f"^(?:{pattern})")).orderBy("tableName")
        return [r["tableName"] for r in found.collect()]

    def table_schema(self, table: str) -> dict[str, str]:
        return dict(self.read(table).dtypes)

    def count_rows(self, table: str) -> int:
        return self.read(table).count()

    def read(self, table: str) -> DataFrame:
        """The table with the run stamp as its first column."""
        df = self.spark.table(self._name(table))
        return df.select(RUN_KEY, *[c for c in df.columns if c != RUN_KEY])

    def open(self, table: str, schema: StructType) -> None:
        """Register a table below the root, with the runs already stored there."""
        if self.table_exists(table):
            return
        location = f"{self.root}/{table}"
        empty = self.spark.createDataFrame([], StructType([*schema.fields, StructField(RUN_KEY, StringType())]))
        empty.write.mode("append").partitionBy(RUN_KEY).parquet(location)  # makes the folder
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(
            f"CREATE TABLE {self._name(table)} ({columns}, `{RUN_KEY}` string) USING parquet "
            f"PARTITIONED BY (`{RUN_KEY}`) LOCATION '{location}'"
        )
        self.spark.catalog.recoverPartitions(self._name(table))

    def open_stored(self, table: str) -> bool:
        """Register a table whose columns only its files know; False when there is none yet."""
        try:
            stored = self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException:
            return False
        self.open(table, StructType([f for f in stored.schema.fields if f.name != RUN_KEY]))
        return True

    # -- append ------------------------------------------------------------------

    def append(self, table: str, rows: DataFrame, constants: dict[str, Any] | None = None, run_id: str | None = None) -> str:
        """Append rows under a run stamp, constants repeated; types must fit the table."""
        stamp = run_id or new_stamp()
        if not re.fullmatch(STAMP_CHARACTERS, stamp, re.ASCII):
            raise ValueError(f"run stamp {stamp!r} cannot name a folder")
        self.append_runs(table, profile_rows(rows, constants, stamp))
        return stamp

    def append_runs(self, table: str, rows: DataFrame) -> None:
        """Append rows of several runs, told apart by their stamp column; a stamp that cannot name a folder fails."""
        full = rows.select(RUN_KEY, *[c for c in rows.columns if c != RUN_KEY])
        body = full.drop(RUN_KEY)
        self.open(table, body.schema)
        require_same_schema(self.read(table), full)
        bad = F.raise_error(F.concat(F.lit("run stamp cannot name a folder: "), F.coalesce(RUN_KEY, F.lit("NULL")))).cast("string")
        stamp = F.when(F.col(RUN_KEY).rlike(f"^(?:{STAMP_CHARACTERS})$"), F.col(RUN_KEY)).otherwise(bad)
        full.select(*body.columns, stamp.alias(RUN_KEY)).write.insertInto(self._name(table))

    def add_run(self, config: NetConfig, run_id: str, train_size: int, test_size: int) -> None:
        """One configuration row."""
        row = (config.structure(), config.cost, config.obj_name, train_size, test_size, config.batch, config.alpha, config.momentum)
        self.append("meta_ann", self.spark.createDataFrame([row], META).coalesce(1), run_id=run_id)

    def add_costs(self, run_id: str, rows: Sequence[dict]) -> None:
        """Per-epoch cost rows of a run."""
        self.add_costs_of({run_id: rows})

    def add_costs_of(self, rows: dict[str, Sequence[dict]]) -> None:
        """Per-epoch cost rows of several runs, in one append."""
        stamped = [(*(row[f.name] for f in COSTS.fields), run) for run, those in rows.items() for row in those]
        schema = StructType([*COSTS.fields, StructField(RUN_KEY, StringType())])
        self.append_runs("profile_cost_ann", self.spark.createDataFrame(stamped, schema).coalesce(1))

    def add_inputs(self, dataset: DataFrame, run_id: str, width: int, id_col: str = "id", data: str = "data") -> None:
        """Feature columns with a 1-based position."""
        placed = row_index(dataset.select(id_col, data), [id_col], "idx", start=1)
        self.append("input_data_ann", placed.select("idx", *arrays.spread(arrays.doubles(F.col(data)), "x", width)), run_id=run_id)

    def add_outputs(
        self, scored: DataFrame, run_id: str, epoch: int, batch: int, width: int, id_col: str = "id", y: str = "y"
    ) -> None:
        """Output columns of one (epoch, batch) with the same 1-based position."""
        placed = row_index(scored.select(id_col, y), [id_col], "idx", start=1)
        when = [F.lit(epoch).cast("long").alias("epoch"), F.lit(batch).cast("long").alias("batch")]
        self.append("output_data_ann", placed.select("idx", *when, *arrays.spread(F.col(y), "y", width)), run_id=run_id)

    def add_details(self, detail: DataFrame, wrong: DataFrame, run_id: str) -> None:
        """Ranked class probabilities of an evaluation, and its misclassified images."""
        ranked = detail.withColumn("index", F.col("index").cast("long")).withColumn("is_correct", F.col("is_correct").cast("long"))
        self.append("eval_out_prob", ranked, run_id=run_id)
        self.append("wrong_img", wrong, run_id=run_id)

    # -- delete and change -------------------------------------------------------

    def _runs(self, table: str) -> DataFrame:
        """The run stamps of a table, from its partitions; stamps of other writers may be escaped there."""
        parts = self.spark.sql(f"SHOW PARTITIONS {self._name(table)}")
        written = F.regexp_extract("partition", "^[^=]*=(.*)$", 1)
        return parts.select(F.url_decode(F.replace(written, F.lit("+"), F.lit("%2B"))).alias(RUN_KEY))

    def _drop_runs(self, table: str, stamps: Sequence[str]) -> None:
        """Forget the partitions of all these runs in one statement, then remove their files.

        In this order a reader never finds a partition without its files, and a removal that was cut
        short leaves files that the next one of the run clears.
        """
        if not stamps:
            return
        literals = [s.replace("\\", "\\\\").replace("'", "\\'") for s in stamps]
        specs = ", ".join(f"PARTITION (`{RUN_KEY}` = '{s}')" for s in literals)
        self.spark.sql(f"ALTER TABLE {self._name(table)} DROP IF EXISTS {specs}")
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = set(stamps)
        for found in files.listStatus(root):
            folder = found.getPath().getName()
            if folder.startswith(f"{RUN_KEY}=") and unquote(folder[len(RUN_KEY) + 1 :]) in gone:
                files.delete(found.getPath(), True)
        self.spark.catalog.refreshTable(self._name(table))

    def delete_where(self, table: str, names: str | Sequence[str], values: Any) -> int:
        """Remove matching rows; only runs that hold some are rewritten. Returns the number removed.

        A run left without rows loses its partition. Unknown columns raise first.
        """
        have = self.read(table)
        kept = delete_where(have, names, values)
        names = [names] if isinstance(names, str) else list(names)
        values = list(values) if isinstance(values, (list, tuple)) else [values]
        gone = F.count(F.when(equals_all(dict(zip(names, values))), 1)).alias("gone")
        # One row per touched run: as many as the store has partitions.
        touched = have.groupBy(RUN_KEY).agg(gone, F.count(F.lit(1)).alias("n")).where("gone > 0").collect()
        partly = [r[RUN_KEY] for r in touched if r["gone"] < r["n"]]
        if partly:
            # Only a path write honours the per-write dynamic mode; the other runs stay as they are.
            rewritten = cut_lineage(kept.where(F.col(RUN_KEY).isin(partly)))
            writer = rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(RUN_KEY).parquet(f"{self.root}/{table}")
            self.spark.catalog.refreshTable(self._name(table))
        self._drop_runs(table, [r[RUN_KEY] for r in touched if r["gone"] == r["n"]])
        return sum(r["gone"] for r in touched)

    def delete_last_runs(self, *tables: str, num_run: int = 1) -> list[str]:
        """Drop the last runs, over the named or all tables; only partitions are touched."""
        chosen = list(tables) or self.list_tables()
        stamps = [r[RUN_KEY] for r in last_runs([self._runs(t) for t in chosen], num_run)]
        for table in chosen:
            have = {r[RUN_KEY] for r in self._runs(table).where(F.col(RUN_KEY).isin(stamps)).collect()}
            self._drop_runs(table, sorted(have))
            left = self._runs(table).where(F.col(RUN_KEY).isin(stamps)).count()
            if left:
                raise RuntimeError(f"{left} of the runs {sorted(stamps)} are still in {table}")
        return sorted(stamps)

    def _replace(self, table: str, df: DataFrame) -> None:
        """Rewrite a table whose columns change.

        The new rows are written beside the table first; should the rewrite fail half-way,
        they are complete there.
        """
        beside = f"{self.root}/_rewrite/{table}"
        df.write.mode("overwrite").partitionBy(RUN_KEY).parquet(beside)
        columns = StructType([*[f for f in df.schema.fields if f.name != RUN_KEY], StructField(RUN_KEY, StringType())])
        body = self.spark.read.schema(columns).parquet(beside)
        self.spark.sql(f"DROP TABLE {self._name(table)}")
        body.write.mode("overwrite").partitionBy(RUN_KEY).parquet(f"{self.root}/{table}")
        self.open(table, body.drop(RUN_KEY).schema)

    def add_col(self, table: str, name: str, dtype: str, f, *dependencies: str) -> None:
        self._replace(table, add_col(self.read(table), name, dtype, f, *dependencies))

    def drop_col(self, table: str, *names: str) -> None:
        self._replace(table, drop_col(self.read(table), *names))

    def normalize_col(self, table: str, col: str, group_by: str) -> None:
        require_columns(self.read(table), [col, group_by])
        self._replace(table, normalize_col(self.read(table), col, group_by))
