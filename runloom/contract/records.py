"""Profile-table operators on the relational tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from runloom.contract.base import query, rounded, table
from runloom.functions import text
from runloom.operators import control, dataset, records, sets, stages
from runloom.operators.scans import row_index
from runloom.session import shared_path

STAMP = "2024.01.01-00.00.00"


@query("s7_profile_append", f"SELECT '{STAMP}' AS populate_time, 3 AS epoch, 'sgd' AS method, event_id, value FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return records.profile_rows(rows, {"epoch": 3, "method": "sgd"}, STAMP)


def _meta_data(spark, sf) -> tuple[DataFrame, DataFrame]:
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), "o_orderstatus", "o_orderpriority")
    data = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    return meta, data


CONTROL_KEY = "'o_orderpriority=' || o_orderpriority"


@query(
    "j1_control_dim",
    f"""SELECT {CONTROL_KEY} AS control_key, o_orderstatus, l_orderkey AS run, l_linenumber, l_quantity,
       l_extendedprice, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    return control.control_dim(*_meta_data(spark, sf), "o_orderstatus", keys=["run"])


@query(
    "j1_control_catalogue",
    f"""SELECT {CONTROL_KEY} AS control_key, count(*) AS num_runs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS num_rows
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(spark, sf):
    return control.control_catalogue(*_meta_data(spark, sf), "o_orderstatus", keys=["run"])


@query(
    "s12_control_tables",
    f"""SELECT {CONTROL_KEY} AS control_key, count(*) AS num_rows, sum(l_quantity) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(spark, sf):
    path = shared_path(spark, "control")
    dataset.write_parts(control.control_dim(*_meta_data(spark, sf), "o_orderstatus", keys=["run"]), path, "control_key")
    written = spark.read.parquet(path).groupBy("control_key")
    return written.agg(F.count(F.lit(1)).alias("num_rows"), F.sum("l_quantity").alias("quantity"))


@query(
    "j2_join_input_output",
    """SELECT n_chars, lang, documents.doc_id AS doc_id, quality, toxic
FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
)
def _(spark, sf):
    inputs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return control.join_input_output(table(spark, sf, "labels"), inputs, keys=["doc_id"])


@query(
    "j3_category_lookup",
    """SELECT c_custkey, 'NATION_' || c_nationkey AS category, n_nationkey AS category_index
FROM customer JOIN nation ON n_name = 'NATION_' || c_nationkey""",
)
def _(spark, sf):
    named = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("category")
    )
    lookup = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("category_index"))
    return control.category_lookup(named, "category", lookup, "n_name", "category_index")


GRID = {"learn_rate": [0.1, 0.02], "momentum": [0.5, 0.9], "batch_size": [10, 100], "struct": ["15sig-1lin", "30sig-1lin"]}


@query(
    "j5_config_grid",
    """SELECT s_name AS data, learn_rate, momentum, batch_size, struct FROM supplier,
(VALUES (0.1::DOUBLE), (0.02::DOUBLE)) a(learn_rate), (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) b(momentum),
(VALUES (10), (100)) c(batch_size), (VALUES ('15sig-1lin'), ('30sig-1lin')) d(struct)""",
)
def _(spark, sf):
    return control.config_grid(table(spark, sf, "supplier").select(F.col("s_name").alias("data")), GRID)


@query("j7_keep_matching", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sets.keep_matching(table(spark, sf, "customer").select("c_custkey", "c_name"), buyers, ["c_custkey"])


@query("j7_drop_matching", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return sets.drop_matching(table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("j7_matching_hot", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN (SELECT min(l_returnflag) FROM lineitem)")
def _(spark, sf):
    """Three keys hold everything: each is spread over salts."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sets.keep_matching(lines, lines.agg(F.min("l_returnflag").alias("l_returnflag")), ["l_returnflag"])


@query(
    "j1_control_hot",
    """SELECT 'size=' || length(l_returnflag) AS control_key, ascii(l_returnflag) AS rate, l_returnflag AS run, l_orderkey, l_linenumber, l_quantity
FROM lineitem""",
)
def _(spark, sf):
    """Three runs hold all data rows: each is spread over salts."""
    data = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), "l_orderkey", "l_linenumber", "l_quantity")
    meta = data.select("run").distinct().select("run", F.ascii("run").alias("rate"), F.length("run").alias("size"))
    return control.control_dim(meta, data, "rate", keys=["run"])


@query(
    "s13_export_lines",
    """SELECT user_id || ', ' || event_type AS line FROM events GROUP BY user_id, event_type ORDER BY min(ts), user_id, event_type""",
)
def _(spark, sf):
    return records.export_lines(table(spark, sf, "events"), "ts", "user_id", "event_type")


@query(
    "s13_export_to_text",
    """SELECT o_orderstatus || ', ' || o_orderpriority AS line FROM orders GROUP BY o_orderstatus, o_orderpriority""",
)
def _(spark, sf):
    path = shared_path(spark, "export")
    records.export_to_text(table(spark, sf, "orders"), path, "o_orderdate", "o_orderstatus", "o_orderpriority")
    return spark.read.text(path).withColumnRenamed("value", "line")


COUNTED = ["customer", "nation", "orders", "part"]


@query(
    "s19_count_rows",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in COUNTED),
)
def _(spark, sf):
    files = spark.read.format("binaryFile").load(sf).select(text.base_name(F.col("path")).alias("f"))
    wanted = files.where(F.col("f").rlike("^(?:customer|nation|orders|part)"))
    names = sorted(r["f"].removesuffix(".parquet") for r in wanted.collect())
    counts = [table(spark, sf, n).agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(n).alias("table_name"), "num_rows") for n in names]
    return reduce(DataFrame.unionByName, counts)


@query("p1_load_columns", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    return records.load_columns(table(spark, sf, "customer"), ["c_custkey", "c_name"])


@query("o2_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100")
def _(spark, sf):
    return records.load_columns(table(spark, sf, "customer"), ["c_custkey", "c_acctbal"], 100, ["c_acctbal", "c_custkey"])


LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


@query(
    "p2_add_col",
    f"SELECT {', '.join(LINES)}, round(l_extendedprice * (1 - l_discount), 4) AS disc_price FROM lineitem",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINES)
    price = lambda p, d: F.round(p * (1 - d), 4)
    return records.add_col(lines, "disc_price", "double", price, "l_extendedprice", "l_discount")


@query(
    "x1_add_col_python",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, round(l_quantity * l_tax + 1, 4) AS taxed FROM lineitem",
)
def _(spark, sf):
    @F.pandas_udf("double")
    def taxed(quantity: pd.Series, tax: pd.Series) -> pd.Series:
        return quantity * tax + 1

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return rounded(records.add_col(lines, "taxed", "double", taxed, "l_quantity", "l_tax"), "taxed", digits=4)


@query("p3_drop_col", "SELECT * EXCLUDE (l_tax, l_shipdate, l_discount) FROM lineitem")
def _(spark, sf):
    return records.drop_col(table(spark, sf, "lineitem"), "l_tax", "l_shipdate", "l_discount", "no_such_column")


@query(
    "p4_equality_filter",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = lines.where(records.equals_all({"l_returnflag": "A", "l_linestatus": "F"}))
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "p5_delete_where",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F')""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return records.delete_where(lines, ["l_returnflag", "l_linestatus"], ["R", "F"])


def _stamped(spark, sf) -> dict[str, DataFrame]:
    day = lambda c: text.run_stamp(F.date_trunc("day", c)).alias(records.RUN_KEY)
    return {
        "events": table(spark, sf, "events").select(day(F.col("ts")), F.col("event_id").alias("id")),
        "orders": table(spark, sf, "orders").select(day(F.col("o_orderdate")), F.col("o_orderkey").alias("id")),
        "nation": table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")),
    }


STAMPED = """stamped AS (
  SELECT 'events' AS source, strftime(date_trunc('day', ts), '%Y.%m.%d-%H.%M.%S') AS populate_time, event_id AS id FROM events
  UNION ALL
  SELECT 'orders', strftime(date_trunc('day', o_orderdate), '%Y.%m.%d-%H.%M.%S'), o_orderkey FROM orders),
gone AS (SELECT DISTINCT populate_time FROM stamped ORDER BY populate_time DESC LIMIT 3)"""


@query(
    "p6_delete_last_runs",
    f"""WITH {STAMPED}
SELECT source, populate_time, id FROM stamped WHERE populate_time NOT IN (SELECT populate_time FROM gone)
UNION ALL SELECT 'nation', NULL, n_nationkey FROM nation""",
)
def _(spark, sf):
    kept = records.without_last_runs(_stamped(spark, sf), 3)
    labelled = [
        f.select(
            F.lit(n).alias("source"),
            F.col(records.RUN_KEY) if records.RUN_KEY in f.columns else F.lit(None).cast("string").alias(records.RUN_KEY),
            "id",
        )
        for n, f in kept.items()
    ]
    return reduce(DataFrame.unionByName, labelled)


@query("o3_last_runs", f"WITH {STAMPED} SELECT populate_time FROM gone")
def _(spark, sf):
    frames = _stamped(spark, sf)
    stamps = sets.union_distinct(*[f.select(records.RUN_KEY) for n, f in frames.items() if n != "nation"])
    return stamps.orderBy(F.desc(records.RUN_KEY)).limit(3)


@query(
    "w1_normalize_col",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
       l_quantity / nullif(max(l_quantity) OVER (PARTITION BY l_partkey), 0) AS l_quantity_norm FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return records.normalize_col(lines, "l_quantity", "l_partkey")


@query(
    "w1_normalize_hot",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
       l_quantity / nullif(max(l_quantity) OVER (PARTITION BY l_returnflag), 0) AS l_quantity_norm FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return records.normalize_col(lines, "l_quantity", "l_returnflag")


@query("a1_count", "SELECT count(*) AS num_rows FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("num_rows"))


@query("a2_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("a3_group_max", "SELECT l_suppkey, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top_price"))


METRIC_OF = {
    "click": "Duration",
    "error": "Scheduler_Delay",
    "purchase": "GC_Time",
    "signup": "Input_Size",
    "view": "Shuffle_Read_Size",
}
STAGE_SUMS = ",\n".join(
    f"round(sum(CASE WHEN event_type = '{e}' THEN value END), 2) AS \"{m}\"" for e, m in METRIC_OF.items()
)
MISSING = [m for m in stages.METRICS if m not in METRIC_OF.values()]


def _tasks(spark, sf) -> DataFrame:
    kinds = list(METRIC_OF.items())
    metric = reduce(lambda c, kv: c.when(F.col("event_type") == kv[0], kv[1]), kinds[1:], F.when(F.col("event_type") == kinds[0][0], kinds[0][1]))
    return table(spark, sf, "events").select(F.col("user_id").alias("stage_id"), metric.alias("metric"), "value")


@query(
    "a12_stage_sums",
    f"""SELECT user_id AS stage_id, {STAGE_SUMS}, {", ".join(f'CAST(NULL AS DOUBLE) AS "{m}"' for m in MISSING)}
FROM events GROUP BY user_id""",
)
def _(spark, sf):
    return rounded(stages.stage_sums(_tasks(spark, sf), ["stage_id"]), *stages.METRICS, digits=2)


@query(
    "a13_stage_median",
    "SELECT user_id AS stage_id, event_type AS metric, round(median(value), 4) AS median FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    tasks = table(spark, sf, "events").select(F.col("user_id").alias("stage_id"), F.col("event_type").alias("metric"), "value")
    return rounded(stages.exact_median(tasks, ["stage_id", "metric"], "value"), "median", digits=4)


@query("a13_median_hot", "SELECT event_type AS metric, round(median(value), 4) AS median FROM events GROUP BY 1")
def _(spark, sf):
    tasks = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    return rounded(stages.exact_median(tasks, ["metric"], "value"), "median", digits=4)


@query("o1_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")


def _keyed(spark, sf, name: str, prefix: str) -> DataFrame:
    return table(spark, sf, name).select(F.col(f"{prefix}_{'cust' if prefix == 'c' else 'supp'}key").alias("id"), F.col(f"{prefix}_name").alias("name"))


BOTH = """src AS (SELECT 0 AS src_no, c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)"""


@query(
    "u1_concat_shuffle",
    f"""WITH {BOTH} SELECT id, name, row_number() OVER (ORDER BY (id * 48271 + 17) % 2147483647, src_no, id) - 1 AS idx FROM src""",
)
def _(spark, sf):
    key = (F.col("id") * 48271 + 17) % 2147483647
    frames = [_keyed(spark, sf, "customer", "c"), _keyed(spark, sf, "supplier", "s")]
    return dataset.concat_shuffle(*frames, sort_key=key)


@query(
    "u2_concat_ordered",
    f"WITH {BOTH} SELECT id, name, src_no, row_number() OVER (ORDER BY src_no, id) - 1 AS idx FROM src",
)
def _(spark, sf):
    return dataset.concat_ordered(_keyed(spark, sf, "customer", "c"), _keyed(spark, sf, "supplier", "s"), data=None)


def _nations(spark, sf, name: str, prefix: str) -> DataFrame:
    return table(spark, sf, name).select(F.col(f"{prefix}_nationkey").alias("nationkey"))


@query("u3_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return sets.union_distinct(_nations(spark, sf, "customer", "c"), _nations(spark, sf, "supplier", "s"))


@query("u4_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return sets.difference(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"))


@query(
    "u5_row_differences",
    """WITH t AS (SELECT k, sum(a) AS a, sum(b) AS b FROM (
  SELECT c_custkey AS k, 1 AS a, 0 AS b FROM customer UNION ALL SELECT o_custkey, 0, 1 FROM orders) GROUP BY k)
SELECT count(*) FILTER (b = 0) AS only_left, count(*) FILTER (a = 0) AS only_right,
       count(*) FILTER (a > 1 OR b > 1) AS repeated FROM t""",
)
def _(spark, sf):
    return sets.row_differences(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("k")),
        table(spark, sf, "orders").select(F.col("o_custkey").alias("k")),
    )


@query("w3_row_index", "SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def _(spark, sf):
    return row_index(table(spark, sf, "events").select("event_id", "value"), ["event_id"])


@query("w3_row_index_by_time", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events")
def _(spark, sf):
    return row_index(table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), ["ts", "event_id"]).select("event_id", "idx")


@query(
    "w3_row_index_by_value",
    "SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS idx FROM events",
)
def _(spark, sf):
    return row_index(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"], start=1)


@query(
    "p10_stride_slice",
    "SELECT event_id, idx FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events) WHERE idx >= 5 AND (idx - 5) % 7 = 0",
)
def _(spark, sf):
    return dataset.stride_slice(row_index(table(spark, sf, "events").select("event_id"), ["event_id"]), 5, None, 7)
