"""Queries that go through the profile store's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.contract.base import CLASSES, double_images, flat_net, images, query, rounded, table
from runloom.contract.files import _store
from runloom.contract.models import ALPHA, COSTS, FLAT, MOMENTUM, _costs_sql, _in_order, _training_sql
from runloom.operators.records import RUN_KEY
from runloom.plans.profile_store import ProfileStore
from runloom.plans.score import score
from runloom.plans.training import fit
from runloom.session import cut_lineage

STAMP = "2024.01.01-00.00.00"


@query(
    "s8_store_run",
    f"""SELECT '{STAMP}' AS populate_time, '64FC_LIN-10FC_SOFTMAX' AS struct, 'CE' AS cost_type, 'closed_form' AS train_func, count(*) AS train_size,
count(*) AS test_size, CAST(100 AS BIGINT) AS batch_size, 0.02::DOUBLE AS learn_rate, 0.9::DOUBLE AS momentum FROM embeddings""",
)
def _(spark, sf):
    store, rows = _store(spark), images(spark, sf).count()
    store.add_run(flat_net(batch=100, alpha=0.02, momentum=0.9).config, STAMP, rows, rows)
    return store.read("meta_ann")


@query(
    "s9_store_inputs",
    f"SELECT '{STAMP}' AS populate_time, row_number() OVER (ORDER BY vec_id) AS idx, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64))
    + " FROM embeddings",
)
def _(spark, sf):
    store = _store(spark)
    store.add_inputs(double_images(spark, sf), STAMP, 64)
    return store.read("input_data_ann")


@query("s10_store_fit_costs", _training_sql({"r": (ALPHA, MOMENTUM, 2, 2)}, _costs_sql("r", 2, 2, f"'{STAMP}' AS populate_time, ")))
def _(spark, sf):
    """The costs that training itself writes."""
    data, store = images(spark, sf), _store(spark)
    net = _in_order(data, 2, epoch=2, alpha=ALPHA, momentum=MOMENTUM)
    fit(data, data, None, net.config, start=net, store=store, run_id=STAMP)
    return rounded(store.read("profile_cost_ann"), *COSTS)


@query(
    "s11_store_outputs",
    f"""WITH {FLAT} SELECT '{STAMP}' AS populate_time, dense_rank() OVER (ORDER BY id) AS idx, CAST(1 AS BIGINT) AS epoch, CAST(5 AS BIGINT) AS batch,
{", ".join(f"round(max(CASE WHEN j = {i} THEN y END), 6) AS y{i}" for i in range(CLASSES))} FROM p GROUP BY id""",
)
def _(spark, sf):
    store = _store(spark)
    store.add_outputs(cut_lineage(score(images(spark, sf), flat_net(), "id")), STAMP, 1, 5, CLASSES)
    return rounded(store.read("output_data_ann"), *[f"y{i}" for i in range(CLASSES)])


@query(
    "s19_store_catalogue",
    "SELECT 'profile_' || t AS table_name, n AS num_rows FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'part', count(*) FROM part)",
)
def _(spark, sf):
    store = _store(spark)
    for name in ("nation", "part"):
        store.append(f"profile_{name}", table(spark, sf, name), run_id=STAMP)
    store.append("other", table(spark, sf, "region"), run_id=STAMP)
    return spark.createDataFrame([(t, store.count_rows(t)) for t in store.list_tables("profile_")], "table_name string, num_rows long")


@query(
    "p6_store_delete_last_runs",
    """WITH s AS (SELECT event_type || ':' || (event_id % 3) AS populate_time, event_id, value FROM events)
SELECT populate_time, event_id, value FROM s WHERE populate_time NOT IN (SELECT DISTINCT populate_time FROM s ORDER BY 1 DESC LIMIT 2)""",
)
def _(spark, sf):
    """Runs of another writer, whose stamps are escaped in folder names."""
    store: ProfileStore = _store(spark)
    stamp = F.concat("event_type", F.lit(":"), F.col("event_id") % 3).alias(RUN_KEY)
    table(spark, sf, "events").select("event_id", "value", stamp).write.partitionBy(RUN_KEY).parquet(f"{store.root}/runs")
    store.open_stored("runs")
    store.delete_last_runs("runs", num_run=2)
    return store.read("runs")
