"""Names, units, stamps, structure strings; streaming copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from runloom.contract.base import images, query, rounded, table
from runloom.functions import text
from runloom.operators.configs import validate_configs
from runloom.session import shared_path
from runloom.streaming.mirror import mirror, mirrored, running_best

# -- structure strings and configurations ------------------------------------------------


def _networks(spark, sf) -> DataFrame:
    layer = lambda n, t: F.struct(n.alias("num_channels"), F.lit(t).alias("type"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("n"))
    network = F.array(layer(F.col("n"), "FC_SIG"), layer(F.col("n") * 2, "FC_SIG"), layer(F.lit(10), "FC_SOFTMAX"))
    return parts.select("p_partkey", text.structure_string(F.lit(64), network).alias("struct"))


@query(
    "f15_structure_string",
    "SELECT p_partkey, '64FC_LIN-' || p_size || 'FC_SIG-' || p_size * 2 || 'FC_SIG-10FC_SOFTMAX' AS struct FROM part",
)
def _(spark, sf):
    return _networks(spark, sf)


@query(
    "f16_parse_structure",
    """SELECT p_partkey, pos, num_channels, type FROM (
  SELECT p_partkey, unnest([0, 1]) AS pos, unnest([p_size, 1]) AS num_channels, unnest(['sig', 'lin']) AS type FROM part)""",
)
def _(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("sig-1lin")).alias("s"))
    parsed = named.select("p_partkey", F.posexplode(text.parse_structure(F.col("s"))).alias("pos", "layer"))
    return parsed.select("p_partkey", "pos", "layer.*")


@query(
    "f14_validate_configs",
    """SELECT p_partkey, p_size + 10 AS size, (p_size + 10) % 2 = 0 AS valid,
CASE WHEN (p_size + 10) % 2 = 0 THEN (p_size + 10) // 2 - 2 END AS out_y,
CASE WHEN (p_size + 10) % 2 = 0 THEN (p_size + 10) // 2 - 2 END AS out_x FROM part""",
)
def _(spark, sf):
    layer = lambda t, k, s, p: F.struct(
        F.lit(t).alias("type"), F.lit(k).alias("kernel_size"), F.lit(s).alias("stride"), F.lit(p).alias("padding")
    )
    network = F.array(layer("CONVOLUTION", 3, 1, 1), layer("MAXPOOL", 2, 2, 0), layer("CONVOLUTION", 3, 1, 0))
    size = F.col("p_size") + 10
    configs = table(spark, sf, "part").select(
        "p_partkey", size.alias("size"), size.alias("input_image_size_y"), size.alias("input_image_size_x"), network.alias("network")
    )
    return validate_configs(configs).select("p_partkey", "size", "valid", "out_y", "out_x")


# -- names, units, stamps -----------------------------------------------------------------


@query(
    "f17_app_name",
    """SELECT o_orderkey, 'batch_eval' AS app_name, o_custkey AS data_size, o_orderkey % 16 AS num_partition, CAST(1 AS BIGINT) AS itr FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    name = F.format_string("batch_eval-dsize_%d-partition_%d-itr_1", F.col("o_custkey"), F.pmod("o_orderkey", F.lit(16)))
    return orders.select("o_orderkey", name.alias("name")).select("o_orderkey", *text.app_name_parts(F.col("name")))


@query(
    "f18_image_name",
    "SELECT vec_id AS id, CAST(vec_id AS INTEGER) AS img, 4 AS channel, label AS category FROM embeddings",
)
def _(spark, sf):
    name = F.format_string("img%d_channel4_category%d.png", F.col("id"), F.col("label"))
    return images(spark, sf).select("id", name.alias("name")).select("id", *text.image_name_parts(F.col("name")))


UNITS = {"click": "h", "error": "ms", "purchase": "KB", "signup": "MB / 10", "view": "min"}
UNIT_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{u}'" for e, u in UNITS.items()) + " END"


def _measured(spark, sf) -> DataFrame:
    kinds = list(UNITS.items())
    unit = reduce(lambda c, kv: c.when(F.col("event_type") == kv[0], kv[1]), kinds[1:], F.when(F.col("event_type") == kinds[0][0], kinds[0][1]))
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" "), unit).alias("shown")
    )


@query(
    "f19_time_units",
    f"""SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 3600 WHEN 'error' THEN value * 0.001
WHEN 'view' THEN value * 60 END, 6) AS seconds, event_type NOT IN ('click', 'error', 'view') AS unchanged FROM events""",
)
def _(spark, sf):
    made = _measured(spark, sf)
    shown = made.select("event_id", text.in_seconds(F.col("shown")).alias("seconds"), (text.time_text(F.col("shown")) == F.col("shown")).alias("unchanged"))
    return rounded(shown, "seconds")


@query(
    "f20_size_units",
    f"""SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 3600 WHEN 'error' THEN value * 0.001
WHEN 'view' THEN value * 60 WHEN 'purchase' THEN value * 1000 ELSE value END, 6) AS number FROM events""",
)
def _(spark, sf):
    return rounded(_measured(spark, sf).select("event_id", text.magnitude(F.col("shown")).alias("number")), "number")


@query(
    "f21_run_stamp",
    """SELECT event_id, strftime(ts, '%Y.%m.%d-%H.%M.%S') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""",
)
def _(spark, sf):
    made = table(spark, sf, "events").select("event_id", text.run_stamp(F.col("ts")).alias("stamp"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return made.withColumn("seconds", F.timestamp_diff("SECOND", epoch, text.stamp_time(F.col("stamp"))))


@query(
    "f22_base_name",
    """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file, regexp_replace(url, '/[^/]*$', '') AS parent FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.base_name(F.col("url")).alias("file"), text.parent_dir(F.col("url")).alias("parent"))


@query(
    "f22_longest_name",
    "SELECT regexp_replace(url, '/[^/]*$', '') AS parent, CAST(max(length(regexp_extract(url, '([^/]*)$', 1))) AS INTEGER) AS longest FROM pages GROUP BY 1",
)
def _(spark, sf):
    by_parent = table(spark, sf, "pages").groupBy(text.parent_dir(F.col("url")).alias("parent"))
    return by_parent.agg(F.max(F.length(text.base_name(F.col("url")))).alias("longest"))


# -- streaming -------------------------------------------------------------------------------


@query("s18_mirror", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf):
    source = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    target = shared_path(spark, "mirror")
    mirror(spark, f"{sf}/events.parquet", source.schema, target, shared_path(spark, "mirror-state"))
    return mirrored(spark, target)


@query("s18_mirror_after_delete", "SELECT event_id, event_type, value FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def _(spark, sf):
    """The mirror follows a rewrite and a vanished part of its source."""
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    source, target, state = (shared_path(spark, n) for n in ("source", "mirror", "mirror-state"))
    events.write.partitionBy("event_type").parquet(source)
    mirror(spark, source, events.schema, target, state)
    first = events.agg(F.min("event_type")).first()[0]
    rest = events.where(F.col("event_type") != first)
    rest.write.mode("overwrite").partitionBy("event_type").parquet(source)
    mirror(spark, source, events.schema, target, state)
    return mirrored(spark, target)


@query(
    "s18_running_best",
    "SELECT conv_id AS run, max(length(text)) AS best FROM conversations GROUP BY conv_id",
)
def _(spark, sf):
    schema = table(spark, sf, "conversations").schema
    rows = lambda s: s.select(F.col("conv_id").alias("run"), F.length("text").cast("long").alias("metric"))
    return running_best(spark, f"{sf}/conversations.parquet", schema, shared_path(spark, "best"), prepare=rows)
