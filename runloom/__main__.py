"""Command line: train, sweep, grid, evaluate, add-data, analyze, delete-last, stages.

The session is taken as configured: run it where Spark's defaults point at the cluster.
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.operators import control, reports
from runloom.operators.dataset import write_parts
from runloom.operators.records import new_stamp
from runloom.operators.scans import row_index
from runloom.plans.checkpoints import load_model
from runloom.plans.network import NetConfig
from runloom.plans.profile_store import COSTS, META, ProfileStore
from runloom.plans.score import evaluate_details, predict, score
from runloom.plans.sweeps import configurations, sweep_table
from runloom.plans.training import fit, fit_many
from runloom.sources import event_log, sets

TABLES = {"meta_ann": META, "profile_cost_ann": COSTS}


def read_config(path: str) -> NetConfig:
    """A model file: JSON, or YAML where a parser is installed."""
    with open(path) as f:
        if path.endswith(".json"):
            return NetConfig.from_dict(json.load(f))
        try:
            import yaml
        except ImportError as e:
            raise SystemExit("reading YAML needs a YAML parser; store the model file as JSON") from e
        return NetConfig.from_dict(yaml.safe_load(f))


def load_splits(spark: SparkSession, config: NetConfig) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The three splits of a configuration, and the names of their columns."""
    if config.data_format == "npz":
        frames, _ = sets.load_npz(spark, config.data_dir)
        return frames, {"id_col": "row", "target": "target"}
    frames, _ = sets.load_parquet(spark, config.data_dir)
    return frames, {"id_col": "id", "target": "target" if "target" in frames["train"].columns else "label"}


def open_store(spark: SparkSession, path: str) -> ProfileStore:
    store = ProfileStore(spark, path)
    for name, schema in TABLES.items():
        store.open(name, schema)
    for name in ("input_data_ann", "output_data_ann"):
        store.open_stored(name)
    return store


def train(spark: SparkSession, args) -> None:
    config = read_config(args.model)
    start = load_model(spark, args.checkpoint, args.resume, config) if args.resume else None
    frames, columns = load_splits(spark, config)
    run = fit(
        frames["train"], frames["valid"], frames["test"], config, start=start, model_path=args.checkpoint,
        store=open_store(spark, args.store), run_id=args.run, **columns,
    )
    print(f"{run.run_id}: test cost {run.test[0]:.4f}, accuracy {run.test[1]:.3f}")


def sweep(spark: SparkSession, args) -> None:
    """Every model file of a folder; files on the same data are trained in one go."""
    names = sorted(f for f in os.listdir(args.folder) if f.endswith((".json", ".yaml", ".yml")))
    configs = {i: read_config(os.path.join(args.folder, f)) for i, f in enumerate(names)}
    stamp, store = new_stamp(), open_store(spark, args.store)
    by_data: dict[tuple[str, str], dict[int, NetConfig]] = {}
    for i, conf in configs.items():
        by_data.setdefault((conf.data_format, conf.data_dir), {})[i] = conf
    for group in by_data.values():
        frames, columns = load_splits(spark, next(iter(group.values())))
        ids = {i: f"{stamp}-{names[i].rsplit('.', 1)[0]}" for i in group}
        runs = fit_many(
            frames["train"], frames["valid"], frames["test"], group, run_ids=ids, store=store,
            model_path=args.checkpoint, **columns,
        )
        for i, run in runs.items():
            print(f"{names[i]}: test cost {run.test[0]:.4f}, accuracy {run.test[1]:.3f}")


def grid(spark: SparkSession, args) -> None:
    """Every combination of rates, momenta, batch sizes and structures on every data set, from a base model file."""
    base = read_config(args.model)
    datasets = spark.createDataFrame([(d,) for d in args.data], "data string")
    table = sweep_table(datasets, args.rates, args.momenta, args.batches, args.structures)
    runs = list(enumerate(configurations(table, base)))
    stamp, store = new_stamp(), open_store(spark, args.store)
    for folder in args.data:
        group = {i: replace(conf, data_dir=folder) for i, (row, conf) in runs if row["data"] == folder}
        frames, columns = load_splits(spark, next(iter(group.values())))
        ids = {i: f"{stamp}-{i}" for i in group}
        found = fit_many(
            frames["train"], frames["valid"], frames["test"], group, run_ids=ids, store=store,
            model_path=args.checkpoint, **columns,
        )
        for i, run in found.items():
            row = runs[i][1][0]
            print(f"{run.run_id} {folder} {row['struct']} rate {row['learn_rate']} momentum {row['momentum']} batch {row['batch_size']}: test cost {run.test[0]:.4f}")


def add_data(spark: SparkSession, args) -> None:
    """The inputs of a split, and a stored model's outputs for it, as tables of a run."""
    net, store = load_model(spark, args.checkpoint, args.run), open_store(spark, args.store)
    frames, columns = load_splits(spark, replace(net.config, data_format=args.kind, data_dir=args.data))
    rows, id_col = frames[args.split], columns["id_col"]
    layers = net.config.walk()
    width = net.config.input_num_channels * (net.config.input_image_size_y * net.config.input_image_size_x if net.config.image() else 1)
    last = layers[-1][0].num_channels * (layers[-1][2][0] * layers[-1][2][1] if layers[-1][2] else 1)
    store.add_inputs(rows, args.run, width, id_col)
    store.add_outputs(score(rows, net, id_col), args.run, net.epoch, net.batch, last, id_col)


def publish(rows: DataFrame, path: str) -> None:
    """Write the whole result, then say how many rows lie where, and show its beginning."""
    rows.write.mode("overwrite").csv(path, header=True)
    written = rows.sparkSession.read.csv(path, header=True)
    written.show(truncate=False)
    print(f"{written.count()} rows in {path}")


def delete_last(spark: SparkSession, args) -> None:
    """Remove the last runs from the store's tables."""
    store = open_store(spark, args.store)
    print("removed:", *store.delete_last_runs(*args.tables, num_run=args.runs))


def evaluate(spark: SparkSession, args) -> None:
    """Report per set with a TOTAL row, or predictions for raw images.

    A folder must hold files of one type, which must be the kind asked for; raw images have none.
    """
    net = load_model(spark, args.checkpoint, args.run)
    names = [f for f in os.listdir(args.data) if os.path.isfile(os.path.join(args.data, f))] if os.path.isdir(args.data) else []
    names = [f for f in names if not f.startswith(("_", "."))]
    if names and args.kind != "images" and sets.check_input_type(names) != args.kind:
        raise SystemExit(f"{args.data} holds other files than {args.kind}")
    if args.kind == "images":
        _, height, width = net.config.image()
        shown = predict(sets.image_ingest(spark, args.data, height, width), net, "name").orderBy("name")
    else:
        found = sets.npz_sets(spark, args.data) if args.kind == "npz" else sets.parquet_sets(spark, args.data)
        target = "target" if "target" in found.columns else "label"
        if args.details:
            order = "row" if args.kind == "npz" else "id"
            numbered = row_index(found, [order, F.xxhash64("set")], "entry")
            detail, wrong = evaluate_details(numbered, net, args.run, "entry", target=target)
            detail.write.mode("overwrite").parquet(f"{args.details.rstrip('/')}/probabilities")
            wrong.write.mode("overwrite").parquet(f"{args.details.rstrip('/')}/wrong")
        scored = score(found, net, "set", target=target, with_y=False)
        shown = reports.unweighted_total(reports.per_set(scored)) if args.unweighted else reports.eval_report(scored)
    publish(shown, args.out)


def analyze(spark: SparkSession, args) -> None:
    """Join run data with the studied variables, one output folder per fixed combination."""
    store = open_store(spark, args.store)
    meta, data = store.read("meta_ann"), store.read(args.table)
    if args.table == "output_data_ann":
        data = control.join_input_output(data, store.read("input_data_ann"))
    write_parts(control.control_dim(meta, data, *args.variables), args.out, "control_key", files_per_part=args.files)
    publish(control.control_catalogue(meta, data, *args.variables), f"{args.out.rstrip('/')}-catalogue")


def stages(spark: SparkSession, args) -> None:
    """Stage metrics of the event logs into the store; reports of applications, jobs and stages beside it."""
    store, events = ProfileStore(spark, args.store), event_log.read_events(spark, args.logs)
    rows = event_log.stage_rows(events, args.node_type)
    store.append("stage_metrics", rows.drop("populate_time"))
    reports_in = f"{args.store.rstrip('/')}/_reports"
    publish(event_log.app_summary(events), f"{reports_in}/applications")
    publish(event_log.job_summary(events), f"{reports_in}/jobs")
    publish(rows.groupBy("app_name").agg(F.count(F.lit(1)).alias("stages")), f"{reports_in}/stages")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="runloom")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, job, *arguments):
        sub = commands.add_parser(name, help=job.__doc__)
        for flags, options in arguments:
            sub.add_argument(*flags, **options)
        sub.set_defaults(job=job)

    store = (("--store",), {"default": "profile_data"})
    checkpoint = (("--checkpoint",), {"default": "checkpoint"})
    command("train", train, (("model",), {}), store, checkpoint, (("--run",), {}), (("--resume",), {"help": "run to resume"}))
    command("sweep", sweep, (("folder",), {}), store, checkpoint)
    several = lambda kind, **more: {"type": kind, "nargs": "+", "required": True, **more}
    command(
        "grid", grid, (("model",), {"help": "base model file"}), (("--data",), several(str, help="folders of splits")), (("--rates",), several(float)),
        (("--momenta",), several(float)), (("--batches",), several(int)), (("--structures",), several(str, help="such as 30sig-10softmax")), store, checkpoint,
    )
    command(
        "add-data", add_data, (("checkpoint",), {}), (("run",), {}), (("data",), {}), (("--split",), {"choices": ["train", "valid", "test"], "default": "test"}),
        (("--kind",), {"choices": ["parquet", "npz"], "default": "parquet"}), store,
    )
    command(
        "evaluate", evaluate, (("checkpoint",), {}), (("run",), {}), (("data",), {}), (("--out",), {"default": "evaluation"}),
        (("--kind",), {"choices": ["parquet", "npz", "images"], "default": "parquet"}),
        (("--unweighted",), {"action": "store_true", "help": "plain mean over sets"}),
        (("--details",), {"help": "folder for ranked probabilities and wrong images"}),
    )
    command(
        "analyze", analyze, store, (("-t", "--table"), {"default": "profile_cost_ann"}), (("--out",), {"required": True}),
        (("--files",), {"type": int, "default": 1, "help": "files of a combination"}), (("variables",), {"nargs": "+"}),
    )
    command("delete-last", delete_last, store, (("--runs",), {"type": int, "default": 1}), (("tables",), {"nargs": "*"}))
    command("stages", stages, (("logs",), {}), store, (("--node-type",), {"default": ""}))
    args = parser.parse_args(argv)
    args.job(SparkSession.builder.appName("runloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
