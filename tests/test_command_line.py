"""The commands end to end on a small data set."""

import json

import numpy as np
import pytest

from runloom.__main__ import main


def model(path, alpha, data_dir):
    conf = {
        "obj_name": "tiny", "epoch": 2, "batch": 10, "data_format": "npz", "data_dir": str(data_dir), "momentum": 0.9,
        "alpha": alpha, "cost": "CE", "shuffle": True, "input_num_channels": 1, "input_image_size_y": 4, "input_image_size_x": 4,
        "network": [
            {"name": "c", "type": "CONVOLUTION", "num_channels": 2, "kernel_size": 3, "stride": 1, "padding": 1, "init_wt": 0.3},
            {"name": "p", "type": "MAXPOOL", "num_channels": 2, "kernel_size": 2, "stride": 2, "padding": 0},
            {"name": "o", "type": "FC_SOFTMAX", "num_channels": 3, "init_wt": 0.3},
        ],
    }
    path.write_text(json.dumps(conf))


def test_train_evaluate_analyze(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    rng = np.random.RandomState(0)
    for name, n in (("train", 30), ("valid", 12), ("test", 12)):
        labels = rng.randint(0, 3, n)
        np.savez(data / f"{name}.npz", data=rng.randn(n, 1, 4, 4) + labels[:, None, None, None] * 2.0, target=np.eye(3)[labels])
    models = tmp_path / "models"
    models.mkdir()
    model(models / "a.json", 0.02, data)
    model(models / "b.json", 0.05, data)
    places = ["--store", str(tmp_path / "store"), "--checkpoint", str(tmp_path / "model")]
    main(["train", str(models / "a.json"), "--run", "first", *places])
    main(["train", str(models / "a.json"), "--run", "second", "--resume", "first", *places])
    main(["sweep", str(models), *places])
    out = capsys.readouterr().out
    assert "first: test cost" in out and "b.json: test cost" in out

    main(["analyze", "learn_rate", "--store", str(tmp_path / "store"), "--out", str(tmp_path / "control")])
    joined = spark.read.parquet(str(tmp_path / "control"))
    assert joined.count() == 8 and {r["learn_rate"] for r in joined.collect()} == {0.02, 0.05}

    main(["evaluate", str(tmp_path / "model"), "first", str(data / "*.npz"), "--kind", "npz", "--out", str(tmp_path / "report")])
    rows = spark.read.csv(str(tmp_path / "report"), header=True, inferSchema=True).collect()
    assert {r["file"]: r["num_entries"] for r in rows} == {"train.npz": 30, "valid.npz": 12, "test.npz": 12, "TOTAL": 54}

    main(["evaluate", str(tmp_path / "model"), "first", str(data), "--kind", "npz", "--unweighted", "--out", str(tmp_path / "plain")])
    assert spark.read.csv(str(tmp_path / "plain"), header=True, inferSchema=True).first()["num_entries"] == 54
    with pytest.raises(SystemExit):
        main(["evaluate", str(tmp_path / "model"), "first", str(data), "--kind", "parquet", "--out", str(tmp_path / "none")])
    capsys.readouterr()
    main(["delete-last", "--store", str(tmp_path / "store"), "--runs", "1"])
    assert capsys.readouterr().out.startswith("removed: ")


def test_grid_details_and_data(spark, tmp_path, capsys):
    rng = np.random.RandomState(1)
    folders = []
    for d in ("one", "two"):
        folders.append(tmp_path / d)
        folders[-1].mkdir()
        for name, n in (("train", 20), ("valid", 8), ("test", 9)):
            labels = rng.randint(0, 3, n)
            np.savez(folders[-1] / f"{name}.npz", data=rng.randn(n, 5, 1, 1) + labels[:, None, None, None], target=np.eye(3)[labels])
    base = {
        "obj_name": "base", "epoch": 1, "batch": 10, "data_format": "npz", "data_dir": "", "momentum": 0.0, "alpha": 0.1, "cost": "CE",
        "shuffle": True, "input_num_channels": 5, "network": [{"type": "FC_SIG", "num_channels": 1, "init_wt": 0.3}, {"type": "FC_SOFTMAX", "num_channels": 3, "init_wt": 0.1}],
    }
    (tmp_path / "base.json").write_text(json.dumps(base))
    store, models = str(tmp_path / "store"), str(tmp_path / "models")
    places = ["--store", store, "--checkpoint", models]
    options = ["--data", *map(str, folders), "--rates", "0.1", "0.2", "--momenta", "0.9", "--batches", "10", "--structures", "4sig-3softmax", "3softmax"]
    main(["grid", str(tmp_path / "base.json"), *options, *places])
    lines = [line.split() for line in capsys.readouterr().out.splitlines() if "test cost" in line]
    assert len(lines) == 8 and {(r[1], r[2], r[4]) for r in lines} == {(str(f), s, a) for f in folders for s in ("4sig-3softmax", "3softmax") for a in ("0.1", "0.2")}
    costs = spark.read.parquet(f"{store}/profile_cost_ann")
    assert costs.count() == 8

    run = [r[0] for r in lines if r[1] == str(folders[0])][0]
    main(["evaluate", models, run, str(folders[0] / "test.npz"), "--kind", "npz", "--out", str(tmp_path / "report"), "--details", str(tmp_path / "details")])
    detail = spark.read.parquet(str(tmp_path / "details/probabilities")).orderBy("index").toPandas()
    assert detail["index"].tolist() == list(range(9)) and detail["is_correct"].is_monotonic_increasing
    assert spark.read.parquet(str(tmp_path / "details/wrong")).count() == (detail["is_correct"] == 0).sum()

    main(["add-data", models, run, str(folders[0]), "--kind", "npz", "--store", store])
    inputs, outputs = (spark.read.parquet(f"{store}/{n}_data_ann") for n in ("input", "output"))
    assert inputs.count() == outputs.count() == 9 and {"x0", "x4"} <= set(inputs.columns) and "y2" in outputs.columns
