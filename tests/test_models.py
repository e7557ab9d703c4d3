"""Kernels, gradients, training, checkpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.functions import arrays
from runloom.operators import reports, sliding
from runloom.plans import gradients
from runloom.plans.checkpoints import load_model, save_model
from runloom.plans.kernels import ACTIVATIONS, Dense
from runloom.plans.network import Layer, NetConfig, Network
from runloom.plans.profile_store import ProfileStore
from runloom.plans.score import evaluate, evaluate_details, predict, score
from runloom.plans.tiles import relational_forward
from runloom.plans.sweeps import configurations, sweep_table
from runloom.plans.training import fit, fit_many, sgd_step, zero_velocity


def config(*layers, image=None, cost="CE", **conf):
    size = dict(zip(("input_num_channels", "input_image_size_y", "input_image_size_x"), image if isinstance(image, tuple) else (image,)))
    return NetConfig.from_dict({"obj_name": "t", "network": list(layers), "cost": cost, **size, **conf})


def fc(kind, n, wt=0.3):
    return {"type": kind, "num_channels": n, "init_wt": wt}


def conv(n, k, s=1, p=0, wt=0.5):
    return {"type": "CONVOLUTION", "num_channels": n, "kernel_size": k, "stride": s, "padding": p, "init_wt": wt}


def pool(n, k, s, p=0):
    return {"type": "MAXPOOL", "num_channels": n, "kernel_size": k, "stride": s, "padding": p}


NETS = {
    "dense": config(fc("FC_SIG", 5), fc("FC_LIN", 4), fc("FC_SOFTMAX", 3), image=12),
    "squared": config(fc("FC_SIG", 5), fc("FC_LIN", 3), image=12, cost="SQR"),
    "conv": config(conv(3, 3, 1, 1), pool(3, 2, 2), fc("FC_SOFTMAX", 3), image=(2, 4, 6)),
    "stride": config(conv(2, 3, 2, 1), conv(2, 2, 1, 0), fc("FC_SIG", 4), fc("FC_SOFTMAX", 3), image=(1, 7, 5)),
    "overlap": config(conv(2, 2, 1, 0), pool(2, 3, 1, 1), fc("FC_SOFTMAX", 3), image=(1, 5, 5)),
}


def sample(conf, rows=6, seed=1):
    rng = np.random.RandomState(seed)
    image = conf.image()
    width = int(np.prod(image)) if image else conf.input_num_channels
    return rng.randn(rows, width), rng.randint(0, conf.network[-1].num_channels, rows)


def frame(spark, x, labels, parts=3):
    rows = [(i, [float(v) for v in r], int(l)) for i, (r, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, data array<double>, label int").repartition(parts)


def cost_of(net, x, t):
    return float(net.row_cost(net.forward(x)[-1], t).sum()) / len(x)


@pytest.mark.parametrize("name", NETS)
def test_gradients_by_finite_differences(name):
    conf = NETS[name]
    net = Network.initial(conf, seed=3)
    net.biases = [np.random.RandomState(5).randn(*b.shape) * 0.2 for b in net.biases]
    x, labels = sample(conf)
    t = np.eye(conf.network[-1].num_channels)[labels]
    grads = net.gradients(net.forward(x), t, len(x))
    for n, (dw, db) in enumerate(grads):
        if dw is None:
            continue
        for values, g in ((net.weights[n], dw), (net.biases[n], db)):
            assert g.shape == values.shape
            for at in list(np.ndindex(values.shape))[::3]:
                keep, e = values[at], 1e-6
                values[at] = keep + e
                up = cost_of(net, x, t)
                values[at] = keep - e
                down = cost_of(net, x, t)
                values[at] = keep
                assert g[at] == pytest.approx((up - down) / (2 * e), abs=2e-6)


def test_golden_linear_layer(spark):
    conf = config(fc("FC_LIN", 2), image=3, cost="SQR")
    net = Network(conf, [np.array([[0.0, 1], [2, 3], [4, 5]])], [np.zeros(2)])
    df = spark.createDataFrame([(0, [11.0, 22.0, 33.0], [5.0, 4.0]), (1, [-1.0, 2.0, 82.0], [2.0, 5.0])], "id long, data array<double>, target array<double>")
    rows = score(df, net, "id", target="target").orderBy("id").collect()
    assert [r["y"] for r in rows] == [[176, 242], [332, 415]]
    assert [r["cost"] for r in rows] == [42942.5, 138500.0]
    assert evaluate(df, net, target="target").first()["accuracy"] == 0.0
    dw, db = net.gradients(net.forward(np.array([[11.0, 22, 33], [-1, 2, 82]])), np.array([[5.0, 4], [2, 5]]), 2)[0]
    assert db.tolist() == [85.5 + 165, 119 + 205]


def test_sharpen_kernel():
    conf = config(conv(1, 3, 1, 1), image=(1, 5, 5), cost="SQR")
    kernel = np.array([[0.0, -1, 0], [-1, 5, -1], [0, -1, 0]]).reshape(1, 1, 3, 3)
    net = Network(conf, [kernel], [np.zeros(1)])
    out = net.forward(np.full((1, 25), 3.0))[-1][0, 0]
    assert out.shape == (5, 5) and (out[1:4, 1:4] == 3.0).all() and out[0, 0] == 9.0


def test_padding_takes_part_in_the_maximum():
    conf = config(pool(1, 2, 2, 1), image=(1, 2, 2), cost="SQR")
    out = Network.initial(conf).forward(np.full((1, 4), -1.0))[-1]
    assert (out == 0.0).all()


def test_ties_all_get_the_full_gradient(spark):
    conf = config(pool(1, 2, 2), image=(1, 2, 2), cost="SQR")
    layer = ACTIVATIONS["MAXPOOL"]
    x = np.array([[[[1.0, 1.0], [0.5, 1.0]]]])
    y = layer.forward(x, None, None, conf.network[0])
    _, _, back = layer.backward(np.array([[[[2.0]]]]), y, x, None, conf.network[0], True)
    assert back.tolist() == [[[[2.0, 2.0], [0.0, 2.0]]]]
    cells = spark.createDataFrame([(0, 0, i // 2, i % 2, float(v)) for i, v in enumerate(x.ravel())], "id long, c int, y int, x int, v double")
    pooled = sliding.max_pool(cells, 2, 2, 2, 2, 0)
    deltas = spark.createDataFrame([(0, 0, 0, 0, 2.0)], "id long, c int, i int, j int, d double")
    got = sliding.max_pool_input_gradient(cells, pooled, deltas, 2, 2, 2, 2, 0).orderBy("y", "x").collect()
    assert [r["g"] for r in got] == [2.0, 2.0, 0.0, 2.0]


@pytest.mark.parametrize("name", ["dense", "conv", "stride", "overlap"])
def test_join_form_agrees_with_batch_form(spark, name):
    conf = NETS[name]
    net = Network.initial(conf, seed=2)
    x, labels = sample(conf, rows=5)
    df = frame(spark, x, labels)
    image = conf.image()
    cells = arrays.cells(df, "data", image[1], image[2], "id") if image else df.select("id", F.posexplode("data").alias("k", "v"))
    joined = {(r["id"], r["j"]): r["y"] for r in relational_forward(cells, net).collect()}
    want = net.forward(x)[-1]
    assert len(joined) == want.size
    for (i, j), y in joined.items():
        assert y == pytest.approx(want[i, j], abs=1e-12)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("fan_in", [64, 1])
def test_distributed_gradient(spark, monkeypatch, parts, fan_in):
    """Sums are the same however many vectors a reducer adds."""
    monkeypatch.setattr(gradients, "FAN_IN", fan_in)
    monkeypatch.setattr(gradients, "BLOCK", 7)
    conf = NETS["conv"]
    net = Network.initial(conf, seed=2)
    x, labels = sample(conf, rows=20)
    t = np.eye(3)[labels]
    head, flat = gradients.batch_sums(frame(spark, x, labels, parts), {0: net}, 20)[0]
    want = net.gradients(net.forward(x), t, 20)
    np.testing.assert_allclose(flat, gradients.flatten(want), atol=1e-12)
    np.testing.assert_allclose(head, [20, cost_of(net, x, t) * 20, (net.forward(x)[-1].argmax(1) == labels).sum()])
    for (dw, db), (ew, eb) in zip(gradients.unflatten(net, flat), want):
        assert (dw is None) == (ew is None)
        if dw is not None:
            np.testing.assert_allclose(dw, ew, atol=1e-12)


def numpy_training(conf, x, labels, order, seed=0):
    """The same loop on one machine, for comparison."""
    net = Network.initial(conf, seed)
    velocity, costs = zero_velocity(net), []
    t = np.eye(conf.network[-1].num_channels)[labels]
    for epoch in range(conf.epoch):
        at, means = order(epoch), []
        for i in range(0, len(x), conf.batch):
            rows = at[i : i + conf.batch]
            ys = net.forward(x[rows])
            means.append(net.row_cost(ys[-1], t[rows]).mean())
            sgd_step(net, velocity, net.gradients(ys, t[rows], len(rows)))
        costs.append(np.mean(means))
    return net, costs


def test_training_matches_numpy(spark):
    conf = config(fc("FC_SIG", 6), fc("FC_SOFTMAX", 3), image=12, epoch=2, batch=8, alpha=0.5, shuffle=False)
    x, labels = sample(conf, rows=20)
    run = fit(frame(spark, x, labels), frame(spark, x, labels), None, conf)
    net, costs = numpy_training(conf, x, labels, lambda e: np.arange(20))
    assert [r["batch_num"] for r in run.cost_rows] == [3, 6]
    np.testing.assert_allclose([r["cost_batch"] for r in run.cost_rows], costs, atol=1e-10)
    for a, b in zip(run.network.weights + run.network.biases, net.weights + net.biases):
        np.testing.assert_allclose(a, b, atol=1e-10)


def test_shuffled_training_learns_and_resumes(spark, tmp_path):
    conf = config(fc("FC_SOFTMAX", 3, 0.1), image=12, epoch=4, batch=15, alpha=0.5)
    x, labels = sample(conf, rows=60)
    x[np.arange(60), labels] += 4.0
    data = frame(spark, x, labels)
    store = ProfileStore(spark, str(tmp_path / "store"), "db_learn")
    run = fit(data, data, data, conf, store=store, model_path=str(tmp_path / "model"), run_id="run-a")
    assert run.cost_rows[-1]["cost_val"] < run.cost_rows[0]["cost_val"]
    assert run.test == pytest.approx((run.cost_rows[-1]["cost_val"], run.cost_rows[-1]["correct_val"]))
    assert store.count_rows("profile_cost_ann") == 4 and store.count_rows("meta_ann") == 1
    detail = store.read("eval_out_prob")
    assert detail.count() == 60 and detail.columns[:4] == ["populate_time", "name", "index", "is_correct"]
    assert detail.where("is_correct = 1").count() == round(run.test[1] * 60)
    assert store.count_rows("wrong_img") == 60 - round(run.test[1] * 60)
    loaded = load_model(spark, str(tmp_path / "model"), "run-a")
    best = max(run.cost_rows, key=lambda r: r["correct_val"])
    assert loaded.epoch == next(r["epoch_num"] for r in run.cost_rows if r["correct_val"] == best["correct_val"])
    np.testing.assert_array_equal(loaded.weights[0], run.best.weights[0])
    again = fit(data, data, None, conf, start=loaded, run_id="run-b")
    assert again.cost_rows[0]["epoch_num"] == loaded.epoch + 1


def test_load_checks_shapes(spark, tmp_path):
    net = Network.initial(NETS["dense"])
    save_model(spark, net, str(tmp_path), "r")
    save_model(spark, Network.initial(NETS["conv"]), str(tmp_path), "other")
    back = load_model(spark, str(tmp_path), "r")
    assert back.config == net.config
    np.testing.assert_array_equal(back.weights[1], net.weights[1])
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path), "r", expected=NETS["conv"])
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path), "missing")


def test_sweep_equals_single_runs(spark):
    base = dict(image=12, epoch=2, shuffle=True)
    confs = {
        1: config(fc("FC_SOFTMAX", 3), batch=8, alpha=0.5, **base),
        2: config(fc("FC_SOFTMAX", 3), batch=8, alpha=0.1, momentum=0.0, **base),
        3: config(fc("FC_SIG", 4), fc("FC_SOFTMAX", 3), batch=10, alpha=0.1, **base),
    }
    x, labels = sample(confs[1], rows=20)
    data = frame(spark, x, labels, 1)
    swept = fit_many(data, data, None, confs)
    assert len({r.run_id for r in swept.values()}) == 3
    for key, conf in confs.items():
        alone = fit(data, data, None, conf)
        np.testing.assert_allclose(swept[key].network.weights[0], alone.network.weights[0], atol=1e-12)
        for ours, theirs in zip(swept[key].cost_rows, alone.cost_rows, strict=True):
            assert ours == pytest.approx(theirs)


def test_sweep_table(spark):
    base = config(fc("FC_LIN", 1, 0.1), image=4, cost="SQR", epoch=1)
    sets_ = spark.createDataFrame([("sine",)], "data string")
    table = sweep_table(sets_, [0.1, 0.2], [0.9], [4, 8], ["5sig-1lin", "3sig-2sig-1lin"])
    confs = configurations(table, base)
    assert len(confs) == 8
    row, conf = confs[0]
    assert (row["data"], conf.alpha, conf.momentum, conf.batch) == ("sine", 0.1, 0.9, 4)
    assert conf.structure() == "4FC_LIN-3FC_SIG-2FC_SIG-1FC_LIN"
    x, _ = sample(conf, rows=8)
    df = spark.createDataFrame([(i, [float(v) for v in r], [float(r.sum())]) for i, r in enumerate(x)], "id long, data array<double>, target array<double>")
    runs = fit_many(df, df, None, {i: c for i, (_, c) in enumerate(confs)}, target="target")
    assert len(runs) == 8 and all(r.cost_rows[0]["correct_val"] == 0.0 for r in runs.values())


def test_layer_types_can_be_added(spark, monkeypatch):
    monkeypatch.setitem(ACTIVATIONS, "FC_CUBE", Dense(lambda z: z**3, lambda y: 3 * np.abs(y) ** (2 / 3)))
    conf = config(fc("FC_CUBE", 2), image=2, cost="SQR")
    net = Network(conf, [np.eye(2)], [np.zeros(2)])
    df = spark.createDataFrame([(0, [2.0, 3.0])], "id long, data array<double>")
    assert score(df, net, "id").first()["y"] == [8.0, 27.0]


def test_configuration_checks():
    with pytest.raises(ValueError):
        config(fc("FC_SIG", 3), image=4)  # cross-entropy needs softmax
    with pytest.raises(ValueError):
        config(fc("FC_NOPE", 3), image=4)
    with pytest.raises(ValueError):
        config(conv(1, 3, 2, 0), fc("FC_SOFTMAX", 2), image=(1, 4, 4))
    assert config(conv(2, 3, 1, 1), fc("FC_SOFTMAX", 2), image=(1, 4, 6)).weight_shapes() == [(1, 2, 3, 3), (48, 2)]
    assert Network.initial(config({"type": "FC_SOFTMAX", "num_channels": 2}, image=4)).weights[0].any() == False  # noqa: E712
    assert Layer("FC_SIG", 3).stride == 1


def test_bad_rows_are_refused(spark):
    net = Network.initial(config(fc("FC_SOFTMAX", 2), image=2))
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "id long, data array<double>").coalesce(1)
    with pytest.raises(Exception, match="different width"):
        score(ragged, net, "id").collect()


def test_model_size_is_checked(spark, monkeypatch):
    import runloom.plans.network as network

    monkeypatch.setattr(network, "MODEL_BYTES_LIMIT", 8)
    with pytest.raises(ValueError, match="broadcast limit"):
        predict(spark.range(1), Network.initial(NETS["dense"]))


def test_evaluation_of_empty_data(spark):
    net = Network.initial(config(fc("FC_SOFTMAX", 2), image=2))
    empty = spark.createDataFrame([], "id long, data array<double>, label int")
    assert tuple(evaluate(empty, net).first()) == (0, 0.0, 0.0)


def test_details_rank_and_files(spark):
    conf = config(fc("FC_SOFTMAX", 3), image=3)
    net = Network(conf, [np.eye(3)], [np.zeros(3)])
    rows = [(0, [3.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 0.0, 2.0], 1), (3, [0.0, 0.5, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, data array<double>, label int")
    detail, wrong = evaluate_details(df, net, "s")
    got = detail.orderBy("index").collect()
    assert [r["is_correct"] for r in got] == [0, 0, 1, 1]
    tops = [r["cat2"] for r in got]
    assert tops[0] < tops[1] and tops[2] < tops[3]
    assert all(r["cat0"] <= r["cat1"] <= r["cat2"] for r in got)
    files = wrong.orderBy("img").collect()
    assert files[0]["name"] == "img0_channel1_correct0_wrong1"
    assert [(r["img"], r["id"], r["correct"], r["wrong"], r["pixels"]) for r in files] == [(0, 1, 0, 1, [0, 255, 0]), (1, 2, 1, 2, [0, 0, 255])]


def test_report_totals(spark):
    rows = [("test.h5", 270, 0.6889, 0.8913), ("train.h5", 1171, 0.7045, 0.8374), ("valid.h5", 360, 0.6972, 0.8804)]
    df = spark.createDataFrame(rows, "file string, num_entries long, accuracy double, cost double")
    n, accuracy, cost = reports.weighted_total(df).first()
    assert n == 1801 and accuracy == pytest.approx(0.7007, abs=1e-4) and cost == pytest.approx(0.8541, abs=1e-4)
    n, accuracy, _ = reports.unweighted_total(df).first()
    assert n == 1801 and accuracy == pytest.approx((0.6889 + 0.7045 + 0.6972) / 3)


def test_report_with_unnamed_set(spark):
    df = spark.createDataFrame([(None, 1.0, 1), ("a", 2.0, 0)], "`set` string, cost double, correct int")
    got = [(r["file"], r["num_entries"]) for r in reports.eval_report(df).collect()]
    assert got[-1] == ("TOTAL", 2) and (None, 1) in got


def test_short_last_batch_counts_fully(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 0, 3.0, 0), (1, 1, 8.0, 1)], "epoch int, batch int, cost double, correct int")
    assert tuple(reports.epoch_metrics(df).first()) == (1, 2, 5.0, 0.75)
