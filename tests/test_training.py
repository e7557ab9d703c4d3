"""Keyed permutations, and epochs as one barrier job against steps as jobs and NumPy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import config, fc, frame, numpy_training, sample

from runloom.functions.normal import normal, normals
from runloom.functions.permutation import permuted, permuted_numbers, round_keys, side_of
from runloom.plans import epochs, training
from runloom.plans.network import NetConfig
from runloom.plans.training import fit, fit_many


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 99, 100, 101, 1000])
def test_places_are_a_permutation(spark, n):
    keys = round_keys(3, n)
    want = permuted_numbers(np.arange(n), n, keys)
    assert sorted(want) == list(range(n))
    got = spark.range(n).select("id", permuted(F.col("id"), n, keys).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == dict(enumerate(want.tolist()))


def test_places_of_many_rows_are_spread():
    n = 200_000
    a, b = (permuted_numbers(np.arange(n), n, round_keys(0, e)) for e in (0, 1))
    assert len(np.unique(a)) == n and not np.array_equal(a, b)
    assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.02
    # Neighbours land in unrelated batches, and every batch takes from all parts of the order.
    assert abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.02
    counts = np.histogram2d(np.arange(n), a, bins=20)[0]
    assert (abs(counts - n / 400) < 6 * np.sqrt(n / 400)).all()


@pytest.mark.parametrize("n", [10**12, 10**15])
def test_places_of_very_many_rows(n):
    at = np.array([0, 1, 2, n // 2, n - 1])
    got = permuted_numbers(at, n, round_keys(5, 7))
    side = side_of(n)
    assert (got < n).all() and (got >= 0).all() and len(set(got)) == 5 and side * side >= n > (side - 1) ** 2


def order_of(conf, n, seed=0):
    def order(epoch):
        return np.argsort(permuted_numbers(np.arange(n), n, round_keys(seed, epoch)))

    return order


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("barrier", [True, False])
@pytest.mark.parametrize("shuffled", [True, False])
def test_training_matches_numpy_in_any_form(spark, monkeypatch, parts, barrier, shuffled):
    monkeypatch.setattr(epochs, "ROWS_PER_TASK", 3)
    if not barrier:
        monkeypatch.setattr(epochs, "GATHER_BYTES", 0)
    conf = config(fc("FC_SIG", 6), fc("FC_SOFTMAX", 3), image=12, epoch=3, batch=8, alpha=0.5, shuffle=shuffled)
    x, labels = sample(conf, rows=21)
    asked = []
    monkeypatch.setattr(training, "step_tasks", lambda *a: asked.append(epochs.step_tasks(*a)) or asked[-1])
    run = fit(frame(spark, x, labels, parts), frame(spark, x, labels), None, conf)
    assert all(0 < n <= 3 if barrier else n == 0 for n in asked) and len(asked) == 3
    net, costs = numpy_training(conf, x, labels, order_of(conf, 21) if shuffled else lambda e: np.arange(21))
    np.testing.assert_allclose([r["cost_batch"] for r in run.cost_rows], costs, atol=1e-10)
    assert [r["batch_num"] for r in run.cost_rows] == [3, 6, 9]
    for a, b in zip(run.network.weights + run.network.biases, net.weights + net.biases, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-10)


def test_batches_smaller_than_the_tasks(spark, monkeypatch):
    """Tasks without a row of a batch step along."""
    monkeypatch.setattr(epochs, "ROWS_PER_TASK", 1)
    conf = config(fc("FC_SOFTMAX", 3), image=12, epoch=1, batch=5, alpha=0.5, shuffle=True)
    x, labels = sample(conf, rows=11)
    run = fit(frame(spark, x, labels, 2), None, None, conf)
    net, _ = numpy_training(conf, x, labels, order_of(conf, 11))
    np.testing.assert_allclose(run.network.weights[0], net.weights[0], atol=1e-10)


def test_configurations_end_at_their_own_epoch(spark):
    confs = {k: config(fc("FC_SOFTMAX", 3), image=12, epoch=k, batch=8, alpha=0.5, shuffle=True) for k in (1, 3)}
    x, labels = sample(confs[1], rows=20)
    runs = fit_many(frame(spark, x, labels), None, None, confs)
    assert {k: len(r.cost_rows) for k, r in runs.items()} == {1: 1, 3: 3}
    for k, conf in confs.items():
        net, _ = numpy_training(conf, x, labels, order_of(conf, 20))
        np.testing.assert_allclose(runs[k].network.weights[0], net.weights[0], atol=1e-10)


def test_tasks_of_a_step(spark):
    conf = config(fc("FC_SOFTMAX", 3), image=12)
    net = training.Network.initial(conf)
    assert isinstance(conf, NetConfig)
    assert epochs.step_tasks(spark, {0: net}, 1) == 1
    assert epochs.step_tasks(spark, {0: net}, 10**6) == spark.sparkContext.defaultParallelism
    large = training.Network(conf, [np.zeros((12, 10**6))], [np.zeros(10**6)])
    assert epochs.step_tasks(spark, {0: large}, 10**6) == 0


def test_permutation_in_sql():
    from runloom.contract.models import _places_sql

    con = duckdb.connect()
    n = 777
    side = side_of(n)
    con.execute(f"CREATE TABLE numbered AS SELECT range AS vec_id, range AS spot, {n} AS n, {side} AS side FROM range({n})")
    got = con.execute(f"WITH RECURSIVE {_places_sql(4, 9)} SELECT vec_id, x FROM walk4 WHERE x < n ORDER BY 1").fetchall()
    assert [x for _, x in got] == permuted_numbers(np.arange(n), n, round_keys(9, 4)).tolist()


def test_first_weights_are_normal_numbers_by_counter(spark):
    made = normals(20_000, 3, 1)
    assert abs(made.mean()) < 0.03 and abs(made.std() - 1) < 0.03 and abs((made < -1).mean() - 0.1587) < 0.01 and made.max() > 3
    np.testing.assert_array_equal(made[:100], normals(100, 3, 1))
    assert abs(np.corrcoef(made, normals(20_000, 3, 2))[0, 1]) < 0.03
    got = {r["id"]: r["z"] for r in spark.range(500).select("id", normal(F.col("id"), 3, 1).alias("z")).collect()}
    np.testing.assert_allclose([got[i] for i in range(500)], made[:500], rtol=1e-12)
    conf = config(fc("FC_SIG", 4, 0.5), fc("FC_SOFTMAX", 3, 0.1), image=12)
    net = training.Network.initial(conf, 3)
    np.testing.assert_array_equal(net.weights[1].ravel(), 0.1 * normals(12, 3, 1))
