"""Layers over tiles and separable windows against the batch form."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import NETS, config, conv, fc, frame, pool, sample

import runloom.plans.network as network
from runloom.functions import arrays
from runloom.operators import sliding
from runloom.plans import tiles
from runloom.plans.network import Network
from runloom.plans.score import score

DEEP = {
    **{k: NETS[k] for k in ("dense", "conv", "stride", "overlap")},
    "channels": config(conv(5, 3, 1, 1), conv(3, 2, 2, 0), pool(3, 2, 2), fc("FC_SIG", 7), fc("FC_SOFTMAX", 3), image=(2, 8, 8)),
    "ends in an image": config(conv(3, 3, 1, 1), image=(2, 4, 4), cost="SQR"),
}


@pytest.fixture(params=["whole", "small"])
def sizes(request, monkeypatch):
    if request.param == "small":
        for name, value in (("TILE_INPUTS", 5), ("TILE_OUTPUTS", 2), ("TILE_CHANNELS", 2), ("BLOCK_CELLS", 40)):
            monkeypatch.setattr(tiles, name, value)
    return request.param


@pytest.mark.parametrize("name", DEEP)
def test_tiles_agree_with_the_batch_form(spark, monkeypatch, tmp_path, sizes, name):
    conf = DEEP[name]
    net = Network.initial(conf, seed=2)
    net.biases = [np.arange(len(b)) * 0.1 - 0.2 for b in net.biases]
    x, labels = sample(conf, rows=9)
    want = net.forward(x)[-1].reshape(9, -1)
    df = frame(spark, x, labels)
    tiles.save_tiles(spark, net, str(tmp_path / "model"))
    monkeypatch.setattr(network, "MODEL_BYTES_LIMIT", 0)
    with pytest.raises(ValueError, match="broadcast limit"):
        score(df, net, "id")
    saved = spark.read.parquet(str(tmp_path / "model"))
    assert tiles.tiles_config(saved) == conf
    for r in tiles.score_tiles(df, saved, "id").collect():
        np.testing.assert_allclose(r["y"], want[r["id"]], atol=1e-12)
        assert r["predicted"] == want[r["id"]].argmax()
    assert tiles.score_tiles(df.where("id < 0"), saved, "id").count() == 0


def test_input_gradient_of_several_channel_tiles(spark, sizes):
    conf = config(conv(5, 3, 2, 1), image=(2, 7, 9), cost="SQR")
    net, layer = Network.initial(conf, seed=4), conf.network[0]
    rng = np.random.RandomState(1)
    x, delta = rng.randn(3, 2, 7, 9), rng.randn(3, 5, 4, 5)
    _, _, want = net.layers[0].backward(delta, np.ones_like(delta), x, net.weights[0], layer, True)
    rows = [(int(n), int(e), int(i), int(j), float(delta[n, e, i, j])) for n, e, i, j in np.ndindex(delta.shape)]
    deltas = spark.createDataFrame(rows, "id long, e int, i int, j int, d double")
    got = np.zeros_like(want)
    for r in tiles.convolve_input_gradient(deltas, tiles.tiles_of(spark, net), (2, 7, 9), 5, 3, 2, 1, 3).collect():
        got[r["id"], r["c"], r["y"], r["x"]] = r["g"]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_networks_are_checked_in_all(spark, monkeypatch):
    net = Network.initial(NETS["dense"])
    monkeypatch.setattr(network, "MODEL_BYTES_LIMIT", int(1.5 * net.nbytes))
    Network.ship(spark, {0: net}).destroy()
    with pytest.raises(ValueError, match="2 networks"):
        Network.ship(spark, {0: net, 1: net})


@pytest.mark.parametrize("shape, kernel, stride, padding", [((8, 8), 4, 2, 1), ((7, 10), 3, 1, 0), ((6, 9), 3, 3, 0), ((6, 6), 2, 3, 1), ((4, 6), 1, 1, 0)])
@pytest.mark.parametrize("share", [1.0, 0.3])
@pytest.mark.parametrize("with_padding", [True, False])
def test_separable_windows_equal_all_cells(spark, shape, kernel, stride, padding, share, with_padding):
    rng = np.random.RandomState(7)
    image = rng.randn(3, 2 * shape[0] * shape[1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(image)], "id long, data array<double>")
    cells = arrays.cells(df, "data", *shape, "id").where(F.pmod(F.xxhash64("id", "c", "y", "x"), F.lit(100)) < 100 * share)
    kinds = {"high": "max", "low": "min", "total": "sum"}
    made = sliding.separable_windows(cells, *shape, kernel, stride, padding, kinds, with_padding and share == 1.0)
    wanted = {"high": F.max("v"), "low": F.min("v"), "total": F.sum("v")}
    want = sliding.window2d(cells, *shape, kernel, stride, padding, wanted, with_padding and share == 1.0)
    key = lambda r: (r["id"], r["c"], r["i"], r["j"])
    got, want = ({key(r): [r[n] for n in kinds] for r in d.collect()} for d in (made, want))
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == pytest.approx(values, abs=1e-12)
