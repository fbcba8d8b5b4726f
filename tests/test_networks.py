"""Networks with encoders: passes against plain loops and finite differences, training on the cluster."""

import numpy as np
import pytest

from sparrel.operators import models, networks, training

PICTURE = (3, 5, 6)


def network(kind, **more):
    return networks.RelationNetwork(kind, (512,) if kind.startswith("large") else PICTURE, 7, categories=4, **more)


def data(net, n=5, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(n, net.sizes["image_size"])), rng.normal(size=(n, 7)), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 4, n)]


@pytest.mark.parametrize("kind", networks.NETWORKS)
def test_gradients_are_those_of_finite_differences(kind):
    net, rng = network(kind), np.random.default_rng(1)
    args = data(net)
    _, g = net.loss_and_gradients(*args, auxiliary_weight=0.4)
    assert g.keys() == net.weights.keys() and all(g[k].shape == w.shape for k, w in net.weights.items())
    for k, w in net.weights.items():
        for _ in range(3):
            at, losses = tuple(rng.integers(0, s) for s in w.shape), []
            before = w[at]
            for step in (1e-6, -1e-6):
                w[at] = before + step
                losses.append(net.loss_and_gradients(*args, auxiliary_weight=0.4)[0])
            w[at] = before
            assert abs((losses[0] - losses[1]) / 2e-6 - g[k][at]) < 1e-5, k


def test_an_image_encoder_by_plain_loops():
    net = network("small_image")
    picture = np.random.default_rng(2).normal(size=PICTURE)
    x = picture
    for k in range(3):
        w, b = net.weights[f"convolution{k}"], net.weights[f"convolution{k}_bias"]
        c, h, v = x.shape
        out = np.zeros((len(w), h, v))
        for o in range(len(w)):
            for y in range(h):
                for z in range(v):
                    total = b[o]
                    for i in range(c):
                        for dy in (-1, 0, 1):
                            for dz in (-1, 0, 1):
                                if 0 <= y + dy < h and 0 <= z + dz < v:
                                    total += w[o, i, dy + 1, dz + 1] * x[i, y + dy, z + dz]
                    out[o, y, z] = max(total, 0)
        x = out
        if k < 2:
            x = np.array([[[out[o, 2 * y : 2 * y + 2, 2 * z : 2 * z + 2].max() for z in range(v // 2)] for y in range(h // 2)] for o in range(len(w))])
    x = np.maximum(net.weights["projection0"] @ x.mean(axis=(1, 2)) + net.weights["projection0_bias"], 0)
    want = net.weights["head0"] @ x + net.weights["head0_bias"]
    assert np.allclose(net.forward(picture.reshape(1, -1), np.zeros((1, 7)))["o"][0], want, atol=1e-12)


@pytest.mark.parametrize("kind", networks.NETWORKS)
def test_dropout_scales_what_it_keeps(kind):
    net = network(kind)
    args = data(net)
    plain = net.forward(*args[:2])
    assert plain.keys() == ({"o", "image", "text"} if net.auxiliary else {"o"})
    many = np.mean([net.forward(*args[:2], np.random.default_rng(k))["o"] for k in range(600)], axis=0)
    assert np.abs(many - plain["o"]).max() < 0.2 and (net.forward(*args[:2], np.random.default_rng(1))["o"] != plain["o"]).any()
    once, again = (net.loss_and_gradients(*args, rng=np.random.default_rng(3)) for _ in range(2))
    assert once[0] == again[0] and all((once[1][k] == again[1][k]).all() for k in once[1])


def test_inputs_that_do_not_fit():
    for kind, image in (("small_image", (512,)), ("large_multimodal", PICTURE), ("small_image", (1, 8, 8)), ("small_multimodal", (3, 3, 8))):
        with pytest.raises(ValueError, match="doesn't read"):
            networks.RelationNetwork(kind, image, 7)
    with pytest.raises(ValueError, match="unknown"):
        networks.RelationNetwork("x", PICTURE, 7)


def test_arrays_are_those_that_are_counted(spark):
    counted = {(r.network, r.layer): r.parameters for r in networks.parameter_counts(spark, 7, categories=4).collect()}
    for kind in networks.NETWORKS:
        assert {k: w.size for k, w in network(kind).weights.items()} == {layer: n for (name, layer), n in counted.items() if name == kind}


def test_a_small_network_learns_on_the_cluster(spark):
    """Which of the three channels is brightest: only the picture tells."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, 240)
    pictures = rng.random((240, *PICTURE)) * 0.2
    pictures[np.arange(240), labels] += 1.0
    rows = [([float(v) for v in p.ravel()], [0.0] * 7, int(k), int(k), 0) for p, k in zip(pictures, labels)]
    df = spark.createDataFrame(rows, "image array<double>, text array<double>, label int, image_category int, text_category int")
    net, packed = network("small_multimodal"), training.pack(df, ("label", "image_category", "text_category"), batch=120)
    n, loss, g = training.step(spark, net, packed, packed.chunks, 0.4)
    want, gradients = net.loss_and_gradients(*(np.array(c) for c in zip(*rows)), auxiliary_weight=0.4)
    # Features are packed as float32.
    assert n == 240 and abs(loss / n - want) < 1e-6 and all(np.allclose(g[k] / n, gradients[k], atol=1e-6) for k in g)
    history = training.fit(spark, net, packed, 10, packed, rate=0.01, auxiliary_weight=0.4, decay=1e-4)
    assert history.epochs[history.best_epoch - 1]["validation_accuracy"] > 0.9
    scores = models.score(df.limit(5).selectExpr("1 id", "image", "text"), net, "id", ["A", "B", "C"]).collect()
    assert all(abs(r.score_a + r.score_b + r.score_c - 1) < 1e-9 for r in scores)


def test_decay_pulls_weights_to_zero():
    weights, still = {"w": np.array([2.0, -2.0])}, {"w": np.zeros(2)}
    models.Adam(0.1, 0.5).step(weights, still)
    assert np.allclose(np.abs(weights["w"]), 1.9)


def test_a_network_is_saved_and_loaded(spark, tmp_path):
    net = network("small_multimodal", seed=9)
    vocabulary = spark.createDataFrame([("a", 1.0, 0)], "term string, idf double, index int")
    models.save(net, vocabulary, f"file://{tmp_path}/m", ["A", "B", "C"])
    again, _, about = models.load(spark, f"file://{tmp_path}/m", ["A", "B", "C"])
    args = data(net)[:2]
    assert about["kind"] == "small_multimodal" and (again.predict(*args) == net.predict(*args)).all()
