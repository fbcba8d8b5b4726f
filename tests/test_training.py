"""Training on the cluster against a single process."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.operators import models, training

SCHEMA = "image array<double>, text array<double>, label int, image_category int, text_category int, id string, order int, copy int"


def rows(spark, n, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7)).astype(np.float32).astype(float)
    labels = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int) + (x[:, 1] > 0.8)
    data = [([float(v) for v in r[:4]], [float(v) for v in r[4:]], int(k), int(r[2] > 0), int(r[5] > 0), "clash", 1, 2) for r, k in zip(x, labels)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def chunks_of(spark, packed):
    """Chunk -> (x, y), read from the files with no help of the module."""
    out = {}
    for r in spark.read.parquet(packed.path).collect():
        out[r.chunk] = np.frombuffer(r.x, np.float32).reshape(r.rows, -1).astype(float), np.frombuffer(r.y, np.int64).reshape(r.rows, -1)
    return out


class ByHand:
    """A network of one hidden layer over the image, trained in one process; drops units like the module if told to."""

    def __init__(self, weights, rate):
        self.w = [weights[k].copy() for k in ("h", "h_bias", "o", "o_bias")]
        self.m, self.v, self.t, self.rate = [0 * w for w in self.w], [0 * w for w in self.w], 0, rate

    def logits(self, x, keep=1.0):
        hidden = np.maximum(x @ self.w[0] + self.w[1], 0) * keep
        return hidden, hidden @ self.w[2] + self.w[3]

    def step(self, parts, dropout):
        n, loss, total = sum(len(x) for _, x, _ in parts), 0.0, [0 * w for w in self.w]
        for number, x, y in parts:
            keep = 1.0 if dropout is None else (np.random.default_rng([*dropout, number]).random((len(x), len(self.w[1]))) >= 0.2) / 0.8
            hidden, z = self.logits(x, keep)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss -= np.log(p[np.arange(len(y)), y]).sum()
            d = p - np.eye(p.shape[1])[y]
            dh = d @ self.w[2].T * (hidden > 0) * keep
            for k, g in enumerate((x.T @ dh, dh.sum(axis=0), hidden.T @ d, d.sum(axis=0))):
                total[k] += g
        self.t += 1
        for k, g in enumerate(total):
            g = g / n
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] = self.w[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return loss


def macro_f1(truth, guess):
    scores = []
    for c in sorted(set(truth) | set(guess)):
        hits = sum(t == g == c for t, g in zip(truth, guess))
        scores.append(2 * hits / (sum(t == c for t in truth) + sum(g == c for g in guess)))
    return sum(scores) / len(scores)


@pytest.mark.parametrize("dropout", [False, True])
def test_history_weights_and_best_epoch_are_those_of_one_process(spark, dropout):
    train, validation = training.pack(rows(spark, 2000)), training.pack(rows(spark, 300, seed=3))
    assert train.rows == 2000 and 25 <= len(train.chunks) <= 32
    network = models.HeadNetwork("image_only", 4, 3, 3, hidden=6)
    hand = ByHand(network.weights, 0.03)
    history = training.fit(spark, network, train, 3, validation, rate=0.03, seed=7, dropout=dropout)
    data, val = chunks_of(spark, train), chunks_of(spark, validation)
    vx, vy = (np.concatenate([val[c][k] for c in sorted(val)]) for k in (0, 1))
    best = None
    for epoch in (1, 2, 3):
        order = [sorted(data)[k] for k in np.random.default_rng([7, epoch]).permutation(len(data))]
        loss = sum(hand.step([(c, data[c][0][:, :4], data[c][1][:, 0]) for c in order[at : at + 4]], (7, epoch) if dropout else None) for at in range(0, len(order), 4))
        guess, truth = hand.logits(vx[:, :4])[1].argmax(axis=1), vy[:, 0]
        f1 = macro_f1(truth.tolist(), guess.tolist())
        if best is None or f1 > best[0]:
            best = f1, epoch, [w.copy() for w in hand.w]
        found = history.epochs[epoch - 1]
        assert abs(found["train_loss"] - loss / 2000) < 1e-9 and abs(found["validation_macro_f1"] - f1) < 1e-9
        assert abs(found["validation_accuracy"] - (guess == truth).mean()) < 1e-9
    assert history.best_epoch == best[1]
    for k, w in zip(("h", "h_bias", "o", "o_bias"), best[2]):
        assert np.allclose(network.weights[k], w, atol=1e-9)


def test_a_step_sums_what_its_chunks_give(spark):
    """Both encoders and the category heads: a step over all chunks has the gradients of all rows at once."""
    packed = training.pack(rows(spark, 500), ("label", "image_category", "text_category"), batch=64)
    network = models.HeadNetwork("multimodal", 4, 3, 3, categories=2, hidden=5)
    n, loss, g = training.step(spark, network, packed, packed.chunks)
    data = chunks_of(spark, packed)
    x, y = (np.concatenate([data[c][k] for c in data]) for k in (0, 1))
    want, gradients = network.loss_and_gradients(x[:, :4], x[:, 4:], *y.T)
    assert n == 500 and abs(loss / n - want) < 1e-9 and all(np.allclose(g[k] / n, gradients[k], atol=1e-9) for k in gradients)


def test_a_step_reads_its_chunks_only(spark):
    packed = training.pack(rows(spark, 400), batch=64)
    (_, x, y), *more = packed.read(spark, packed.chunks[:1]).collect()
    data = chunks_of(spark, packed)
    assert not more and (x == data[packed.chunks[0]][0]).all() and sum(len(v[0]) for v in data.values()) == 400


def test_equal_rows_meet_in_many_chunks(spark):
    packed = training.pack(rows(spark, 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2000)))), batch=128)
    sizes = [r.rows for r in spark.read.parquet(packed.path).collect()]
    assert sum(sizes) == 2000 and len(sizes) > 50 and max(sizes) < 80


def test_packing_does_not_depend_on_partitions(spark):
    df = rows(spark, 200)
    a, b = (chunks_of(spark, training.pack(d)) for d in (df, df.orderBy("image").coalesce(1)))
    assert a.keys() == b.keys() and all((a[c][0] == b[c][0]).all() and (a[c][1] == b[c][1]).all() for c in a)


def test_odd_input(spark):
    df = rows(spark, 3)
    with pytest.raises(Exception, match="no image"):
        training.pack(df.withColumn("image", F.when(F.col("label") >= 0, F.lit(None)).otherwise(F.col("image"))))
    with pytest.raises(ValueError, match="no rows"):
        training.pack(df.limit(0))
    packed = training.pack(df)
    with pytest.raises(ValueError, match="at least one"):
        training.fit(spark, models.HeadNetwork("text_only", 4, 3, 3), packed, 0)
    network = models.HeadNetwork("text_only", 4, 3, 3, hidden=2)
    network.weights["h"][:] = 0  # all scores equal: the first epoch is the best
    assert training.fit(spark, network, packed, 2, packed, rate=0.0).best_epoch == 1


def test_first_weights_come_from_digests():
    a, b = models.HeadNetwork("multimodal", 6, 5, 3, categories=4, hidden=3), models.HeadNetwork("multimodal", 6, 5, 3, categories=4, hidden=3, seed=45)
    assert all(np.abs(w).max() <= 1 and len(set(w.ravel())) == w.size for w in a.weights.values())
    assert all((a.weights[k] != b.weights[k]).all() for k in a.weights)
    import hashlib

    draw = int(hashlib.sha256(b"44|t|2|1").hexdigest()[:8], 16) / 2**31 - 1
    assert a.weights["t"][2, 1] == draw / np.sqrt(5)


def test_an_epoch_is_one_job_however_many_steps(spark):
    """Jobs of a fit don't grow with its rows: 16 times as many steps take as many."""
    packed, context, jobs = training.pack(rows(spark, 1000), batch=32), spark.sparkContext, []
    network = models.HeadNetwork("image_only", 4, 3, 3, hidden=4)
    for group, chunks in (("few steps", 64), ("many steps", 4)):
        assert len(packed.chunks) > 64
        context.setJobGroup(group, group)
        training.fit(spark, network, packed, 1, chunks=chunks)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(group)))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 1 and jobs[1] < 10


@pytest.mark.parametrize("chunks", [1, 3, 6])
def test_steps_in_one_job_are_those_of_one_process(spark, chunks):
    """Both encoders, category heads, dropout; batches of more chunks than tasks, and last ones of fewer chunks."""
    packed = training.pack(rows(spark, 250), ("label", "image_category", "text_category"), batch=60)
    network, hand = (models.HeadNetwork("multimodal", 4, 3, 3, categories=2, hidden=5) for _ in range(2))
    history = training.fit(spark, network, packed, 2, rate=0.02, seed=5, chunks=chunks)
    data, adam = chunks_of(spark, packed), models.Adam(0.02)
    for epoch in (1, 2):
        order, loss = [packed.chunks[k] for k in np.random.default_rng([5, epoch]).permutation(len(packed.chunks))], 0.0
        for at in range(0, len(order), chunks):
            parts = [training.gradient_sums(hand, (c, *data[c]), 0.15, (5, epoch)) for c in order[at : at + chunks]]
            n = sum(p[0] for p in parts)
            adam.step(hand.weights, {k: sum(p[2][k] for p in parts) / n for k in hand.weights})
            loss += sum(p[1] for p in parts)
        assert abs(history.epochs[epoch - 1]["train_loss"] - loss / 250) < 1e-9
    assert all(np.allclose(network.weights[k], w, atol=1e-9) for k, w in hand.weights.items())
