"""Baselines, logistic regression, and head networks over image and text features."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks, staged


# Shares of units dropped in training (encoders of both sides, the head), rows of a batch.
DROPOUT = {"i": 0.15, "t": 0.15, "h": 0.20}
BATCH_ROWS = 256


def majority(train: DataFrame, label: str = "label") -> str | None:
    """The most frequent label; of equal ones the first in order."""
    row = train.groupBy(label).count().orderBy(F.desc("count"), label).limit(1).collect()
    return row[0][0] if row else None


def select_model(table: DataFrame, order: tuple[str, str] = ("macro_f1", "accuracy"), name: str = "model") -> DataFrame:
    """The row of best metrics; of equal ones the first by name."""
    return table.orderBy(*[F.desc(c) for c in order], name).limit(1)


def best_epoch(history: DataFrame, model: str = "model", epoch: str = "epoch", metric: str = "macro_f1") -> DataFrame:
    """model, epoch, metric of each model's best epoch, the first of equal ones; partial results before the shuffle."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e"))).alias("b")
    return history.groupBy(model).agg(best).select(model, (-F.col("b.e")).alias(epoch), F.col("b.m").alias(metric))


class HeadNetwork:
    """Feed-forward heads: text only, image only, or both encoded, joined and classified, with optional category heads for each side.

    Weights are float64 arrays, at first drawn(); forward() drops units only if it is given a generator of random numbers, as in training."""

    def __init__(self, kind: str, image_size: int, text_size: int, classes: int, categories: int = 0, hidden: int = 128, seed: int = 44) -> None:
        if kind not in ("text_only", "image_only", "multimodal"):
            raise ValueError(f"unknown kind: {kind}")
        self.kind, self.auxiliary = kind, categories > 0 and kind == "multimodal"
        self.sizes = {"image_size": image_size, "text_size": text_size, "classes": classes, "categories": categories, "hidden": hidden}
        shapes = {"text_only": {"h": (text_size, hidden), "o": (hidden, classes)}, "image_only": {"h": (image_size, hidden), "o": (hidden, classes)}, "multimodal": {"i": (image_size, hidden), "t": (text_size, hidden), "h": (2 * hidden, hidden), "o": (hidden, classes)}}[kind]
        if self.auxiliary:
            shapes |= {"ci": (hidden, categories), "ct": (hidden, categories)}
        self.weights = {k: drawn(seed, k, s) / np.sqrt(s[0]) for k, s in shapes.items()}
        self.weights |= {f"{k}_bias": drawn(seed, f"{k}_bias", (1, s[1]))[0] / np.sqrt(s[0]) for k, s in shapes.items()}

    def _layer(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[name] + self.weights[f"{name}_bias"]

    def forward(self, image: np.ndarray, text: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}

        def hidden(name: str, x: np.ndarray) -> np.ndarray:
            x = np.maximum(self._layer(name, x), 0)
            return x if rng is None else x * (rng.random(x.shape) >= DROPOUT[name]) / (1 - DROPOUT[name])

        if self.kind == "multimodal":
            out["i"], out["t"] = hidden("i", image), hidden("t", text)
            out["x"] = np.concatenate((out["i"], out["t"]), axis=1)
            if self.auxiliary:
                out["ci"], out["ct"] = self._layer("ci", out["i"]), self._layer("ct", out["t"])
        else:
            out["x"] = text if self.kind == "text_only" else image
        out["h"] = hidden("h", out["x"])
        out["o"] = self._layer("o", out["h"])
        return out

    def loss_and_gradients(self, image: np.ndarray, text: np.ndarray, label: np.ndarray, image_category: np.ndarray | None = None, text_category: np.ndarray | None = None, auxiliary_weight: float = 0.15, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients over a batch; with a generator under dropout."""
        out, g = self.forward(image, text, rng), {}
        # What a unit passes on: nothing if it is at rest or dropped, else scaled as in forward().
        live = lambda name: (out[name] > 0) / (1 - (DROPOUT[name] if rng is not None else 0))
        loss, d = cross_entropy(out["o"], label)

        def back(name: str, x: np.ndarray, d: np.ndarray) -> np.ndarray:
            g[name], g[f"{name}_bias"] = x.T @ d, d.sum(axis=0)
            return d @ self.weights[name].T

        d = back("o", out["h"], d) * live("h")
        d = back("h", out["x"], d)
        if self.kind == "multimodal":
            n = out["i"].shape[1]
            di, dt = d[:, :n], d[:, n:]
            if self.auxiliary:
                for side, target in (("i", image_category), ("t", text_category)):
                    more, dc = cross_entropy(out[f"c{side}"], target)
                    loss += auxiliary_weight * more
                    dx = back(f"c{side}", out[side], auxiliary_weight * dc)
                    di, dt = (di + dx, dt) if side == "i" else (di, dt + dx)
            back("i", image, di * live("i"))
            back("t", text, dt * live("t"))
        return loss, g

    def predict(self, image: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Probabilities of the classes."""
        z = self.forward(image, text)["o"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def drawn(seed: int, name: str, shape: tuple[int, int]) -> np.ndarray:
    """Numbers between -1 and 1, each from the SHA-256 of "seed|name|row|column": its first eight digits as a share of 2^32."""
    draw = lambda i, j: int(hashlib.sha256(f"{seed}|{name}|{i}|{j}".encode()).hexdigest()[:8], 16)
    return np.array([[draw(i, j) for j in range(shape[1])] for i in range(shape[0])], float).reshape(shape) / (1 << 31) - 1


def cross_entropy(z: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss of logits, and its gradient by them."""
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    k = np.arange(len(label))
    loss = float(-np.log(np.maximum(p[k, label], 1e-300)).mean())
    p[k, label] -= 1
    return loss, p / len(label)


class Adam:
    """decay: share of each weight that is added to its gradient."""

    def __init__(self, rate: float = 1e-3, decay: float = 0.0) -> None:
        self.rate, self.decay, self.t, self.m, self.v = rate, decay, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            g = g + self.decay * weights[k]
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            weights[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


#: Fields that a saved model's description must have; the last three must be false.
REQUIRED = ("status", "kind", "sizes", "labels", "digest", "vocabulary_digest", "versions", "test_rows_used", "test_inference_after", "tuned_after_test")


def save(network, vocabulary: DataFrame, path: str, labels: list[str], **about) -> None:
    """A model below a path that Spark can write: weights, vocabulary (term, idf, index), and last what it is: digests of both, labels in order, versions."""
    spark = vocabulary.sparkSession
    rows = [(k, list(w.shape), np.ascontiguousarray(w, "<f8").tobytes()) for k, w in sorted(network.weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, content binary").coalesce(1).write.parquet(f"{path}/weights")
    vocabulary.write.parquet(f"{path}/vocabulary")
    flags = {"test_rows_used": False, "test_inference_after": False, "tuned_after_test": False}
    known = {"status": "complete", "kind": network.kind, "sizes": network.sizes, "labels": list(labels), "digest": sinks.state_digest(network.weights), "versions": sinks.versions()}
    known["vocabulary_digest"] = staged.rows_digest(spark.read.parquet(f"{path}/vocabulary"))
    sinks.write_json(flags | about | known, f"{path}/about.json")


def bundle_problems(spark: SparkSession, path: str, labels: list[str] | None = None) -> list[str]:
    """Why a saved model must not be used: what its description lacks or says, and files that don't fit it.  Nothing if it may be."""
    if not sinks.exists(f"{path}/about.json"):
        return ["no description"]
    about = json.loads(sinks.read_bytes(f"{path}/about.json"))
    missing = [f for f in REQUIRED if f not in about]
    if missing:
        return [f"the description lacks {', '.join(missing)}"]
    wrong = [f"{f} is not false" for f in REQUIRED[-3:] if about[f] is not False]
    if about["status"] != "complete":
        wrong.append(f"status {about['status']}")
    if labels is not None and about["labels"] != list(labels):
        wrong.append("other labels, or in another order")
    if len(about["labels"]) != about["sizes"]["classes"]:
        wrong.append("as many classes as labels")
    for name in ("weights", "vocabulary"):
        if not sinks.exists(f"{path}/{name}"):
            return [*wrong, f"no {name}"]
    found = _weights(spark, path)
    shapes = {k: w.shape for k, w in _described(about["kind"], about["sizes"]).weights.items()}
    if {k: w.shape for k, w in found.items()} != shapes or sinks.state_digest(found) != about["digest"]:
        wrong.append("the weights are not those that were saved")
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    if staged.rows_digest(vocabulary) != about["vocabulary_digest"]:
        wrong.append("the vocabulary is not the one that was saved")
    return wrong


def _described(kind: str, sizes: dict):
    """A network of a saved kind and sizes, with first weights."""
    if "image" not in sizes:
        return HeadNetwork(kind, **sizes)
    from .networks import RelationNetwork

    return RelationNetwork(kind, tuple(sizes["image"]), sizes["text_size"], sizes["classes"], sizes["categories"])


def _weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    rows = spark.read.parquet(f"{path}/weights").collect()  # one row a layer
    return {r.name: np.frombuffer(r.content, "<f8").reshape(r.shape).copy() for r in rows}


def load(spark: SparkSession, path: str, labels: list[str] | None = None, same_versions: bool = False) -> tuple:
    """Network, vocabulary and description of a saved model; bundle_problems() are an error, and with same_versions other versions than it was saved with."""
    wrong = bundle_problems(spark, path, labels)
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    about = json.loads(sinks.read_bytes(f"{path}/about.json"))
    if same_versions:
        sinks.require_versions(about["versions"])
    network = _described(about["kind"], about["sizes"])
    network.weights = _weights(spark, path)
    return network, spark.read.parquet(f"{path}/vocabulary"), about


def score(rows: DataFrame, network: HeadNetwork, id_col: str, labels: list[str], batch: int = 128) -> DataFrame:
    """id, prediction, model_score and a score per label.  rows must hold only id, image and text: no label or category may reach the model."""
    extra = set(rows.columns) - {id_col, "image", "text"}
    if extra:
        raise ValueError(f"columns that a score must not see: {', '.join(sorted(extra))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                p = network.predict(*(np.array(part.column(k).to_pylist(), float) for k in (1, 2)))
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([labels[k] for k in best]), pa.array(p.max(axis=1)), *(pa.array(p[:, k]) for k in range(len(labels)))], names=[id_col, "prediction", "model_score", *(f"score_{x.lower()}" for x in labels)])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "image", "text").mapInArrow(run, f"{id_col} {kind}, prediction string, model_score double, " + ", ".join(f"score_{x.lower()} double" for x in labels))
