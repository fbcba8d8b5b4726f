"""The relation networks with their image and text encoders: layers, parameter counts, and forward and backward passes that training.fit() runs in tasks.

A small network reads pictures, a large one features of a frozen backbone (see sources.features).  The simpler heads are in models.py."""

from __future__ import annotations

from collections.abc import Callable
from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .models import cross_entropy, drawn

# Layer widths.  A text chain starts at the vocabulary's size; a convolution is 3 x 3 between channels; a backbone gives 512 features.
SMALL_TEXT, SMALL_HEAD, SMALL_CHANNELS, SMALL_IMAGE = (64, 32), (96, 48), (3, 16, 32, 48), 48
LARGE_TEXT, LARGE_HEAD, BACKBONE_FEATURES, LARGE_IMAGE = (256, 128), (256, 96), 512, 128
# Shares of units dropped in training behind each layer of a part that ends in a rectifier.
DROPPED = {
    "small_text": {"text": (0.15,)}, "small_image": {"projection": (0.15,)}, "small_multimodal": {"projection": (0.15,), "text": (0.10,), "head": (0.20,)},
    "large_multimodal": {"projection": (0.20,), "text": (0.20, 0.10), "head": (0.25,)},
}
NETWORKS = ("small_text", "small_image", "small_multimodal", "small_multimodal_no_auxiliary", "large_multimodal", "large_multimodal_no_auxiliary")


def _dense(name: str, *widths: int) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for k, (a, b) in enumerate(zip(widths[:-1], widths[1:], strict=True)):
        out |= {f"{name}{k}": (b, a), f"{name}{k}_bias": (b,)}
    return out


def _image_encoder() -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for k, (a, b) in enumerate(zip(SMALL_CHANNELS[:-1], SMALL_CHANNELS[1:], strict=True)):
        out |= {f"convolution{k}": (b, a, 3, 3), f"convolution{k}_bias": (b,)}
    return out | _dense("projection", SMALL_CHANNELS[-1], SMALL_IMAGE)


def layers(network: str, text_size: int, classes: int = 3, categories: int = 8) -> dict[str, tuple[int, ...]]:
    """Shape of every trainable array; a large network's frozen backbone is not among them."""
    if network not in NETWORKS:
        raise ValueError(f"unknown network: {network}")
    size, _, kind = network.partition("_")
    if kind == "text":
        return _dense("text", text_size, *SMALL_TEXT, classes)
    if kind == "image":
        return _image_encoder() | _dense("head", SMALL_IMAGE, classes)
    small = size == "small"
    text, head, image = (SMALL_TEXT, SMALL_HEAD, SMALL_IMAGE) if small else (LARGE_TEXT, LARGE_HEAD, LARGE_IMAGE)
    out = _image_encoder() if small else _dense("projection", BACKBONE_FEATURES, image)
    out |= _dense("text", text_size, *text) | _dense("head", image + text[-1], *head, classes)
    if not kind.endswith("no_auxiliary"):
        out |= _dense("image_category", image, categories) | _dense("text_category", text[-1], categories)
    return out


def parameter_counts(spark: SparkSession, text_size: int, classes: int = 3, categories: int = 8) -> DataFrame:
    """network, layer, parameters of every network."""
    rows = [(n, k, prod(shape)) for n in NETWORKS for k, shape in layers(n, text_size, classes, categories).items()]
    return spark.createDataFrame(rows, "network string, layer string, parameters long")


class _Value:
    """An array on the way through a network, and the loss's gradient by it."""

    __slots__ = ("array", "gradient")

    def __init__(self, array: np.ndarray) -> None:
        self.array, self.gradient = array, np.zeros_like(array)


class _Tape:
    """The operations of one pass, each with what hands its gradient back."""

    def __init__(self, weights: dict[str, np.ndarray], rng: np.random.Generator | None) -> None:
        self.weights, self.rng = weights, rng
        self.gradients: dict[str, np.ndarray] = {}
        self.backward: list[Callable[[], None]] = []

    def put(self, array: np.ndarray, back: Callable[[np.ndarray], None]) -> _Value:
        out = _Value(array)
        self.backward.append(lambda: back(out.gradient))
        return out

    def dense(self, name: str, x: _Value) -> _Value:
        w = self.weights[name]

        def back(d: np.ndarray) -> None:
            self.gradients[name], self.gradients[f"{name}_bias"] = d.T @ x.array, d.sum(axis=0)
            x.gradient += d @ w

        return self.put(x.array @ w.T + self.weights[f"{name}_bias"], back)

    def convolution(self, name: str, x: _Value) -> _Value:
        """3 x 3 filters at every place, with zeros around the picture."""
        w = self.weights[name]
        around = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(a, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))
        windows = around(x.array)  # rows, channels, y, x, 3, 3

        def back(d: np.ndarray) -> None:
            self.gradients[name] = np.tensordot(d, windows, axes=((0, 2, 3), (0, 2, 3)))
            self.gradients[f"{name}_bias"] = d.sum(axis=(0, 2, 3))
            x.gradient += np.tensordot(around(d), w[:, :, ::-1, ::-1], axes=((1, 4, 5), (0, 2, 3))).transpose(0, 3, 1, 2)

        out = np.tensordot(windows, w, axes=((1, 4, 5), (1, 2, 3))).transpose(0, 3, 1, 2)
        return self.put(out + self.weights[f"{name}_bias"][None, :, None, None], back)

    def rectified(self, x: _Value) -> _Value:
        def back(d: np.ndarray) -> None:
            x.gradient += d * (x.array > 0)

        return self.put(np.maximum(x.array, 0), back)

    def dropped(self, x: _Value, share: float) -> _Value:
        if self.rng is None or not share:
            return x
        keep = (self.rng.random(x.array.shape) >= share) / (1 - share)

        def back(d: np.ndarray) -> None:
            x.gradient += d * keep

        return self.put(x.array * keep, back)

    def pooled(self, x: _Value) -> _Value:
        """The largest value of each 2 x 2 places; a last odd row or column is left out.  Of equal values the first gets the gradient."""
        n, c, h, w = x.array.shape
        h, w = h // 2, w // 2
        four = x.array[:, :, : 2 * h, : 2 * w].reshape(n, c, h, 2, w, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h, w, 4)
        best = four.argmax(axis=4)[..., None]

        def back(d: np.ndarray) -> None:
            out = np.zeros_like(four)
            np.put_along_axis(out, best, d[..., None], axis=4)
            x.gradient[:, :, : 2 * h, : 2 * w] += out.reshape(n, c, h, w, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, 2 * h, 2 * w)

        return self.put(np.take_along_axis(four, best, axis=4)[..., 0], back)

    def averaged(self, x: _Value) -> _Value:
        """The mean of each channel."""
        n, c, h, w = x.array.shape

        def back(d: np.ndarray) -> None:
            x.gradient += d[:, :, None, None] / (h * w)

        return self.put(x.array.mean(axis=(2, 3)), back)

    def beside(self, a: _Value, b: _Value) -> _Value:
        def back(d: np.ndarray) -> None:
            a.gradient += d[:, : a.array.shape[1]]
            b.gradient += d[:, a.array.shape[1] :]

        return self.put(np.concatenate((a.array, b.array), axis=1), back)


class RelationNetwork:
    """One of NETWORKS, with first weights drawn() from digests; what training.fit(), training.evaluate() and models.score() ask of a network.

    image: (3, height, width) of a small network's pictures, given as height * width * 3 numbers channel by channel; of a large one (512,) features."""

    def __init__(self, network: str, image: tuple[int, ...], text_size: int, classes: int = 3, categories: int = 8, seed: int = 44) -> None:
        shapes = layers(network, text_size, classes, categories)
        large = network.startswith("large")
        if large and tuple(image) != (BACKBONE_FEATURES,) or not large and (len(image) != 3 or image[0] != SMALL_CHANNELS[0] or min(image[1:]) < 4):
            raise ValueError(f"a {network} network doesn't read {image}")
        self.kind, self.image, self.auxiliary = network, tuple(image), any(k.startswith("image_category") for k in shapes)
        self.dropout = DROPPED[network.removesuffix("_no_auxiliary")]
        self.sizes = {"image_size": prod(image), "image": list(image), "text_size": text_size, "classes": classes, "categories": categories}
        fan_in = lambda k: prod(shapes[k.removesuffix("_bias")][1:])
        self.weights = {k: drawn(seed, k, (s[0], prod(s[1:]))).reshape(s) / np.sqrt(fan_in(k)) for k, s in shapes.items()}

    def _part(self, tape: _Tape, name: str, x: _Value, open_end: bool = False) -> _Value:
        """Dense layers of one part, each rectified and maybe dropped; with an open end the last one is neither."""
        names = [k for k in self.weights if k.removeprefix(name).isdigit()]
        for at, k in enumerate(names):
            x = tape.dense(k, x)
            if not (open_end and k == names[-1]):
                x = tape.dropped(tape.rectified(x), dict(enumerate(self.dropout.get(name, ()))).get(at, 0.0))
        return x

    def _image(self, tape: _Tape, image: np.ndarray) -> _Value:
        x = _Value(np.asarray(image, float).reshape(-1, *self.image))
        if len(self.image) == 3:
            convolutions = [k for k in self.weights if k.startswith("convolution") and not k.endswith("_bias")]
            for k in convolutions:
                x = tape.rectified(tape.convolution(k, x))
                x = tape.averaged(x) if k == convolutions[-1] else tape.pooled(x)
        return self._part(tape, "projection", x)

    def _pass(self, tape: _Tape, image: np.ndarray, text: np.ndarray) -> dict[str, _Value]:
        if self.kind == "small_text":
            return {"o": self._part(tape, "text", _Value(np.asarray(text, float)), open_end=True)}
        sides = {"image": self._image(tape, image)}
        if self.kind != "small_image":
            sides["text"] = self._part(tape, "text", _Value(np.asarray(text, float)))
        joined = tape.beside(sides["image"], sides["text"]) if len(sides) == 2 else sides["image"]
        out = {"o": self._part(tape, "head", joined, open_end=True)}
        if self.auxiliary:
            out |= {side: tape.dense(f"{side}_category0", x) for side, x in sides.items()}
        return out

    def forward(self, image: np.ndarray, text: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Logits: o of the classes, with category heads image and text of the categories; units are dropped only under a generator."""
        return {k: v.array for k, v in self._pass(_Tape(self.weights, rng), image, text).items()}

    def loss_and_gradients(self, image: np.ndarray, text: np.ndarray, label: np.ndarray, image_category: np.ndarray | None = None, text_category: np.ndarray | None = None, auxiliary_weight: float = 0.15, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients over a batch; with a generator under dropout."""
        tape, total = _Tape(self.weights, rng), 0.0
        out = self._pass(tape, image, text)
        for k, target, weight in (("o", label, 1.0), ("image", image_category, auxiliary_weight), ("text", text_category, auxiliary_weight)):
            if k in out:
                loss, d = cross_entropy(out[k].array, target)
                total += weight * loss
                out[k].gradient += weight * d
        for back in reversed(tape.backward):
            back()
        return total, tape.gradients

    def predict(self, image: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Probabilities of the classes."""
        z = self.forward(image, text)["o"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
