"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties (FTRL-Proximal), then one temperature is fitted on labelled rows that training left
out.  Document frequencies cover all training rows; the regression is fitted on a bounded sample, max_train_docs, spread evenly over the languages, of which
the max_languages most frequent are learned (both bound the model; repeated rows of the sample count once).

Only the text is an input of a prediction.  Texts that are null or have no letter are `und` with score 0; without labelled rows every text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
BUCKET_BITS = 15
MAX_N = 3
MAX_TRAIN_DOCS = 3_000
MAX_LANGUAGES = 512
#: Score below which a document's language counts as unknown.
LEAST_SCORE = 0.4
_CHUNK = 1 << 18
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each hashed character n-gram, n = 1 to MAX_N, is in the lower-cased text."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), _CHUNK):  # windows of a chunk may reach into the next one
        part = points[at : at + _CHUNK + MAX_N - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, MAX_N + 1):
            h = (h[: len(part) - n + 1] ^ (part[n - 1 :] * _FACTORS[n - 1] + np.uint32(n))) * np.uint32(0x27D4EB2F)
            h ^= h >> np.uint32(15)
            total += np.bincount((h[:_CHUNK] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS), minlength=len(total))
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[bucket]
        return (x / (np.sqrt((x * x).sum()) or 1)).astype(np.float32)

    def logits(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.features(bucket, count) @ self.weights[bucket] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        c = counts(text)
        bucket = np.flatnonzero(c)
        p = softmax(self.logits(bucket, c[bucket]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias from rows (bucket, value, class)."""
    z, n = np.zeros((buckets + 1, classes), np.float32), np.zeros((buckets + 1, classes), np.float32)
    order = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)).astype(np.float32)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            bucket, x, label = rows[k]
            at, v = np.append(bucket, buckets), np.append(x, np.float32(0.1))
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(v @ w)
            p[label] -= 1
            g = v[:, None] * p[None, :]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    w = weights(z, n)
    return w[:-1], w[-1] * 0.1


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, r = np.log(0.25), np.log(20.0), (5**0.5 - 1) / 2
    while b - a > 1e-4:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and in how many of them each bucket is; one row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                df += counts(text) > 0
                rows += 1
        bucket = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(bucket, -1), pa.int64()), "n": pa.array(np.append(df[bucket], rows), pa.int64())})

    found = common.map_arrow(texts, run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most the buckets
    out, rows = np.zeros(1 << BUCKET_BITS, np.int64), 0
    for bucket, n in found:
        if bucket < 0:
            rows = n
        else:
            out[bucket] = n
    return rows, out


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from docs (doc_id, text, lang).  Rows with crc32(doc_id) mod 5 = 0, null doc_id, text or lang are not used; those with 1 only calibrate, unless a
    language has no others."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and text is not null and lang is not null").withColumn("fold", common.fold_of(F.col("doc_id"))).where("fold <> 0")
    per_lang = {r[0]: r[1] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    languages = sorted(per_lang)
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    rows, df = document_frequency(train.select("text"))
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)

    cap, scale = max(1, max_train_docs // len(languages)), 1 << 30
    limits = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(scale, scale * cap // per_lang[lang]))])
    sample = train.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(scale)) < limits[F.col("lang")]).dropDuplicates(["doc_id", "text", "lang"])
    place = {lang: k for k, lang in enumerate(languages)}

    def featurized(batch: pa.RecordBatch) -> list:
        found = [counts(t) for t in batch.column(1).to_pylist()]
        buckets = [np.flatnonzero(c) for c in found]
        return [batch.column(0), batch.column(2), batch.column(3), buckets, [c[b] for c, b in zip(found, buckets, strict=True)]]

    taken = common.mapped(sample.select("doc_id", "text", "lang", "fold"), featurized, "doc_id bigint, lang string, fold bigint, bucket array<int>, n array<int>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    learned = {lang for lang, fold in zip(taken.column("lang").to_pylist(), taken.column("fold").to_pylist(), strict=True) if fold != 1}
    model = Model(languages, idf, np.zeros((len(df), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    fitted, held, labels = [], [], []
    for lang, fold, bucket, n in zip(*(taken.column(c) for c in ("lang", "fold", "bucket", "n")), strict=True):
        b, c = bucket.values.to_numpy(), n.values.to_numpy()
        if fold.as_py() == 1 and lang.as_py() in learned:
            held.append((b, c))
            labels.append(place[lang.as_py()])
        else:
            fitted.append((b, model.features(b, c), place[lang.as_py()]))
    model.weights, model.bias = ftrl(fitted, len(df), len(languages))
    if held:
        model.temperature = fit_temperature(np.array([model.logits(b, c) for b, c in held]), np.array(labels))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; null doc_ids give a null held_out."""

    def rows(batch: pa.RecordBatch) -> list:
        found = [model.predict(t) for t in batch.column(1).to_pylist()]
        return [batch.column(0), batch.column(2), [f[0] for f in found], [f[1] for f in found]]

    doc_id = F.col("doc_id").cast("long")
    return common.mapped(docs.select(doc_id.alias("doc_id"), "text", (common.fold_of(doc_id) == 0).alias("held_out")), rows, "doc_id bigint, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is known with at least this score, all rows if no language could be learned; all columns stay."""
    if not model.languages:
        return docs
    return common.filtered(docs, "text", lambda texts: [lang != UNKNOWN and score >= least_score for lang, score in map(model.predict, texts)])
