"""Training of head networks on the cluster, by synchronous steps over a packed table.

pack() deals the rows out to chunks by a seeded digest, once, and writes each chunk as one packed row.  Each epoch takes the chunks in a new order, so batches differ
from epoch to epoch.  An epoch of several steps is one job: its chunks are dealt to a few tasks that run side by side (a barrier stage), each reads its own in order, and
at each step the tasks add up the gradients of their chunks and take the same Adam step.  A step over all chunks is a job of its own, whose sums are added up in a tree.
The driver holds the weights, the sums, and the chunks' numbers.  Dropped units come from (seed, epoch, chunk): a task that runs again drops the same ones."""

from __future__ import annotations

import copy
import secrets
import socket
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import models

#: Chunks of a batch.
CHUNKS = 4
_SCHEMA = "chunk bigint, rows bigint, x binary, y binary"


@dataclass(frozen=True)
class Packed:
    """Rows below path: a chunk's number, its rows, x (float32 features, image then text) and y (int64 label and category codes) as bytes."""

    path: str
    chunks: list[int]
    rows: int
    features: int
    codes: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_SCHEMA).parquet(self.path)

    def unpacked(self, x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(x, np.float32).reshape(-1, self.features).astype(float), np.frombuffer(y, np.int64).reshape(-1, self.codes)

    def read(self, spark: SparkSession, chunks: Iterable[int] | None = None):
        """(chunk, x, y) of the given chunks, of all if None, as an RDD."""
        rows, some = self.frame(spark), set(self.chunks if chunks is None else chunks)
        if len(some) < len(self.chunks):
            rows = rows.where(F.col("chunk").isin(sorted(some)))
        return rows.select("chunk", "x", "y").rdd.map(lambda r: (r[0], *self.unpacked(r[1], r[2])))


@dataclass(frozen=True)
class History:
    """One entry an epoch: epoch, train_loss, and with validation rows validation_accuracy and validation_macro_f1; best_epoch is the first of most macro F1."""

    epochs: list[dict] = field(default_factory=list)
    best_epoch: int | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e["epoch"], e["train_loss"], e.get("validation_accuracy"), e.get("validation_macro_f1"), e["epoch"] == self.best_epoch) for e in self.epochs]
        return spark.createDataFrame(rows, "epoch int, train_loss double, validation_accuracy double, validation_macro_f1 double, best boolean")


def pack(rows: DataFrame, codes: tuple[str, ...] = ("label",), batch: int = models.BATCH_ROWS, seed: int = 44, image: str = "image", text: str = "text") -> Packed:
    """rows (image array<double>, text array<double>, integer codes) as chunks of about batch / CHUNKS rows.

    Equal rows are counted before they are shuffled and dealt out by their number, so no number of copies meets in one chunk.  A null feature array or
    code is an error; no rows are one too."""
    whole = rows.select(*[_present(rows, c) for c in (image, text, *codes)])
    counted = whole.groupBy(image, text, *codes).agg(F.count("*").alias("copies"))
    each = sinks.written(counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copies"), "training-rows")
    n, features = each.agg(F.count("*"), F.first(F.size(image) + F.size(text))).first()
    if not n:
        raise ValueError("no rows to train on")
    many = max(1, -(-n * CHUNKS // batch))
    order = each.withColumn("order", F.xxhash64(F.lit(seed), image, text, *codes, "copy")).withColumn("chunk", F.pmod("order", F.lit(many)))
    dealt = order.repartition("chunk").sortWithinPartitions("chunk", "order").select("chunk", image, text, *codes)
    path = sinks.shared_dir(rows.sparkSession, "training")
    dealt.mapInArrow(_packed, _SCHEMA).write.parquet(path)
    found = rows.sparkSession.read.schema(_SCHEMA).parquet(path).select("chunk").collect()  # a number a chunk
    return Packed(path, sorted(r[0] for r in found), n, features, len(codes))


def _present(rows: DataFrame, column: str):
    wanted = rows.schema[column].dataType
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"no {column}")).cast(wanted)).alias(column)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, image, text, codes), chunk after chunk, as one row a chunk."""
    now, x, y = None, [], []

    def out() -> pa.RecordBatch:
        xs, ys = np.concatenate(x), np.concatenate(y)
        return pa.RecordBatch.from_pylist([{"chunk": now, "rows": len(xs), "x": xs.tobytes(), "y": ys.tobytes()}])

    for batch in batches:
        chunk = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if now is not None and chunk[a] != now:
                yield out()
                x, y = [], []
            now, part = int(chunk[a]), batch.slice(a, b - a)
            x.append(np.concatenate([np.array(part.column(k).to_pylist(), np.float32).reshape(b - a, -1) for k in (1, 2)], axis=1))
            y.append(np.stack([part.column(k).to_numpy().astype(np.int64) for k in range(3, part.num_columns)], axis=1))
    if now is not None:
        yield out()


Sums = tuple[int, float, dict]


def add(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], a[1] + b[1], {k: a[2][k] + b[2][k] for k in a[2]}


def gradient_sums(network: models.HeadNetwork, chunk: tuple, auxiliary_weight: float, dropout: tuple[int, int] | None) -> Sums:
    """Rows, summed loss and summed gradients of a chunk; dropout: (seed, epoch), None for none."""
    number, x, y = chunk
    n = network.sizes["image_size"]
    rng = None if dropout is None else np.random.default_rng([*dropout, number])
    loss, g = network.loss_and_gradients(x[:, :n], x[:, n:], *y.T[: 3 if network.auxiliary else 1], auxiliary_weight=auxiliary_weight, rng=rng)
    return len(x), len(x) * loss, {k: len(x) * v for k, v in g.items()}


def step(spark: SparkSession, network: models.HeadNetwork, data: Packed, chunks: list[int], auxiliary_weight: float = 0.15, dropout: tuple[int, int] | None = None) -> Sums:
    """gradient_sums() over the given chunks, added up in a tree."""
    sent = spark.sparkContext.broadcast(network)  # as large as the model

    def local(rows: Iterable) -> Iterator[Sums]:
        found = [gradient_sums(sent.value, r, auxiliary_weight, dropout) for r in rows]
        if found:
            yield reduce(add, found)

    try:
        return data.read(spark, chunks).mapPartitions(local).treeReduce(add)
    finally:
        sent.destroy()


def _dealt(spark: SparkSession, data: Packed, order: list[int], chunks: int, tasks: int):
    """(position, chunk, x, y) as an RDD of so many partitions, each in order; the chunks of every batch are dealt to all of them."""
    positions = spark.createDataFrame(list(enumerate(order)), "position bigint, chunk bigint")
    rows = data.frame(spark).join(positions, "chunk").select("position", "chunk", "x", "y")
    task = (F.col("position") % chunks % tasks).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("position").rdd.map(lambda r: (r[0], r[1], *data.unpacked(r[2], r[3])))


def _met(context: BarrierTaskContext, ends: ExitStack) -> list[Connection]:
    """Connections of the tasks of a barrier stage: of the first one to the others in order, of another to the first.  Spark's own allGather takes a second a call."""
    me, hosts = context.partitionId(), [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()]
    if me == 0:
        key = secrets.token_hex(16)
        with Listener(("", 0), backlog=len(hosts), authkey=key.encode()) as door:
            context.allGather(f"{door.address[1]} {key}")
            found = [ends.enter_context(door.accept()) for _ in hosts[1:]]
        peers = [c for _, c in sorted(((c.recv(), c) for c in found), key=lambda p: p[0])]
    else:
        port, key = next(m for m in context.allGather("") if m).split()
        peers = [ends.enter_context(Client((hosts[0], int(port)), authkey=key.encode()))]
        peers[0].send(me)
    for c in peers:
        with socket.socket(fileno=socket.dup(c.fileno())) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return peers


def _together(own: Sums | None, peers: list[Connection], first: bool) -> Sums:
    """The sums of all tasks, the same in each."""
    if not first:
        peers[0].send(own)
        return peers[0].recv()
    total = reduce(add, [m for m in (own, *(c.recv() for c in peers)) if m is not None])
    for c in peers:
        c.send(total)
    return total


def steps(
    spark: SparkSession, network: models.HeadNetwork, adam: models.Adam, data: Packed, order: list[int], chunks: int, auxiliary_weight: float = 0.15, dropout: tuple[int, int] | None = None,
) -> tuple[float, dict[str, np.ndarray], models.Adam]:
    """The summed loss, the weights and the optimiser after Adam steps over batches of so many chunks in the given order, in one job."""
    tasks = max(1, min(chunks, spark.sparkContext.defaultParallelism))
    sent, many = spark.sparkContext.broadcast((network, adam)), len(order)  # a few times as large as the model

    def local(rows: Iterable) -> Iterator[tuple]:
        context, (net, optimiser) = BarrierTaskContext.get(), copy.deepcopy(sent.value)  # a worker keeps what was sent
        first, rows, loss = context.partitionId() == 0, iter(rows), 0.0
        with ExitStack() as ends:
            peers, row = _met(context, ends), next(rows, None)
            for at in range(0, many, chunks):
                own = None
                while row is not None and row[0] < at + chunks:
                    found = gradient_sums(net, row[1:], auxiliary_weight, dropout)
                    own, row = found if own is None else add(own, found), next(rows, None)
                n, total, g = _together(own, peers, first)
                optimiser.step(net.weights, {k: v / n for k, v in g.items()})
                loss += total
        if first:
            yield loss, net.weights, optimiser

    try:
        ((loss, weights, adam),) = _dealt(spark, data, order, chunks, tasks).barrier().mapPartitions(local).collect()  # as large as the model
        return loss, weights, adam
    finally:
        sent.destroy()


def evaluate(spark: SparkSession, network: models.HeadNetwork, data: Packed) -> tuple[float, float, np.ndarray]:
    """Accuracy, macro F1 (over the classes that occur in truth or prediction) and the confusion matrix (rows: truth)."""
    n, classes, sent = network.sizes["image_size"], network.sizes["classes"], spark.sparkContext.broadcast(network)

    def local(rows: Iterable) -> Iterator[np.ndarray]:
        out = np.zeros((classes, classes), np.int64)
        for _, x, y in rows:
            np.add.at(out, (y[:, 0], sent.value.forward(x[:, :n], x[:, n:])["o"].argmax(axis=1)), 1)
        yield out

    try:
        matrix = data.read(spark).mapPartitions(local).treeReduce(lambda a, b: a + b)
    finally:
        sent.destroy()
    hits, support = np.diag(matrix), matrix.sum(axis=1) + matrix.sum(axis=0)
    seen = support > 0
    return float(hits.sum() / matrix.sum()), float((2 * hits[seen] / support[seen]).mean()), matrix


def fit(
    spark: SparkSession, network: models.HeadNetwork, train: Packed, epochs: int, validation: Packed | None = None, rate: float = 1e-3,
    auxiliary_weight: float = 0.15, seed: int = 44, dropout: bool = True, chunks: int = CHUNKS, decay: float = 0.0,
) -> History:
    """Adam steps over batches of some chunks.  With validation rows the network ends as it was after its best epoch, else after the last one.

    Where executors come and go (spark.dynamicAllocation.enabled) Spark has no tasks side by side, so each step is a job there."""
    if epochs < 1:
        raise ValueError("epochs must be at least one")
    adam, history, best = models.Adam(rate, decay), [], None
    together = len(train.chunks) > chunks and spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
    for epoch in range(1, epochs + 1):
        order = [train.chunks[k] for k in np.random.default_rng([seed, epoch]).permutation(len(train.chunks))]
        loss, dropped = 0.0, (seed, epoch) if dropout else None
        if together:
            loss, network.weights, adam = steps(spark, network, adam, train, order, chunks, auxiliary_weight, dropped)
        else:
            for at in range(0, len(order), chunks):
                n, total, g = step(spark, network, train, order[at : at + chunks], auxiliary_weight, dropped)
                adam.step(network.weights, {k: v / n for k, v in g.items()})
                loss += total
        history.append({"epoch": epoch, "train_loss": loss / train.rows})
        if validation is not None:
            accuracy, macro_f1, _ = evaluate(spark, network, validation)
            history[-1] |= {"validation_accuracy": accuracy, "validation_macro_f1": macro_f1}
            if best is None or macro_f1 > best[0]:
                best = macro_f1, epoch, {k: w.copy() for k, w in network.weights.items()}
    if best is not None:
        network.weights = best[2]
    return History(history, best and best[1])
