"""Paired sign-flip tests and cluster bootstrap over groups.  Draws come from SHA-256, so that any engine can repeat them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .ranking import hash_rank

MAX_EXACT_GROUPS = 20
REPEATS = 100_000
BOOTSTRAP_REPEATS = 2_000
#: Groups up to which their counts (80 bytes each for three labels) are sent to every task.
LOCAL_GROUPS = 200_000
#: Slots of a replicate that a task draws at once, and bytes of all replicates' draws of one range of groups.
SLOTS, RANGE_BYTES = 5 << 17, 1 << 24


def paired(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """key, group, left_correct, right_correct of two models' rows (key, group, correct); different keys or groups are an error."""
    a = left.select(F.col(key).alias("_a"), F.col(group).alias("_ga"), F.col("correct").alias("left_correct"))
    b = right.select(F.col(key).alias("_b"), F.col(group).alias("_gb"), F.col("correct").alias("right_correct"))
    bad = F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("_ga").eqNullSafe(F.col("_gb"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return both.select(F.when(bad, F.raise_error(F.lit("the models' samples or groups differ")).cast(left.schema[key].dataType)).otherwise(F.col("_a")).alias(key), F.col("_ga").alias(group), "left_correct", "right_correct")


def differences(pairs: DataFrame, group: str) -> DataFrame:
    """group, difference (left correct minus right correct), and counts that a summary needs."""
    left, right = F.col("left_correct").cast("int"), F.col("right_correct").cast("int")
    return pairs.groupBy(group).agg(F.sum(left - right).alias("difference"), F.count("*").alias("rows"), F.sum(left).alias("left_total"), F.sum(right).alias("right_total"), F.sum(left * (1 - right)).alias("left_only"), F.sum(right * (1 - left)).alias("right_only"))


def summary(diffs: DataFrame) -> DataFrame:
    d = F.col("difference")
    return diffs.agg(
        F.count("*").alias("independent_groups"), F.sum("rows").alias("paired_rows"), F.sum("left_total").alias("left_correct_total"), F.sum("right_total").alias("right_correct_total"), F.sum(d).alias("observed_difference"),
        (F.sum(d) / F.sum("rows")).alias("observed_accuracy_difference"), F.sum((d > 0).cast("long")).alias("left_better_groups"), F.sum((d < 0).cast("long")).alias("right_better_groups"), F.sum((d == 0).cast("long")).alias("tied_groups"),
        F.sum("left_only").alias("left_only_rows"), F.sum("right_only").alias("right_only_rows"), (F.sum("left_only") + F.sum("right_only")).alias("discordant_rows"),
    )


def sign_flip_exact(diffs: DataFrame, max_groups: int = MAX_EXACT_GROUPS) -> DataFrame:
    """assignments, extreme, p_value over all sign vectors of at most max_groups groups."""
    values = [r[0] for r in diffs.select("difference").limit(max_groups + 1).collect()]
    if not 2 <= len(values) <= max_groups:
        raise ValueError(f"from 2 to {max_groups} groups are needed for all sign vectors")
    total = sum((F.when(F.col("id").bitwiseAND(1 << k) > 0, v).otherwise(-v) for k, v in enumerate(values)), F.lit(0))
    extreme = F.sum((F.abs(total) >= abs(sum(values))).cast("long"))
    return diffs.sparkSession.range(1 << len(values)).agg(F.count("*").alias("assignments"), extreme.alias("extreme")).withColumn("p_value", F.col("extreme") / F.col("assignments"))


def sign_flip_monte_carlo(diffs: DataFrame, group: str, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """repeats, extreme, p_value = (extreme + 1) / (repeats + 1).  Groups without a difference change no sum and are left out.

    A group's sign in repeat r is bit r mod 256, the highest first, of the SHA-256 of "seed|r div 256|group": 1 keeps it.  Every task adds up the sums of all
    repeats over its groups; one number a repeat and task is shuffled."""
    observed = diffs.agg(F.abs(F.coalesce(F.sum("difference"), F.lit(0)))).first()[0]
    counted = diffs.where("difference <> 0").select(F.col(group).cast("string").alias("g"), F.col("difference").cast("long").alias("d"))
    blocks = -(-repeats // 256)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(blocks * 256, np.int64), False
        for batch in batches:
            for g, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digests = b"".join(hashlib.sha256(f"{seed}|{k}|{g}".encode()).digest() for k in range(blocks))
                total += d * (2 * np.unpackbits(np.frombuffer(digests, np.uint8)).astype(np.int64) - 1)
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(repeats)), pa.array(total[:repeats])], names=["r", "s"])

    tasks = diffs.sparkSession.sparkContext.defaultParallelism
    sums = counted.repartition(tasks, "g").mapInArrow(partial, "r bigint, s bigint").groupBy("r").agg(F.sum("s").alias("s"))
    met = sums.agg(F.sum((F.abs("s") >= observed).cast("long")).alias("hit"), F.count("*").alias("n"))
    # Without any difference every sum is 0 and as extreme as the observed one.
    extreme = F.when(F.col("n") == 0, repeats).otherwise(F.col("hit"))
    return met.select(F.lit(repeats).cast("long").alias("repeats"), extreme.cast("long").alias("extreme")).withColumn("p_value", (F.col("extreme") + 1) / (F.col("repeats") + 1))


def sign_flip(diffs: DataFrame, group: str, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """The exact test for few groups, else the Monte-Carlo test; columns method, assignments, extreme, p_value."""
    if diffs.limit(MAX_EXACT_GROUPS + 1).count() <= MAX_EXACT_GROUPS:
        return sign_flip_exact(diffs).select(F.lit("exact").alias("method"), "assignments", "extreme", "p_value")
    return sign_flip_monte_carlo(diffs, group, repeats, seed).select(F.lit("monte_carlo").alias("method"), F.col("repeats").alias("assignments"), "extreme", "p_value")


def bootstrap_replicates(df: DataFrame, group: str, labels: list[str], repeats: int = BOOTSTRAP_REPEATS, seed: int = 42, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """replicate, accuracy, macro_f1 of whole groups drawn with replacement, as many as there are.

    Rows are reduced to a group's confusion counts before any draw; draws of one group in one replicate are counted, not repeated.  Slot s of a replicate takes the
    group whose number is the (s mod 5)-th 48-bit part of the SHA-256 of "seed|replicate|s div 5", modulo the number of groups.  Up to
    LOCAL_GROUPS groups the counts are sent to every task, which then makes whole replicates; beyond it a replicate's draws are counted by number, and ranges of these
    counts meet the groups' counts there as products of matrices."""
    return _replicates(_group_counts(df, group, labels, label, prediction), labels, repeats, seed)


def _group_counts(df: DataFrame, group: str, labels: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """number, confusion counts and rows (n) of every group; written, since it is read for each seed."""
    cells = [F.sum(((F.col(label) == a) & (F.col(prediction) == b)).cast("long")).alias(f"c{i}{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    stats = _numbered(df.groupBy(group).agg(*cells, F.count("*").alias("n")), group)
    return sinks.written(stats.select("number", *[c for c in stats.columns if c not in ("number", group)]), "bootstrap-groups")


def _replicates(stats: DataFrame, labels: list[str], repeats: int, seed: int) -> DataFrame:
    n, k = stats.count(), range(len(labels))
    names = [*(f"c{i}{j}" for i in k for j in k), "n"]
    sums = _drawn_locally(stats, names, n, repeats, seed) if n <= LOCAL_GROUPS else _drawn_by_range(stats, names, n, repeats, seed)
    hits = sum((F.col(f"c{i}{i}") for i in k), F.lit(0))

    def f1(i: int) -> Column:
        both = sum((F.col(f"c{i}{j}") + F.col(f"c{j}{i}") for j in k), F.lit(0))
        return F.when(both > 0, 2.0 * F.col(f"c{i}{i}") / both)

    scores = [f1(i) for i in k]
    present = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
    return sums.select("replicate", (hits / F.col("n")).alias("accuracy"), (sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0)) / present).alias("macro_f1"))


def _numbers(seed: int, replicate: int, first: int, slots: int, n: int) -> np.ndarray:
    """The group numbers that so many slots of a replicate take, from digest first on."""
    digests = b"".join([hashlib.sha256(b"%d|%d|%d" % (seed, replicate, k)).digest() for k in range(first, first - (-slots // 5))])
    parts = np.zeros((len(digests) // 32, 5, 8), np.uint8)
    parts[:, :, 2:] = np.frombuffer(digests, np.uint8).reshape(-1, 32)[:, :30].reshape(-1, 5, 6)
    return (parts.view(">u8").ravel()[:slots] % np.uint64(n)).astype(np.int64)


def _drawn_locally(stats: DataFrame, names: list[str], n: int, repeats: int, seed: int) -> DataFrame:
    table = stats.select("number", *names).toArrow().sort_by("number")  # at most LOCAL_GROUPS rows
    counts = np.stack([table.column(c).to_numpy() for c in names], axis=1).astype(np.int64) if n else np.zeros((0, len(names)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for replicate in batch.column(0).to_pylist():
                numbers = _numbers(seed, replicate, 0, n, n)
                found.append(np.bincount(numbers, minlength=n) @ counts)
            sums = np.array(found, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[:, i]) for i in range(len(names)))], names=["replicate", *names])

    spark = stats.sparkSession
    replicates = spark.range(0, repeats if n else 0, 1, max(1, min(repeats, 4 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "replicate")
    return replicates.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("replicate", *names)))


def _drawn_by_range(stats: DataFrame, names: list[str], n: int, repeats: int, seed: int) -> DataFrame:
    """replicate and sums of names.  A task counts how often a replicate draws each number, in four bytes a group, and sends these counts range by range, in one
    byte each where they fit; a range meets its groups in one task, in RANGE_BYTES for all replicates."""
    size = max(1, RANGE_BYTES // max(1, repeats))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for replicate in batch.column(0).to_pylist():
                times = np.zeros(n, np.uint32)
                for at in range(0, n, SLOTS):
                    numbers = _numbers(seed, replicate, at // 5, min(SLOTS, n - at), n)
                    found, counts = np.unique(numbers, return_counts=True) if n > 8 * SLOTS else (slice(None), np.bincount(numbers, minlength=n))
                    times[found] += counts.astype(np.uint32)
                ranges = range(-(-n // size))
                parts = [times[r * size : (r + 1) * size] for r in ranges]
                narrow = [(p.astype(np.uint8) if p.max() < 256 else p).tobytes() for p in parts]
                for a in range(0, len(narrow), 1024):
                    some = narrow[a : a + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(some)), pa.int64()), pa.array([replicate] * len(some), pa.int64()), pa.array(some, pa.binary())], names=["range", "replicate", "times"])

    def multiply(drawn: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("number")
        counts = np.stack([groups.column(c).to_numpy() for c in names], axis=1).astype(float)  # sums stay below 2^53
        replicates, times = drawn.column("replicate").to_pylist(), drawn.column("times")
        sums = np.zeros((len(replicates), len(names)), np.int64)
        for a in range(0, len(replicates), 256):
            some = [np.frombuffer(t, np.uint8 if len(t) == len(counts) else np.uint32) for t in times.slice(a, 256).to_pylist()]
            sums[a : a + 256] = np.rint(np.stack(some).astype(float) @ counts)
        return pa.table([pa.array(replicates, pa.int64()), *(pa.array(sums[:, i]) for i in range(len(names)))], names=["replicate", *names])

    spark = stats.sparkSession
    replicates = spark.range(0, repeats, 1, max(1, min(repeats, 16 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "replicate")
    drawn = replicates.mapInArrow(draw, "range bigint, replicate bigint, times binary")
    groups = stats.select(F.floor(F.col("number") / size).cast("long").alias("range"), "number", *names)
    met = drawn.groupBy("range").cogroup(groups.groupBy("range")).applyInArrow(multiply, ", ".join(f"{c} bigint" for c in ("replicate", *names)))
    return met.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])


def _numbered(stats: DataFrame, group: str) -> DataFrame:
    """stats with a dense number from 0, by digest of the group."""
    ranked = hash_rank(stats.withColumn("_all", F.lit(1)), ["_all"], F.sha2(F.col(group).cast("string"), 256), [group], prefix=3)
    return ranked.withColumn("number", F.col("rank") - 1).drop("rank", "rank_of", "_all")


def bootstrap_interval(accuracy: DataFrame, macro_f1: DataFrame) -> DataFrame:
    """95% intervals of accuracy and macro F1, by linear interpolation; each metric from replicates of its own."""
    limits = lambda df, m: df.agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{name}") for name, q in (("low", 0.025), ("high", 0.975))])
    return limits(accuracy, "accuracy").crossJoin(limits(macro_f1, "macro_f1"))  # one row each


def bootstrap(df: DataFrame, group: str, labels: list[str], repeats: int = BOOTSTRAP_REPEATS, seed: int = 42, **columns: str) -> DataFrame:
    """The intervals of a table of predictions: accuracy drawn with the seed, macro F1 with the next one."""
    stats = _group_counts(df, group, labels, **columns)
    one, other = (_replicates(stats, labels, repeats, s) for s in (seed, seed + 1))
    return bootstrap_interval(one, other)
