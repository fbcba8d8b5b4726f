"""Ranks and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the ordering digest that split a partition's ranking between tasks.
PREFIX = 2


def hash_rank(df: DataFrame, by: list[str], digest: Column, tie: list[str], rank: str = "rank", prefix: int = PREFIX) -> DataFrame:
    """df with the row's rank, from 1, in its group by a hexadecimal digest and then tie, and the group's size as <rank>_of.

    A group's rows are ranked in 16^prefix parts by the digest's first digits, and the parts' sizes are added up: one group of any size is no single task."""
    df = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, prefix))
    sizes = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    sizes = sizes.select(*by, "_part", (F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias(f"{rank}_of"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_digest", *tie))
    return df.withColumn("_inside", inside).join(sizes, [*by, "_part"]).withColumn(rank, F.col("_before") + F.col("_inside")).drop("_digest", "_part", "_before", "_inside")


def stratified_split(df: DataFrame, by: str, id_col: str, fraction: float = 0.15, seed: str = "44") -> DataFrame:
    """df with rank and split: in every group, by digest of seed and id, first test, then validation, the rest train; sizes round halves to even."""
    ranked = hash_rank(df, [by], F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256), [id_col])
    part = F.bround(F.col("rank_of") * F.lit(fraction), 0).cast("long")
    return ranked.withColumn("split", F.when(F.col("rank") <= part, "test").when(F.col("rank") <= 2 * part, "validation").otherwise("train")).drop("rank_of")


def sample(df: DataFrame, by: str, id_col: str, n: int, seed: str = "44") -> DataFrame:
    """n rows of every group, those with the smallest digest of seed and id."""
    ranked = hash_rank(df, [by], F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256), [id_col])
    return ranked.where(F.col("rank") <= n).drop("rank_of")


def early_stop(history: DataFrame, by: str, step: str, loss: str, patience: int = 10, least_gain: float = 1e-4) -> DataFrame:
    """by, best_step, best_loss, stopped_step: a loss counts as better if it is lower by more than least_gain; after patience steps without, it stops.

    A group's history is one short sequence by nature: it is folded in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(loss).alias("l"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("stale"), F.lit(None).cast("long").alias("stopped"))

    def fold(acc, x):
        better = acc["best"].isNull() | (x["l"] < acc["best"] - least_gain)
        stale = F.when(better, F.lit(0)).otherwise(acc["stale"] + 1)
        new = F.struct(F.when(better, x["l"]).otherwise(acc["best"]).alias("best"), F.when(better, x["s"]).otherwise(acc["at"]).alias("at"), stale.alias("stale"), F.when(stale >= patience, x["s"]).alias("stopped"))
        return F.when(acc["stopped"].isNotNull(), acc).otherwise(new)

    folded = history.groupBy(by).agg(F.aggregate(rows, start, fold).alias("f"))
    return folded.select(by, F.col("f.at").alias("best_step"), F.col("f.best").alias("best_loss"), F.col("f.stopped").alias("stopped_step"))


def running_mean(df: DataFrame, by: str, order: str, value: str, weight: str) -> DataFrame:
    """df with the weighted mean of value over the group's rows so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))
