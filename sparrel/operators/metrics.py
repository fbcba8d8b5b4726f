"""Classification metrics from confusion counts: one pass of partial counts over the rows, the rest over labels squared rows a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def confusion(df: DataFrame, by: list[str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """by, label, prediction, n for every pair that occurs."""
    return df.groupBy(*(by or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label in the given order, a column of counts per predicted label, zeros included."""
    counts = confusion(df, None, label, prediction)
    spark = df.sparkSession
    rows = spark.createDataFrame(list(enumerate(labels)), "position int, label string")
    wide = counts.groupBy("label").pivot("prediction", labels).agg(F.sum("n"))
    return rows.join(wide, "label", "left").na.fill(0, labels).select("position", "label", *labels)


def per_class(counts: DataFrame, by: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """by, label, precision, recall, f1, support from confusion counts.  Labels: the given ones, or those that occur in truth or prediction; 0/0 is 0."""
    by = by or []
    sides = F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("h")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h"))))
    sums = counts.select(*by, sides.alias("s")).groupBy(*by, F.col("s.c").alias("label")).agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.h").alias("hits"))
    if labels is not None:
        groups = counts.select(*by).distinct() if by else counts.limit(1).select(F.lit(1).alias("_one"))
        every = groups.select(*by, F.explode(F.array(*[F.lit(v) for v in labels])).alias("label"))
        sums = every.join(sums, [*by, "label"], "left").na.fill(0, ["support", "predicted", "hits"])
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return sums.select(*by, "label", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"), "support")


def blocks(df: DataFrame, group: str, by: list[str] | None = None, labels: list[str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """by, rows, independent_groups, accuracy, macro_f1.  Macro F1 is the plain mean over the given labels, or over those that occur.

    Without by there is always one row; over no rows it is 0, 0, null, null."""
    by = by or []
    # Per group first: a group's rows meet once, before distinct groups and pairs of labels are counted.
    cells = df.groupBy(*by, F.col(group).alias("_g"), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    f1 = per_class(cells.groupBy(*by, "label", "prediction").agg(F.sum("n").alias("n")), by, labels).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    totals = cells.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.countDistinct("_g").alias("independent_groups"), (F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return totals.join(f1, by, "left") if by else totals.crossJoin(f1)  # one row each


def group_accuracy(df: DataFrame, group: str, correct: Column) -> DataFrame:
    """One row: mean, median, least accuracy over groups of equal weight; perfect groups and their share; least, median, most rows a group."""
    each = df.groupBy(group).agg(F.avg(correct.cast("int")).alias("a"), F.count("*").alias("n"))
    perfect = F.sum((F.col("a") == 1).cast("long"))
    return each.agg(F.count("*").alias("groups"), F.avg("a").alias("mean_accuracy"), F.median("a").alias("median_accuracy"), F.min("a").alias("min_accuracy"), perfect.alias("perfect_groups"), (perfect / F.count("*")).alias("perfect_fraction"), F.min("n").alias("min_rows"), F.median("n").alias("median_rows"), F.max("n").alias("max_rows"))


def accuracy_by(df: DataFrame, sets: list[list[str]], correct: Column) -> DataFrame:
    """Accuracy overall and by each set of columns, in one pass of grouping sets; columns not grouped by are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.withColumn("_correct", correct.cast("int")).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().cast("long").alias("grouping"), F.count("*").alias("rows"), F.avg("_correct").alias("accuracy"))


def ablation(df: DataFrame, by: str, prediction: str, metric: str, selected: float) -> DataFrame:
    """Mean, least, most of a metric over runs; whether a single class is predicted; gap to the selected model."""
    out = df.groupBy(by).agg(F.avg(metric).alias("mean_metric"), F.min(metric).alias("min_metric"), F.max(metric).alias("max_metric"), (F.countDistinct(prediction) == 1).alias("collapsed"))
    return out.withColumn("gap_to_selected", F.lit(selected) - F.col("mean_metric"))


def ranked(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """A small table with each row's place in a total order."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rule_diagnostic(df: DataFrame, families: DataFrame) -> DataFrame:
    """How a learned label compares with the label rule over predicted categories; over true categories the rule must be always right.

    df: label, prediction, part_category, text_category, predicted_part_category, predicted_text_category; families: category, family."""
    from ..functions.columns import relation_label

    met = df
    for k, c in enumerate(("part_category", "text_category", "predicted_part_category", "predicted_text_category")):
        met = met.join(families.select(F.col("category").alias(c), F.col("family").alias(f"_f{k}")), c, "left")
    rule = relation_label(F.col("predicted_part_category"), F.col("predicted_text_category"), F.col("_f2"), F.col("_f3"))
    oracle = relation_label(F.col("part_category"), F.col("text_category"), F.col("_f0"), F.col("_f1"))
    mean = lambda c: F.avg(c.cast("int"))
    out = met.agg(F.count("*").alias("rows"), mean(F.col("label") == F.col("prediction")).alias("learned_accuracy"), mean(F.col("part_category") == F.col("predicted_part_category")).alias("image_category_accuracy"), mean(F.col("text_category") == F.col("predicted_text_category")).alias("text_category_accuracy"), mean(F.col("label") == rule).alias("rule_accuracy"), mean(F.col("label") == oracle).alias("oracle_accuracy"))
    return out.withColumn("learned_minus_rule", F.col("learned_accuracy") - F.col("rule_accuracy"))
