"""Balanced relation rows from a category hierarchy.

Each category gets a quota of units, twice the largest image count of its family, so that one label can be paired inside a family and across families with
equal margins.  A category's units take its images in turn.  The global order of units is families by total quota, then category, then unit; it comes from
sums over the small category table, not from a sort of all units, and so do the counters of templates and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_rank

#: Rows of the category table up to which it is sent to every task.
MAX_BROADCAST_CATEGORIES = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if it is small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_CATEGORIES + 1).count() <= MAX_BROADCAST_CATEGORIES else df


def quotas(images: DataFrame) -> DataFrame:
    """category, family, n (images), quota from images (category, family)."""
    counts = images.groupBy("category", "family").agg(F.count("*").alias("n"))
    return counts.withColumn("quota", 2 * F.max("n").over(Window.partitionBy("family")))


def plan(quota: DataFrame) -> DataFrame:
    """The quotas with partner (next category of the family), start (place of the first unit), shift and total of the rotation; one row per category.

    A family with a single category, or with more than half of all units, is an error."""
    family = Window.partitionBy("family")
    p = quota.withColumn("family_total", F.sum("quota").over(family)).withColumn("fi", F.row_number().over(family.orderBy("category"))).withColumn("fn", F.count("*").over(family))
    p = p.withColumn("partner", F.coalesce(F.lead("category").over(family.orderBy("category")), F.first("category").over(family.orderBy("category"))))
    order = Window.orderBy(F.desc("family_total"), "family", "category")  # one row per category
    p = p.withColumn("start", F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota"))
    every = Window.partitionBy(F.lit(1))
    p = p.withColumn("shift", F.max("family_total").over(every)).withColumn("total", F.sum("quota").over(every))
    p = p.withColumn("width", F.ceil(F.col("total") / F.count("*").over(every)))  # of a bin of places: about one category each
    bad = F.when(F.col("fn") < 2, "a family has a single category").when(2 * F.col("shift") > F.col("total"), "a family has more than half of all units")
    return p.withColumn("shift", F.when(bad.isNotNull(), F.raise_error(bad).cast("long")).otherwise(F.col("shift"))).drop("fi", "fn")


def relations(images: DataFrame, templates: tuple[str, str], source: str = "generated", digest: str = "sha256") -> DataFrame:
    """Relation rows from images (image_id, category, family and a digest that orders a category's images; ties by image_id).

    Columns: sample_id, image_id, part_family, part_category, text_category, text_family, description, label, source."""
    p = small(plan(quotas(images)))
    ranked = hash_rank(images, ["category"], F.col(digest), ["image_id"]).join(p.select("category", "n", "quota", "partner", "start", "shift", "total", "width"), "category")
    units = ranked.withColumn("unit", F.explode(F.sequence(F.col("rank") - 1, F.col("quota") - 1, F.col("n"))))
    rows = units.withColumn("label", F.explode(F.array(F.lit("MATCH"), F.lit("PARTIAL_MATCH"), F.lit("MISMATCH"))))
    rows = rows.withColumn("aim", (F.col("start") + F.col("unit") + F.col("shift")) % F.col("total"))

    # A place meets the categories that reach into its bin, twice as many rows as categories at most.
    last = F.floor((F.col("start") + F.col("quota") - 1) / F.col("width"))
    across = p.select(F.col("category").alias("t_category"), F.col("start").alias("t_start"), (F.col("start") + F.col("quota")).alias("t_end"), F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), last)).alias("bin"))
    across = small(across)
    near = rows.where("label <> 'MISMATCH'").select("*", F.when(F.col("label") == "MATCH", F.col("category")).otherwise(F.col("partner")).alias("text_category"), F.col("unit").alias("place"))
    far = rows.where("label = 'MISMATCH'").withColumn("bin", F.floor(F.col("aim") / F.col("width"))).join(across, "bin").where("aim >= t_start and aim < t_end").drop("bin").withColumn("place", F.col("aim") - F.col("t_start")).withColumnRenamed("t_category", "text_category").drop("t_start", "t_end")
    both = near.unionByName(far)
    families = p.select(F.col("category").alias("text_category"), F.col("family").alias("text_family"))
    text = F.when(F.col("place") % 2 == 0, F.lit(templates[0])).otherwise(F.lit(templates[1]))
    occurrence = F.lpad((F.floor(F.col("unit") / F.col("n")) + 1).cast("string"), 2, "0")
    return both.join(small(families), "text_category").select(
        F.concat_ws("_", F.col("image_id").cast("string"), F.lower("label"), occurrence).alias("sample_id"), "image_id", F.col("family").alias("part_family"), F.col("category").alias("part_category"),
        "text_category", "text_family", F.replace(text, F.lit("{name}"), F.replace("text_category", F.lit("_"), F.lit(" "))).alias("description"), "label", F.lit(source).alias("source"),
    )


def expand_modes(images: DataFrame, partners: DataFrame) -> DataFrame:
    """Six rows an image: three labels in two text modes, from a table of partners (category, partial_partner, mismatch_partner)."""
    met = images.join(small(partners), "category")
    kinds = F.array(*[F.struct(F.lit(label).alias("label"), c.alias("text_category")) for label, c in (("MATCH", F.col("category")), ("PARTIAL_MATCH", F.col("partial_partner")), ("MISMATCH", F.col("mismatch_partner")))])
    rows = met.select("image_id", "category", F.explode(kinds).alias("k")).withColumn("text_mode", F.explode(F.array(F.lit("clean"), F.lit("natural"))))
    return rows.select(F.concat_ws("_", F.col("image_id").cast("string"), "text_mode", F.lower("k.label")).alias("sample_id"), "image_id", F.col("category").alias("part_category"), F.col("k.text_category").alias("text_category"), F.col("k.label").alias("label"), "text_mode")
