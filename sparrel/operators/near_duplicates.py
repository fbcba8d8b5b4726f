"""Near-duplicate pairs of 64-bit hashes across splits, and what they do to metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SEVERITIES, hamming, severity, severity_rank
from . import metrics

# Pairs of splits, the earlier one on the left.
SPLIT_PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))
#: Bits of a hash, and hash distance up to which rows meet at bands; beyond it bands are too narrow to tell pairs apart.
HASH_BITS, MAX_BANDED_DISTANCE = 64, 11


def _bands(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest bands of which one differs by one bit at most in hashes within a distance: half as many as the distance, and one."""
    n = distance // 2 + 1
    edges = [HASH_BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pairs(hashes: DataFrame, limits=SEVERITIES, split_pairs=SPLIT_PAIRS, banded: bool | None = None) -> DataFrame:
    """severity, category, left/right split and id, both distances, for pairs of rows (id, category, split, phash, dhash) in one category.

    Hashes within distance r differ by one bit at most in one of r / 2 + 1 bands, so the rows of the later split look up each band's value and those one bit
    away (about 70 lookups a row): exact, and not all pairs of a category.  Beyond MAX_BANDED_DISTANCE pairs meet at the category alone."""
    r = max(p for _, p, _ in limits)
    banded = r <= MAX_BANDED_DISTANCE if banded is None else banded
    rows = hashes.select("id", "category", "split", "phash", "dhash").where("phash is not null and dhash is not null")
    if banded:
        value = lambda first, bits: F.shiftrightunsigned("phash", first).bitwiseAND((1 << bits) - 1)
        named = lambda k, v: F.lit(k << HASH_BITS // 2).bitwiseOR(v)  # the band's number above its value
        bands = list(enumerate(_bands(r)))
        own = rows.withColumn("band", F.explode(F.array(*[named(k, value(*b)) for k, b in bands])))
        near = [named(k, value(first, bits).bitwiseXOR(F.lit(flip).cast("long"))) for k, (first, bits) in bands for flip in (0, *(1 << x for x in range(bits)))]
        asked = rows.withColumn("band", F.explode(F.array(*near)))
    else:
        own = asked = rows.withColumn("band", F.lit(0).cast("long"))
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split")) for a, b in split_pairs]))
    left = own.withColumn("p", sides).where(F.col("split") == F.col("p.left_split")).select("category", "band", "p", F.col("id").alias("left_id"), F.col("phash").alias("lp"), F.col("dhash").alias("ld"))
    right = asked.select("category", "band", F.col("split").alias("rs"), F.col("id").alias("right_id"), F.col("phash").alias("rp"), F.col("dhash").alias("rd"))
    near = hamming(F.col("lp"), F.col("rp")) <= r
    met = left.join(right, (left["category"] == right["category"]) & (left["band"] == right["band"]) & (F.col("p.right_split") == F.col("rs")) & near)
    out = met.select(severity(hamming(F.col("lp"), F.col("rp")), hamming(F.col("ld"), F.col("rd")), limits).alias("severity"), left["category"], F.col("p.left_split").alias("left_split"), F.col("p.right_split").alias("right_split"), "left_id", "right_id", hamming(F.col("lp"), F.col("rp")).alias("phash_distance"), hamming(F.col("ld"), F.col("rd")).alias("dhash_distance"))
    out = out.where("severity is not null")
    return out.distinct() if banded else out


def severity_counts(found: DataFrame, limits=SEVERITIES, flagged: str = "test") -> DataFrame:
    """position, severity, pairs of just this severity, flagged: distinct right ids of the flagged split at this severity or a stricter one."""
    names = [s[0] for s in limits]
    base = found.sparkSession.createDataFrame([(k, s) for k, s in enumerate(names, 1)], "position int, severity string")
    own = found.groupBy("severity").agg(F.count("*").alias("pairs"))
    first = found.where(F.col("right_split") == flagged).groupBy("right_id").agg(F.min(severity_rank(F.col("severity"), limits)).alias("k"))
    reach = first.groupBy("k").agg(F.count("*").alias("ids"))
    up_to = base.join(reach, F.col("k") <= F.col("position"), "left").groupBy("position").agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("flagged"))
    return base.join(own, "severity", "left").join(up_to, "position").select("position", "severity", F.coalesce("pairs", F.lit(0)).alias("pairs"), "flagged")


def sensitivity(predictions: DataFrame, found: DataFrame, group: str, labels: list[str] | None, limits=SEVERITIES, flagged: str = "test") -> DataFrame:
    """For each severity: flagged groups, their share, and the metrics without the rows of groups flagged at it or a stricter one.

    One pass: each group gets the strictest severity that flags it, and each row counts for the severities that don't flag its group."""
    names = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("severity")) for k, (n, _, _) in enumerate(limits, 1)])
    first = found.where(F.col("right_split") == flagged).groupBy(F.col("right_id").alias(group)).agg(F.min(severity_rank(F.col("severity"), limits)).alias("_k"))
    rows = predictions.join(first, group, "left")
    groups = rows.groupBy(group).agg(F.min("_k").alias("_k")).select("_k", F.explode(names).alias("s"))
    out = F.coalesce((F.col("_k") <= F.col("s.position")).cast("long"), F.lit(0))
    shares = groups.groupBy("s.position", "s.severity").agg(F.sum(out).alias("flagged_groups"), F.avg(out).alias("flagged_fraction"))
    kept = rows.withColumn("_s", F.explode(names)).where(F.col("_k").isNull() | (F.col("_k") > F.col("_s.position"))).withColumn("severity", F.col("_s.severity"))
    left = metrics.blocks(kept, group, ["severity"], labels)
    return shares.join(left, "severity", "left").na.fill(0, ["rows", "independent_groups"]).select("severity", "flagged_groups", "flagged_fraction", "rows", "independent_groups", "accuracy", "macro_f1")


def cumulative(severity_column: Column, name: str, limits=SEVERITIES) -> Column:
    """Whether a severity is the named one or a stricter one."""
    return severity_rank(severity_column, limits) <= [s[0] for s in limits].index(name) + 1
