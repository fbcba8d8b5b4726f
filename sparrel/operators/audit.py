"""Checks over tables as DataFrames of findings (check, value, ok); enforce() raises on any that fails."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns) -> DataFrame:
    """df, if it has the columns; more are allowed."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_values(df: DataFrame, column: str, values, shown: int = 50) -> DataFrame:
    """df, if column holds nothing but the values (and nulls); else an error that names the unknown ones in order, as many as shown, and how many there are."""
    unknown = df.where(~F.col(column).isin(*values)).select(F.col(column).cast("string").alias("v")).distinct()
    rows = unknown.orderBy("v").limit(shown + 1).collect()
    if rows:
        more = f" and {unknown.count() - shown} more" if len(rows) > shown else ""
        raise ValueError(f"unknown values of {column}: {', '.join(r.v for r in rows[:shown])}{more}")
    return df


def enforce(findings: DataFrame) -> DataFrame:
    failed = findings.where("not ok").limit(20).collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['value']}" for r in failed))
    return findings


def finding(df: DataFrame, check: str, value: Column, expected) -> DataFrame:
    """One row from an aggregate over df."""
    return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("value")).select(F.lit(check).alias("check"), "value", (F.col("value") == expected).alias("ok"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def uniqueness(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Surplus rows per key: rows beyond the first of each value."""
    return union([finding(df.groupBy(*k).count(), "unique(" + ",".join(k) + ")", F.sum(F.col("count") - 1), 0) for k in keys])


def domain(df: DataFrame, column: str, expected: DataFrame, expected_column: str) -> DataFrame:
    """Values that are in one side only; both counts must be 0."""
    have, want = df.select(F.col(column).alias("v")).distinct(), expected.select(F.col(expected_column).alias("v")).distinct()
    return union([finding(have.join(want, "v", "left_anti"), f"unexpected({column})", F.count("*"), 0), finding(want.join(have, "v", "left_anti"), f"missing({column})", F.count("*"), 0)])


def counts(df: DataFrame, by: str, declared: DataFrame) -> DataFrame:
    """by, rows, declared, ok for every group of either side."""
    have = df.groupBy(by).agg(F.count("*").alias("rows"))
    both = have.join(declared.select(by, "declared"), by, "full_outer").na.fill(0, ["rows", "declared"])
    return both.withColumn("ok", F.col("rows") == F.col("declared"))


def overlap(df: DataFrame, split: str, splits: list[str], columns: list[str]) -> DataFrame:
    """left, right, column, shared: distinct values that two splits share.  Each value's splits are gathered once; no join."""
    parts = []
    for c in columns:
        seen = df.where(F.col(split).isin(splits) & F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(*[F.max((F.col(split) == s).cast("int")).alias(f"in_{k}") for k, s in enumerate(splits)])
        pairs = list(combinations(range(len(splits)), 2))
        sums = seen.agg(*[F.coalesce(F.sum(F.col(f"in_{a}") * F.col(f"in_{b}")), F.lit(0)).cast("long").alias(f"p{a}_{b}") for a, b in pairs])
        parts.append(sums.select(F.explode(F.array(*[F.struct(F.lit(splits[a]).alias("left"), F.lit(splits[b]).alias("right"), F.lit(c).alias("column"), F.col(f"p{a}_{b}").alias("shared")) for a, b in pairs])).alias("r")).select("r.*"))
    return union(parts)


def balance(df: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """by, a count per value with zeros, balanced: whether all are equal and at least 1."""
    wide = df.groupBy(by).pivot(column, values).count().na.fill(0, values)
    return wide.withColumn("balanced", (F.least(*values) == F.greatest(*values)) & (F.least(*values) >= 1))


def crosstab(df: DataFrame, row: str, rows: list[str], column: str, columns: list[str]) -> DataFrame:
    """Counts in a fixed order of rows and columns, zeros included."""
    wide = df.groupBy(F.col(row).alias("row_value")).pivot(column, columns).count()
    base = df.sparkSession.createDataFrame(list(enumerate(rows)), "position int, row_value string")
    return base.join(wide, "row_value", "left").na.fill(0, columns).select("position", "row_value", *columns)


def margins_differ(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either count matrix that the other lacks, with the side they come from."""
    return actual.exceptAll(expected).withColumn("side", F.lit("actual")).unionByName(expected.exceptAll(actual).withColumn("side", F.lit("expected")))


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One finding: rows of either frame that the other lacks.  Equal rows of both frames meet once, by a shuffle of their own, and cancel out."""
    both = a.select(*columns, F.lit(1).alias("_side")).unionByName(b.select(*columns, F.lit(-1).alias("_side")))
    surplus = both.repartition(*columns).groupBy(*columns).agg(F.sum("_side").alias("_surplus"))
    return finding(surplus, "frames_equal", F.sum(F.abs("_surplus")), 0)


def rule_violations(relations: DataFrame, families: DataFrame) -> DataFrame:
    """total rows and violations of each label's rule, and of stored families, from relations and families (category, family)."""
    f = families.select(F.col("category").alias("c"), F.col("family").alias("f"))
    r = relations.join(f.select(F.col("c").alias("part_category"), F.col("f").alias("pf")), "part_category", "left").join(f.select(F.col("c").alias("text_category"), F.col("f").alias("tf")), "text_category", "left")
    same_category, same_family = F.col("part_category") == F.col("text_category"), F.col("part_family") == F.col("text_family")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return r.agg(
        F.count("*").alias("total"), count((F.col("label") == "MATCH") & ~same_category).alias("match_violations"), count((F.col("label") == "PARTIAL_MATCH") & (same_category | ~same_family)).alias("partial_violations"),
        count((F.col("label") == "MISMATCH") & same_family).alias("mismatch_violations"), count(~F.col("part_family").eqNullSafe(F.col("pf")) | ~F.col("text_family").eqNullSafe(F.col("tf"))).alias("family_violations"),
    )


def plan_check(plan: DataFrame, per_family: int = 2) -> DataFrame:
    """Findings over a partner plan (category, family, partial_partner, mismatch_partner)."""
    other = plan.select(F.col("category").alias("o"), F.col("family").alias("of"))
    parts = [finding(plan.groupBy("family").count(), "categories_per_family", F.sum((F.col("count") != per_family).cast("int")), 0)]
    for kind, alike in (("partial_partner", True), ("mismatch_partner", False)):
        met = plan.join(other, F.col(kind) == F.col("o"), "left")
        parts += [
            finding(plan.groupBy(kind).count(), f"{kind}_repeated", F.sum(F.col("count") - 1), 0),
            finding(met, f"{kind}_unknown", F.sum(F.col("o").isNull().cast("int")), 0),
            finding(met, f"{kind}_itself", F.sum((F.col(kind) == F.col("category")).cast("int")), 0),
            finding(met, f"{kind}_family", F.sum(((F.col("family") == F.col("of")) != F.lit(alike)).cast("int")), 0),
        ]
    return union(parts)


def content_hashes(files: DataFrame, manifest: DataFrame, path: str = "path", content: str = "content", digest: str = "sha256") -> DataFrame:
    """files, missing, mismatched: digests of contents against a manifest (path, sha256)."""
    have = files.select(F.col(path).alias("p"), F.sha2(F.col(content).cast("binary"), 256).alias("have"))
    met = manifest.select(F.col(path).alias("p"), F.col(digest).alias("want")).join(have, "p", "left")
    return met.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.col("have").isNull().cast("long")), F.lit(0)).alias("missing"), F.coalesce(F.sum((F.col("have") != F.col("want")).cast("long")), F.lit(0)).alias("mismatched"))


def path_policy(df: DataFrame, path: str, split: str, locked: str, prefix: str) -> DataFrame:
    """Rows outside the locked split under the prefix, and rows of it elsewhere; both must be 0."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    return union([finding(df, "open_under_prefix", F.sum(((F.col(split) != locked) & p.startswith(prefix)).cast("int")), 0), finding(df, "locked_elsewhere", F.sum(((F.col(split) == locked) & ~p.startswith(prefix)).cast("int")), 0)])


def provenance(df: DataFrame, flags: list[str], placeholder: str = "TODO") -> DataFrame:
    """Rows that hold a placeholder anywhere in their JSON, and rows with a flag not set."""
    text = F.to_json(F.struct(*df.columns))
    return union([finding(df, "placeholders", F.sum(text.contains(placeholder).cast("int")), 0), *[finding(df, f"{f}_not_set", F.sum((~F.coalesce(F.col(f), F.lit(False))).cast("int")), 0) for f in flags]])


def forbidden_text(texts: DataFrame, path: str, value: str, words: list[str]) -> DataFrame:
    """path, word for every forbidden word that a text holds."""
    return texts.select(F.col(path).alias("path"), F.explode(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(value), w))).alias("word"))


def recomputed(actual: dict[str, float], stored: dict[str, float], tolerance: float = 1e-12) -> list[str]:
    """Names of stored metrics that are missing or differ by more than the tolerance."""
    return sorted(k for k, v in stored.items() if k not in actual or actual[k] is None or abs(actual[k] - v) > tolerance)
