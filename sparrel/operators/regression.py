"""Logistic regression over sparse features, and what shows that it has converged.

A sparse vector is a struct (size, indices, values) that column expressions make and put side by side; only the solver sees it as a vector type."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARSE = "struct<size: int, indices: array<int>, values: array<double>>"


def from_dense(values: Column, size: int) -> Column:
    """The values that aren't 0; another number of values than size, or a null array, is an error."""
    kept = F.filter(F.transform(values, lambda v, k: F.struct(k.alias("k"), v.cast("double").alias("v"))), lambda p: p.v != 0)
    right = F.coalesce(F.size(values) == size, F.lit(False))
    out = F.struct(F.lit(size).alias("size"), F.transform(kept, lambda p: p.k).alias("indices"), F.transform(kept, lambda p: p.v).alias("values"))
    return F.when(right, out).otherwise(F.raise_error(F.lit(f"not {size} values")).cast(SPARSE))


def beside(left: Column, right: Column) -> Column:
    """Two sparse vectors as one, the right one's places after the left one's; nothing is made dense."""
    moved = F.transform(right["indices"], lambda k: k + left["size"])
    return F.struct(
        (left["size"] + right["size"]).alias("size"), F.concat(left["indices"], moved).alias("indices"), F.concat(left["values"], right["values"]).alias("values")
    )


def vectors(rows: DataFrame, features: str) -> DataFrame:
    """rows with their sparse column as the solver's vector type, which has the same fields and a mark of its kind."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    sparse = F.lit(0).cast("tinyint").alias("type")
    marked = rows.withColumn(features, F.struct(sparse, F.col(features)["size"].alias("size"), F.col(features)["indices"].alias("indices"), F.col(features)["values"].alias("values")))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    fields = [StructField(f.name, VectorUDT() if f.name == features else f.dataType) for f in rows.schema]
    return marked.mapInArrow(same, StructType(fields))


def fit(train: DataFrame, features: str, label: str, c: float = 1.0, max_iter: int = 3000, tolerance: float = 1e-10):
    """A multinomial model of vectors(): summed cross-entropy and half the squared weights over c, features unscaled, intercepts without a penalty."""
    from pyspark.ml.classification import LogisticRegression

    n = max(1, train.count())
    solver = LogisticRegression(
        featuresCol=features, labelCol=label, family="multinomial", standardization=False, regParam=1.0 / (n * c), maxIter=max_iter, tol=tolerance, aggregationDepth=2
    )
    return solver.fit(train)


def stationarity(model, rows: DataFrame, features: str, label: str, c: float = 1.0) -> DataFrame:
    """class, index, observed, gradient: the summed value of each feature over the rows of a class, and the objective's derivative by its weight.

    Index -1 is the intercept.  The objective is convex, so where every derivative is 0 the model is the only optimum."""
    spark, kinds = rows.sparkSession, model.numClasses
    known = vectors(rows.select(features, label), features)
    with_p = model.setProbabilityCol("_p").transform(known)
    from pyspark.ml.functions import vector_to_array

    entries = F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("index"), F.lit(1.0).alias("value"))),
        F.zip_with("i", "x", lambda i, x: F.struct(i.alias("index"), x.alias("value"))),
    ))
    # rows again beside their probabilities: the struct's places, not the vector's.
    p = with_p.select(F.col(label).alias("_y"), vector_to_array("_p").alias("_p"), F.col(features).alias("_v"))
    listed = _listed(p, "_v")
    sums = listed.select("_y", "_p", entries.alias("e")).groupBy("e.index").agg(
        *[F.sum(F.col("e.value") * F.get("_p", F.lit(k))).alias(f"p{k}") for k in range(kinds)],
        *[F.sum(F.when(F.col("_y") == k, F.col("e.value")).otherwise(0.0)).alias(f"y{k}") for k in range(kinds)],
    )
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"y{k}").alias("observed"), F.col(f"p{k}").alias("expected")) for k in range(kinds)]))
    found = sums.select("index", each.alias("s")).select("s.class", "index", "s.observed", "s.expected")
    weights = spark.createDataFrame(
        [(k, i, float(w)) for k, row in enumerate(model.coefficientMatrix.toArray()) for i, w in enumerate(row)] + [(k, -1, 0.0) for k in range(kinds)],
        "class int, index int, weight double",
    )  # as large as the model
    met = weights.join(found, ["class", "index"], "left").fillna(0.0, ["observed", "expected"])
    return met.select("class", "index", "observed", (F.col("expected") - F.col("observed") + F.col("weight") / c).alias("gradient"))


def _listed(rows: DataFrame, vector: str) -> DataFrame:
    """rows with a vector's places and values as arrays i and x; a dense vector's are all of its places."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(vector)).to_pylist()
            places = [v["indices"] if v["type"] == 0 else list(range(len(v["values"]))) for v in values]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.list_(pa.int32())), pa.array([v["values"] for v in values], pa.list_(pa.float64()))], names=[*names, "i", "x"])

    names = [n for n in rows.columns if n != vector]
    fields = [f for f in rows.schema if f.name != vector]
    out = StructType([*fields, StructField("i", ArrayType(IntegerType())), StructField("x", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, out)
