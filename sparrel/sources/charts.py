"""Charts as documents: a specification that plotting tools read, with its ordered data inside.  Frames are aggregated before; a chart holds few points."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

#: Points that a chart may hold; more are an error, since a chart of them shows nothing and the driver writes it.
MAX_POINTS = 5_000


def _data(points: DataFrame) -> list[dict]:
    rows = points.limit(MAX_POINTS + 1).collect()
    if len(rows) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points; aggregate them first")
    return [r.asDict() for r in rows]


def _axis(field: str, kind: str, title: str | None = None, limits: tuple[float, float] | None = None) -> dict:
    """A channel of a chart; nominal ones keep the data's order."""
    out = {"field": field, "type": kind, "title": field if title is None else title}
    return out | ({"scale": {"domain": list(limits)}} if limits else {}) | ({"sort": None} if kind == "nominal" else {})


def bar(points: DataFrame, name: str, values: list[str], title: str, limits: tuple[float, float] | None = (0.0, 1.0)) -> dict:
    """Bars of one or more values a name, in order of the last value, then of the name."""
    pairs = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(v).alias("series"), F.col(v).cast("double").alias("value")) for k, v in enumerate(values)])
    long = points.select(name, F.col(values[-1]).cast("double").alias("_by"), F.explode(pairs).alias("s")).select(name, "_by", "s.*")
    data = _data(long.orderBy("_by", name, "position").select(name, "series", "value"))
    return {"title": title, "mark": "bar", "data": {"values": data}, "encoding": {"y": _axis(name, "nominal", ""), "x": _axis("value", "quantitative", "Score", limits), "color": _axis("series", "nominal")}}


def line(points: DataFrame, x: str, y: str, series: str, title: str, limits: tuple[float, float] | None = (0.0, 1.0)) -> dict:
    """A line of y over x for each series, in order of series and x."""
    data = _data(points.select(series, x, F.col(y).cast("double").alias(y)).orderBy(series, x))
    return {"title": title, "mark": {"type": "line", "point": True}, "data": {"values": data}, "encoding": {"x": _axis(x, "quantitative"), "y": _axis(y, "quantitative", limits=limits), "color": _axis(series, "nominal")}}


def heat_map(cells: DataFrame, row: str, column: str, value: str, labels: list[str], title: str) -> dict:
    """A cell for each two labels, with its number in it; pairs that don't occur are 0."""
    spark = cells.sparkSession
    every = spark.createDataFrame([(i, a, j, b) for i, a in enumerate(labels) for j, b in enumerate(labels)], f"_i int, `{row}` string, _j int, `{column}` string")
    met = every.join(cells.select(row, column, value), [row, column], "left")
    data = _data(met.orderBy("_i", "_j").select(row, column, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value)))
    sides = {"x": _axis(column, "nominal"), "y": _axis(row, "nominal")}
    layers = [{"mark": "rect", "encoding": sides | {"color": _axis(value, "quantitative")}}, {"mark": "text", "encoding": sides | {"text": _axis(value, "quantitative")}}]
    return {"title": title, "data": {"values": data}, "layer": layers}


def histogram(values: DataFrame, column: str, bins: int, title: str) -> dict:
    """Rows in bins of equal width between the least and the largest value; the last bin holds the largest.  Nulls and NaN are left out."""
    real = values.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high = real.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return {"title": title, "mark": "bar", "data": {"values": []}, "encoding": {}}
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    counts = real.groupBy(place.alias("bin")).agg(F.count("*").alias("rows"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    data = every.join(counts, "bin", "left").select("bin", (low + F.col("bin") * width).alias("start"), (low + (F.col("bin") + 1) * width).alias("end"), F.coalesce("rows", F.lit(0)).alias("rows"))
    ends = {"x": _axis("start", "quantitative", column) | {"bin": "binned"}, "x2": {"field": "end"}, "y": _axis("rows", "quantitative")}
    return {"title": title, "mark": "bar", "data": {"values": _data(data.orderBy("bin"))}, "encoding": ends}


def write(chart: dict, path: str) -> None:
    """A chart as a small JSON document; an existing one is refused."""
    sinks.write_json(chart, path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The data of a written chart, with its place."""
    values = json.loads(sinks.read_bytes(path))["data"]["values"]
    rows = spark.createDataFrame([json.dumps(v) for v in values], "string") if values else spark.createDataFrame([], "value string")
    placed = rows.select(F.monotonically_increasing_id().alias("_k"), F.from_json("value", schema).alias("v"))
    return placed.select((F.row_number().over(_by("_k")) - 1).alias("place"), "v.*")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # MAX_POINTS rows at most
