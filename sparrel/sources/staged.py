"""Several tables published as one: written beside their place, each with a digest, and moved there by a single rename.

On file systems with an atomic rename (local ones, HDFS) readers see all tables or none.  A run that was stopped is taken up again: what it finished, and what
still has the digest it was finished with, is kept."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks


def rows_digest(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of a table's rows in any order: their number, and sums of parts of each row's SHA-256."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns or df.columns)]
    h = F.sha2(F.concat_ws("\x1f", *cells).cast("binary"), 256)
    parts = df.select(*[F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(8)])
    return "-".join(str(v) for v in parts.agg(F.count("*"), *[F.sum(f"p{k}") for k in range(8)]).first())


class Staged:
    """with Staged(spark, out, about) as s: s.table(...); s.document(...); s.publish().

    about: what the tables are made from; an unfinished run from something else is thrown away.  An out that exists is refused."""

    def __init__(self, spark: SparkSession, out: str, about: dict) -> None:
        self.spark, self.out, self.stage = spark, out.rstrip("/"), f"{out.rstrip('/')}.unfinished"
        if sinks.exists(self.out):
            raise AnalysisException(f"[PATH_ALREADY_EXISTS] {self.out} is there already")
        self.about = json.loads(sinks.rendered(about))
        self.done: dict[str, str] = {}
        if sinks.exists(self._manifest()):
            kept = json.loads(sinks.read_bytes(self._manifest()))
            if kept["about"] == self.about:
                self.done = kept["tables"]
        if not self.done:
            sinks.remove(self.stage)
            self._write()

    def _manifest(self) -> str:
        return f"{self.stage}/manifest.json"

    def _write(self) -> None:
        sinks.write_json({"about": self.about, "tables": self.done}, self._manifest(), overwrite=True)

    def table(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """df as Parquet under the stage, in a folder a value of by; written unless an earlier run finished it and it is unchanged.  Returns what is there."""
        path = f"{self.stage}/{name}"
        if self.done.get(name) is None or not sinks.exists(path) or rows_digest(self.spark.read.parquet(path)) != self.done[name]:
            self.done.pop(name, None)
            self._write()
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(path)
            self.done[name] = rows_digest(self.spark.read.parquet(path))
            self._write()
        return self.spark.read.parquet(path)

    def document(self, name: str, document: dict) -> None:
        """A small document, as one line of JSON text."""
        self.spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.stage}/{name}")

    def publish(self) -> None:
        """All of it at once; another run that published meanwhile is an error."""
        if sinks.exists(self.out):
            raise FileExistsError(self.out)
        sinks.rename(self.stage, self.out)


def checked(spark: SparkSession, out: str) -> list[str]:
    """Names of published tables that no longer have the digest they were published with."""
    tables = json.loads(sinks.read_bytes(f"{out.rstrip('/')}/manifest.json"))["tables"]
    wrong = []
    for name, digest in sorted(tables.items()):
        path = f"{out.rstrip('/')}/{name}"
        if not sinks.exists(path) or rows_digest(spark.read.parquet(path)) != digest:
            wrong.append(name)
    return wrong
