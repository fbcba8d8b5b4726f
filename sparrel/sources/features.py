"""Image features: taken once for each id by a frozen extractor, kept, and added to as new ids come."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import drawn


@dataclass(frozen=True)
class Convolution:
    """A frozen extractor: one layer of 3 x 3 filters at every second place, what is below 0 cut off, the mean of each filter's values.

    Its weights are drawn() from digests, never trained: the same features on every run."""

    filters: int = 8
    seed: int = 44

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(["convolution", self.filters, self.seed]).encode()).hexdigest()

    def __call__(self, pictures: np.ndarray) -> np.ndarray:
        """Pictures (n, 3, height, width; 0..255, at least 3 x 3) to (n, filters)."""
        weights = drawn(self.seed, "filter", (27, self.filters)) / np.sqrt(27)
        windows = np.lib.stride_tricks.sliding_window_view(pictures / 255.0, (3, 3), axis=(2, 3))[:, :, ::2, ::2]  # n, 3, y, x, 3, 3
        n, _, height, width = windows.shape[:4]
        places = windows.transpose(0, 2, 3, 1, 4, 5).reshape(n, height * width, 27)
        return np.maximum(places @ weights, 0).mean(axis=1)


def extracted(pictures: DataFrame, id_col: str, extractor: Callable[[np.ndarray], np.ndarray], batch: int = 64) -> DataFrame:
    """id, features of pictures (id, channels: three equally large channels of 0..255), each id once; pictures of one size go through the extractor together."""
    kind = pictures.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                arrays, out = [np.array(c, float) for c in part.column(1).to_pylist()], [None] * part.num_rows
                for shape in {a.shape for a in arrays}:
                    where = [k for k, a in enumerate(arrays) if a.shape == shape]
                    for k, row in zip(where, extractor(np.stack([arrays[k] for k in where])).tolist()):
                        out[k] = row
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float64()))], names=[id_col, "features"])

    return pictures.dropDuplicates([id_col]).select(id_col, "channels").mapInArrow(run, f"`{id_col}` {kind}, features array<double>")


def kept(pictures: DataFrame, id_col: str, path: str, extractor, batch: int = 64) -> DataFrame:
    """id, features of every id of pictures: those kept under path for this extractor are read, the others are extracted and added.

    The folder is named by the extractor's digest, so another extractor never gets these features.  Two writers at once may add an id twice; it is read once."""
    spark, place = pictures.sparkSession, f"{path}/extractor={extractor.digest()}"
    ids = pictures.select(id_col).distinct()
    missing = pictures
    known = _found(spark, place)
    if known is not None:
        missing = pictures.join(known.select(id_col), id_col, "left_anti")
    if not missing.isEmpty():
        extracted(missing, id_col, extractor, batch).write.mode("append").parquet(place)
        known = _found(spark, place)
    if known is None:  # no pictures at all
        return ids.select(id_col, F.lit(None).cast("array<double>").alias("features"))
    return known.dropDuplicates([id_col]).join(ids, id_col, "left_semi").select(id_col, "features")


def _found(spark, place: str) -> DataFrame | None:
    try:
        return spark.read.parquet(place)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
