"""Guarded readers: manifests, relations behind a lock, dimensions, JSON documents, hash manifests, archives and images."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.audit import require_columns

# Columns of the manifests, and the splits.
IMAGE_COLUMNS = ("image_id", "image_group_id", "part_category", "part_family", "split", "rank_within_category", "image_path", "sha256", "width", "height", "mode", "source_dataset", "source_category", "source_original_split", "source_archive_path")
RELATION_COLUMNS = ("sample_id", "image_id", "part_group_id", "object_group_id", "image_path", "part_family", "part_category", "text_category", "text_family", "description", "label", "source")
SPLITS = ("train", "validation", "test")
IMAGE_SCHEMA = ", ".join(f"{c} {'int' if c in ('rank_within_category', 'width', 'height') else 'string'}" for c in IMAGE_COLUMNS)
UPLOAD_SUFFIXES = ("jpg", "jpeg", "png", "webp")


def csv(spark: SparkSession, path: str, columns, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; types inferred unless a schema is given; required columns checked, others kept."""
    reader = spark.read.option("header", True)
    return require_columns((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path), columns)


def relations(spark: SparkSession, root: str, split: str, allow_locked_test: bool = False) -> DataFrame:
    """One split of a Parquet table partitioned by split (only its folder is read).  The test split needs permission."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    if split == "test" and not allow_locked_test:
        raise PermissionError("the test split is locked")
    return require_columns(spark.read.parquet(root), ("sample_id", "label", "split")).where(F.col("split") == split)


def category_index(dimension: DataFrame, category: str, family: str, expected: int | None = None) -> DataFrame:
    """category, family, index (place in alphabetical order); repeated categories, or another number than expected, are an error."""
    rows, distinct = dimension.agg(F.count("*"), F.countDistinct(category)).first()
    if rows != distinct or (expected is not None and rows != expected):
        raise ValueError(f"{rows} rows, {distinct} categories, expected {expected}")
    return dimension.select(F.col(category).alias("category"), F.col(family).alias("family"), (F.row_number().over(Window.orderBy(category)) - 1).alias("index"))


def json_documents(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Documents of JSON files: one a file, however many lines it has (or the elements of its list), or with lines one a line.  Broken ones are an error."""
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def hash_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """sha256, path of lines "digest, two spaces, path"; blank lines are left out."""
    parts = F.split(F.col(value), "  ", 2)
    return lines.where(F.trim(F.col(value)) != "").select(F.get(parts, F.lit(0)).alias("sha256"), F.get(parts, F.lit(1)).alias("path"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def image_header(content: bytes) -> tuple[int, int, str] | None:
    """Width, height, mode from a JPEG's or PNG's header; None if it is neither."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 26:
        width, height, _, kind = struct.unpack(">IIBB", content[16:26])
        return width, height, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "?")
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            return None
        marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # start of frame
            height, width, parts = struct.unpack(">HHB", content[at + 5 : at + 10])
            return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "?")
        at += 2 + size
    return None


def inspect_archive(archives: DataFrame, prefix: str = "", suffix: str = ".jpg") -> DataFrame:
    """archive, path, parts, safe, crc_ok, bytes, sha256, width, height, mode of each member below the prefix with the suffix (in any case).

    archives: path, content.  Members are read one at a time; a broken member is a row with crc_ok false, an unsafe path one with safe false."""
    schema = "archive string, path string, parts array<string>, safe boolean, crc_ok boolean, bytes bigint, sha256 string, width int, height int, mode string"
    out = pa.schema([("archive", pa.string()), ("path", pa.string()), ("parts", pa.list_(pa.string())), ("safe", pa.bool_()), ("crc_ok", pa.bool_()), ("bytes", pa.int64()), ("sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for name in z.namelist():
                        clean = name.replace("\\", "/")
                        if clean.endswith("/") or not clean.startswith(prefix) or not clean.lower().endswith(suffix):
                            continue
                        parts = clean.split("/")
                        safe = not (clean.startswith("/") or ".." in parts or ":" in parts[0])
                        try:
                            data = z.read(name)
                        except (zipfile.BadZipFile, OSError):
                            data = None
                        head = image_header(data) if data is not None else None
                        row = [archive, clean, parts, safe, data is not None, len(data or b""), hashlib.sha256(data).hexdigest() if data is not None else None, *(head or (None, None, None))]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, out.types, strict=True)], schema=out)

    return archives.select("path", "content").mapInArrow(run, schema)


def collect_manifest(found: DataFrame, expected_per_category: int, known: DataFrame) -> DataFrame:
    """Findings over files (category, sha256): categories of another size, repeated contents, contents that a known manifest (sha256) has."""
    from ..operators.audit import finding, union

    return union([
        finding(found.groupBy("category").count(), "category_size", F.sum((F.col("count") != expected_per_category).cast("int")), 0),
        finding(found.groupBy("sha256").count(), "repeated_content", F.sum(F.col("count") - 1), 0),
        finding(found.join(known.select("sha256"), "sha256", "left_semi"), "known_content", F.count("*"), 0),
    ])


def decode_images(paths: DataFrame, contents: DataFrame, decode: Callable[[bytes], list[float]]) -> DataFrame:
    """path, features: every distinct path is decoded once, then joined back to all rows of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(c.as_py()) for c in batch.column(1)], pa.list_(pa.float64()))], names=["path", "features"])

    once = contents.join(paths.select("path").distinct(), "path", "left_semi").select("path", "content")
    return paths.join(once.mapInArrow(run, "path string, features array<double>"), "path", "left")


def cached_features(spark: SparkSession, path: str, ids: DataFrame, id_col: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The features kept under path if their ids are just those asked for, else built and written anew."""
    from pyspark.errors import AnalysisException

    try:
        kept = spark.read.parquet(path)
        if not ids.select(id_col).exceptAll(kept.select(id_col)).limit(1).count() and not kept.select(id_col).exceptAll(ids.select(id_col)).limit(1).count():
            return kept
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upload_problem(path: Column, description: Column) -> Column:
    """Why a record (path, description) can't be predicted: another suffix, or no description; null if it can."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\\\]*)$", 1))
    wrong = ~F.coalesce(suffix, F.lit("")).isin(*UPLOAD_SUFFIXES)
    kinds = F.lit(f"not one of {', '.join(UPLOAD_SUFFIXES)}: ")
    return F.when(wrong, F.concat(kinds, F.coalesce(path, F.lit("null")))).when(F.coalesce(F.trim(description), F.lit("")) == "", "a description is required")


def uploads(records: DataFrame) -> DataFrame:
    """path, description (trimmed), problem of records to predict; who scores them takes those without a problem."""
    return records.select("path", F.trim("description").alias("description"), upload_problem(F.col("path"), F.col("description")).alias("problem"))


def single_record(spark: SparkSession, path: str, description: str) -> DataFrame:
    """One row (path, description) for the single-record predictor; other suffixes and blank descriptions are errors."""
    (row,) = uploads(spark.createDataFrame([(path, description)], "path string, description string")).collect()
    if row.problem is not None:
        raise ValueError(row.problem)
    return spark.createDataFrame([(row.path, row.description)], "path string, description string")


def lazy_dataset(relations: DataFrame, features: DataFrame, labels: list[str], categories: DataFrame) -> DataFrame:
    """sample_id, features, description, label_code, image_code, text_code for each relation row; unknown labels, categories or images are an error."""
    from ..functions.columns import encode

    codes = categories.select(F.col("category").alias("c"), F.col("index").alias("k"))
    r = relations.join(features.select("image_id", "features"), "image_id", "left")
    r = r.join(codes.select(F.col("c").alias("part_category"), F.col("k").alias("image_code")), "part_category", "left").join(codes.select(F.col("c").alias("text_category"), F.col("k").alias("text_code")), "text_category", "left")
    bad = F.col("features").isNull() | F.col("image_code").isNull() | F.col("text_code").isNull()
    return r.select(F.when(bad, F.raise_error(F.concat(F.lit("no features or codes for "), "sample_id")).cast("string")).otherwise(F.col("sample_id")).alias("sample_id"), "features", "description", encode(F.col("label"), labels).alias("label_code"), "image_code", "text_code")
