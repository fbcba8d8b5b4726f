"""Files that tasks list and read in pieces: folder trees, contents by block, and the members of archives.

Paths are local ones or URIs that pyarrow's file systems open (file, hdfs, s3, gs); every executor must reach them."""

from __future__ import annotations

import fnmatch
import hashlib
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import findable
from . import sinks
from .readers import image_header

BLOCK = 1 << 20
#: Bytes of compressed members that a task of an archive reads, about.
TASK_BYTES = 64 << 20
#: First bytes of a member in which its picture's size is looked for.
HEAD_BYTES = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def blocks(stream) -> Iterator[bytes]:
    while data := stream.read(BLOCK):
        yield data


# Folder trees

_TREE = "root string, path string, folder boolean, size bigint"


def tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """root, path (below root), folder, size of everything below a folder, hidden names too; excluded folders are neither listed nor entered.

    Each round lists all folders of one depth in tasks, so neither the driver nor a single task walks the tree.  A root that isn't there is an error."""
    found, todo = [], findable(spark).createDataFrame([(root, "")], "root string, path string")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, base = opened(top)
                base = base.rstrip("/")
                rows = []
                for entry in system.get_file_info(fs.FileSelector(f"{base}/{path}" if path else base)):
                    folder = entry.type == fs.FileType.Directory
                    if not (folder and entry.base_name in excluded):
                        rows.append({"root": top, "path": entry.path[len(base) + 1 :], "folder": folder, "size": None if folder else entry.size})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("root", pa.string()), ("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())]))

    while True:
        level = sinks.written(todo.mapInArrow(listed, _TREE), "tree")
        found.append(level)
        folders = level.where("folder").select("root", "path")
        n = folders.count()
        if not n:
            break
        todo = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def digested(files: DataFrame) -> DataFrame:
    """files (root, path and others) with bytes and sha256 of each one's content, read in blocks; null where there is no such file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for top, path in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("root", "path"))):
                h, n = hashlib.sha256(), 0
                try:
                    system, base = opened(top)
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        for data in blocks(stream):
                            h.update(data)
                            n += len(data)
                    sizes, digests = [*sizes, n], [*digests, h.hexdigest()]
                except OSError:
                    sizes, digests = [*sizes, None], [*digests, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=[*batch.schema.names, "bytes", "sha256"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, bytes bigint, sha256 string")


def forbidden_paths(spark: SparkSession, root: str, names: list[str], parts: list[str] = (), excluded: tuple[str, ...] = (".git", ".venv", "__pycache__", ".pytest_cache")) -> DataFrame:
    """path, rule of each entry below a folder whose name fits a pattern of names, or whose path holds one of parts in any case."""
    rules = [(F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(fnmatch.translate(n).replace(r"\Z", "$"))), n) for n in names]
    rules += [(F.contains(F.lower("path"), F.lit(p.lower())), p) for p in parts]
    each = F.filter(F.array(*[F.when(fits, F.lit(rule)) for fits, rule in rules]), lambda r: r.isNotNull())
    return tree(spark, root, excluded).select("path", F.explode(each).alias("rule"))


def verified(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """path, problem (missing, changed) of a manifest's files (sha256, path) below root that aren't what it says."""
    found = digested(manifest.select(F.lit(root).alias("root"), "path", F.col("sha256").alias("wanted")))
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("wanted"), "changed")
    return found.select("path", problem.alias("problem")).where("problem is not null")


def written(contents: DataFrame, root: str) -> DataFrame:
    """path, bytes of contents (path, content) written as files below root, folders made as needed; a file that is there is replaced, so tasks may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{base.rstrip('/')}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_buffer()) for c in batch.column(1)], pa.int64())], names=["path", "bytes"])

    return contents.select("path", "content").mapInArrow(run, "path string, bytes bigint")


# Archives

ARCHIVE_SCHEMA = "archive string, path string, parts array<string>, safe boolean, crc_ok boolean, bytes bigint, sha256 string, width int, height int, mode string"


@dataclass
class _Span(InputPartition):
    """Members first to last (exclusive) of an archive's directory; first -1 for an archive that can't be read."""

    archive: str
    first: int
    last: int


class ArchiveSource(DataSource):
    """spark.read.format("archive_members").load(path): a row a member of a zip archive, or of each archive in a folder.

    Options: prefix and suffix of the members' paths, content ("true" adds their bytes), taskBytes.  The driver reads the archives' directories and deals their
    members out; a task reads the ranges of its own members, block by block, so neither an archive's size nor a member's bounds what can be read.  A broken
    member is a row with crc_ok false; a file that is no archive is a row without a path."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return ARCHIVE_SCHEMA + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> _ArchiveReader:
        return _ArchiveReader(dict(self.options))


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        self.path, self.prefix, self.suffix = lower["path"], lower.get("prefix", ""), lower.get("suffix", "").lower()
        self.content, self.task_bytes = lower.get("content", "false").lower() == "true", int(lower.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[_Span]:
        system, base = opened(self.path)
        info = system.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
        spans = []
        for f in sorted(files, key=lambda f: f.path):
            try:
                with system.open_input_file(f.path) as stream, zipfile.ZipFile(stream) as z:
                    sizes = [m.compress_size for m in z.infolist()]
            except (zipfile.BadZipFile, OSError, pa.ArrowInvalid):  # also where the file is too short to be one
                spans.append(_Span(f.path, -1, -1))
                continue
            first, total = 0, 0
            for k, size in enumerate(sizes):
                if total and total + size > self.task_bytes:
                    spans.append(_Span(f.path, first, k))
                    first, total = k, 0
                total += size
            if sizes:
                spans.append(_Span(f.path, first, len(sizes)))
        return spans

    def read(self, partition: _Span) -> Iterator[tuple]:
        extra = (None,) if self.content else ()
        if partition.first < 0:
            yield (partition.archive, None, None, None, False, None, None, None, None, None, *extra)
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.archive) as stream, zipfile.ZipFile(stream) as z:
            for member in z.infolist()[partition.first : partition.last]:
                clean = member.filename.replace("\\", "/")
                if clean.endswith("/") or not clean.startswith(self.prefix) or not clean.lower().endswith(self.suffix):
                    continue
                parts = clean.split("/")
                safe = not (clean.startswith("/") or ".." in parts or ":" in parts[0])
                yield (partition.archive, clean, parts, safe, *self._inspected(z, member))

    def _inspected(self, z: zipfile.ZipFile, member: zipfile.ZipInfo) -> tuple:
        """crc_ok, bytes, sha256, width, height, mode, and the content if asked for."""
        h, n, head, kept = hashlib.sha256(), 0, b"", []
        try:
            with z.open(member) as stream:
                for data in blocks(stream):
                    h.update(data)
                    n += len(data)
                    head = (head + data)[:HEAD_BYTES] if len(head) < HEAD_BYTES else head
                    if self.content:
                        kept.append(data)
        except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError, RuntimeError):
            return (False, 0, None, None, None, None, *((None,) if self.content else ()))
        size = image_header(head) or (None, None, None)
        return (True, n, h.hexdigest(), *size, *((b"".join(kept),) if self.content else ()))


def archive_members(spark: SparkSession, path: str, prefix: str = "", suffix: str = ".jpg", content: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """ArchiveSource over a path; see there."""
    findable(spark).dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").options(prefix=prefix, suffix=suffix, content=str(content).lower(), taskBytes=str(task_bytes)).load(path)
