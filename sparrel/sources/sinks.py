"""Deterministic and guarded sinks."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparrel-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, and its lineage is cut."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def copy_verified(files: DataFrame, path: str) -> DataFrame:
    """target, sha256 of files (target, content, sha256) copied below path; what was written is read again, and bytes without their digest are an error."""
    files.select("target", "content", "sha256").write.parquet(path)
    copied = files.sparkSession.read.parquet(path)
    error = F.raise_error(F.concat(F.lit("not the bytes of "), F.coalesce("target", F.lit("null")))).cast("string")
    return copied.select(F.when(F.sha2("content", 256) == F.col("sha256"), F.col("target")).otherwise(error).alias("target"), "sha256")


def write_csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists", single_file: bool = False) -> None:
    """CSV with a header, newlines as line ends, in a total order.  A single file is for small reports only; else sorted part files follow each other."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single_file else out).write.mode(mode).option("header", True).option("lineSep", "\n").csv(path)


def write_partitioned(df: DataFrame, path: str, by: str = "split", mode: str = "errorifexists") -> None:
    """Parquet in a folder per value; existing output is refused unless mode says overwrite."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def rendered(document: dict) -> str:
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def _place(path: str):
    """The file system and path of a path with a scheme, as Spark sees it; a path without one is local."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{os.path.abspath(path)}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    files, p = _place(path)
    return files.exists(p)


def remove(path: str) -> None:
    """A file or folder with all that is in it; nothing if it isn't there."""
    files, p = _place(path)
    files.delete(p, True)


def rename(path: str, to: str) -> None:
    """Move a file or folder; refused if the target exists."""
    files, p = _place(path)
    target = _place(to)[1]
    if files.exists(target) or not files.rename(p, target):
        raise FileExistsError(to)


def read_bytes(path: str) -> bytes:
    """A small file's content."""
    files, p = _place(path)
    stream = files.open(p)
    try:
        return bytes(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(content: bytes, path: str, overwrite: bool = False) -> None:
    """A small file, wherever Spark can write; an existing one is refused unless told otherwise."""
    files, p = _place(path)
    if not overwrite and files.exists(p):
        raise FileExistsError(path)
    stream = files.create(p, overwrite)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_json(document: dict, path: str, overwrite: bool = False) -> None:
    """A small document with sorted keys; an existing file is refused."""
    write_bytes(rendered(document).encode(), path, overwrite)


def write_if_changed(document: dict, path: str) -> bool:
    """Write only if the bytes differ; whether it wrote."""
    new = rendered(document).encode()
    if exists(path) and read_bytes(path) == new:
        return False
    write_bytes(new, path, overwrite=True)
    return True


def digest(path: str) -> str:
    return hashlib.sha256(read_bytes(path)).hexdigest()


def write_lock(paths: list[str], path: str, **flags: bool) -> None:
    """A document of the files' digests and flags, written once."""
    write_json({"files": {os.path.basename(p): digest(p) for p in sorted(paths)}, "flags": flags}, path)


def verify_lock(lock: str, folder: str, **flags: bool) -> list[str]:
    """What differs from a lock: flags, and files that are missing or changed."""
    document = json.loads(read_bytes(lock))
    wrong = [f"flag {k}" for k, v in flags.items() if document["flags"].get(k) != v]
    for name, want in document["files"].items():
        p = f"{folder.rstrip('/')}/{name}"
        if not exists(p):
            wrong.append(f"missing {name}")
        elif digest(p) != want:
            wrong.append(f"changed {name}")
    return wrong


def state_digest(state: dict) -> str:
    """Digest of named arrays: name, type, shape and bytes in order of names, separated by zero bytes."""
    import numpy as np

    h = hashlib.sha256()
    for k in sorted(state):
        a = np.ascontiguousarray(state[k])
        for part in (k.encode(), str(a.dtype).encode(), str(a.shape).encode(), a.tobytes()):
            h.update(part + b"\0")
    return h.hexdigest()


def versions() -> dict[str, str]:
    """Versions of what results depend on."""
    import numpy
    import pyarrow
    import pyspark

    return {"python": sys.version.split()[0], "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "pyspark": pyspark.__version__}


def other_versions(wanted: dict[str, str]) -> list[str]:
    """What is installed in another version than wanted, build marks (after "+") aside; "3.5" also fits 3.5.1."""
    found = versions()
    plain = lambda v: v.split("+", 1)[0]
    fits = lambda name, v: plain(found.get(name, "none")) == plain(v) or plain(found.get(name, "none")).startswith(plain(v) + ".")
    return [f"{name} {found.get(name, 'none')}, not {v}" for name, v in sorted(wanted.items()) if not fits(name, v)]


def require_versions(wanted: dict[str, str]) -> None:
    """An error if other_versions() finds any; for runs that must be repeated exactly."""
    wrong = other_versions(wanted)
    if wrong:
        raise RuntimeError("; ".join(wrong))


def lineage(spark: SparkSession, seed: int, inputs: dict[str, str] | None = None, folder: str = ".") -> dict:
    """Versions, revision ("unknown" outside a repository), seed and input digests for a run's summary."""
    found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=folder, check=False)
    return {"revision": found.stdout.strip() if found.returncode == 0 and found.stdout.strip() else "unknown", "python": sys.version.split()[0], "spark": spark.version, "seed": seed, "inputs": inputs or {}}


def model_summary(weights: dict) -> str:
    """Name, shape and size of each array, and the total."""
    lines = [f"{k} {tuple(v.shape)} {v.size}" for k, v in sorted(weights.items())]
    return "\n".join([*lines, f"total {sum(v.size for v in weights.values())}"])
