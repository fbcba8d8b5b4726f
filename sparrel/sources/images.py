"""Pictures from files: each distinct path decoded once, brought to one size, joined back to the rows that ask for it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(content: bytes) -> np.ndarray:
    """Height x width x 3 values of 0..255 (grey repeated, palettes looked up, transparency left out); 16-bit samples lose their low byte.

    Interlaced files and damaged ones raise ValueError."""
    try:
        return _decoded(content)
    except (zlib.error, struct.error, IndexError, KeyError) as e:
        raise ValueError(f"not a readable PNG: {e}") from e


def _decoded(content: bytes) -> np.ndarray:
    if content[:8] != PNG:
        raise ValueError("not a PNG")
    at, head, palette, data = 8, None, None, []
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body, checksum = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if struct.unpack(">I", checksum)[0] != zlib.crc32(name + body):
            raise ValueError("not a readable PNG: checksum")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[6]:
        raise ValueError("not a readable PNG: interlaced, or without a header")
    width, height, depth, kind = head[:4]
    channels = _CHANNELS[kind]
    line, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (line + 1):
        raise ValueError("not a readable PNG: length")
    raw = raw.reshape(height, line + 1)
    rows = _unfiltered(raw[:, 0], raw[:, 1:], step)
    if depth == 16:
        values = rows[:, ::2]
    elif depth == 8:
        values = rows
    else:
        values = np.unpackbits(rows, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        values = values[:, : width * channels] * (1 if kind == 3 else 255 // ((1 << depth) - 1))
    values = values.reshape(height, width, channels)
    if kind == 3:
        return palette[values[:, :, 0]]
    return values[:, :, :3] if channels > 2 else np.repeat(values[:, :, :1], 3, axis=2)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Lines with the differences to their left, upper and upper left neighbours added up again."""
    out = np.zeros(lines.shape, np.uint8)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(kinds.tolist(), lines)):
        if kind == 0:
            row = line
        elif kind == 1:  # left: a running sum for each byte of a pixel
            row = np.empty_like(line)
            for k in range(step):
                row[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            row = _predicted(line.tolist(), above.tolist(), step, _average if kind == 3 else _nearest)
        else:
            raise ValueError("not a readable PNG: filter")
        out[y] = above = row
    return out


def _predicted(line: list[int], above: list[int], step: int, guess: Callable[[int, int, int], int]) -> np.ndarray:
    row = [0] * len(line)
    for x, v in enumerate(line):
        left, corner = (row[x - step], above[x - step]) if x >= step else (0, 0)
        row[x] = (v + guess(left, above[x], corner)) & 255
    return np.array(row, np.uint8)


def _average(left: int, up: int, corner: int) -> int:
    return (left + up) // 2


def _nearest(left: int, up: int, corner: int) -> int:
    """Of the three neighbours, the one nearest to left + up - corner; of equal ones the first in this order."""
    return min((left, up, corner), key=lambda v: abs(left + up - corner - v))


def encode_png(picture: np.ndarray) -> bytes:
    """A PNG of height x width x 3 values, each line by another filter in turn (none, left, up)."""
    height, width = picture.shape[:2]
    flat = picture.astype(np.uint8).reshape(height, -1)
    lines = []
    for y in range(height):
        before = {0: np.zeros_like(flat[y]), 1: np.concatenate((np.zeros(3, np.uint8), flat[y, :-3])), 2: flat[y - 1] if y else np.zeros_like(flat[y])}[y % 3]
        lines.append(bytes([y % 3]) + (flat[y] - before).tobytes())
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines), 1)) + chunk(b"IEND", b"")


def decoded(contents: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """path, channels (three, each an array of rows), error of files (path, content); an unreadable or null content has an error and no channels."""
    out = pa.schema([("path", pa.string()), ("channels", pa.list_(pa.list_(pa.list_(pa.int32())))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                channels, error = None, None
                try:
                    channels = np.moveaxis(decode(content.as_py() or b""), 2, 0).tolist()
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path.as_py(), channels, error), out.types, strict=True)], schema=out)

    return contents.select("path", "content").mapInArrow(run, "path string, channels array<array<array<int>>>, error string")


def loaded(paths: DataFrame, contents: DataFrame, width: int, height: int, decode: Callable[[bytes], np.ndarray] = decode_png, kind: str = "bilinear") -> DataFrame:
    """paths with channels (three of height x width values of 0..255): each distinct path is decoded and resized once, whatever the number of rows that ask for it.

    Backslashes in paths are slashes.  A path without a file, or whose file can't be read, is an error, never a lost row."""
    tidy = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    asked = paths.withColumn("path", tidy)
    files = contents.select(tidy.alias("path"), "content").dropDuplicates(["path"]).join(asked.select("path").distinct(), "path", "left_semi")
    small = F.transform("channels", lambda c: P.resized(c, width, height, kind))
    once = decoded(files, decode).select("path", small.alias("channels"), F.coalesce("error", F.lit("")).alias("error"))
    met = asked.join(once, "path", "left")
    why = F.raise_error(F.concat(F.lit("no picture at "), F.coalesce("path", F.lit("null")), F.lit(": "), F.coalesce("error", F.lit("no file"))))
    return met.withColumn("channels", F.when(F.col("channels").isNull(), why.cast("array<array<array<bigint>>>")).otherwise(F.col("channels"))).drop("error")
