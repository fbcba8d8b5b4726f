"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file (one per range of doc_ids) holds, little-endian:

    magic "EFT1" | id width (2 or 4) u32 | documents u64 | ids u64 | null doc_ids u64 | smallest doc_id i64
    | Elias-Fano of the boundaries (documents + 1 values) | Elias-Fano of doc_id - smallest | ids

An Elias-Fano list of n ascending values up to u keeps l = floor(log2(u / n)) low bits of each in a packed array and the rest in unary in a bit vector of
at most 2 n bits; select(i) finds the i-th set bit from a sampled count and a scan of one small block, so offsets need no 64-bit table.

Files are written by tasks to a name of the attempt's own and then moved to the final name, so that a task that runs twice leaves the same file once.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pretokenize

TOKENIZER_PATH = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: Bytes of text that make a file.
FILE_TEXT_BYTES = 16 << 20
#: Pieces that a worker remembers at most.
CACHE_PIECES = 600_000
#: Bytes of ids that are remembered of a piece, at most.
CACHE_BYTES = 128
#: Characters of text that are cut into pieces at once.
CHUNK_CHARS = 1 << 20
_MAGIC, _HEAD = b"EFT1", struct.Struct("<4sIQQQq")
_SAMPLE = 256
_CUT = re.compile(r"(?<=\S) (?=\S)")


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ranks: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: ascending, not negative."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if int(values[-1]) >= n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def dump(self) -> bytes:
        return struct.pack("<QIQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QIQQ", data, at)
        at += struct.calcsize("<QIQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high), at + a + b

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (chunk >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from one block of the bit vector."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        if self._ranks is None:  # set bits before every block
            counts = np.bitwise_count(self.high).astype(np.int64)
            self._ranks = np.concatenate(([0], np.add.reduceat(counts, np.arange(0, len(counts), _SAMPLE)).cumsum()))
        block = int(np.searchsorted(self._ranks, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * _SAMPLE : (block + 1) * _SAMPLE], bitorder="little")
        at = int(np.flatnonzero(bits)[i - self._ranks[block]]) + block * _SAMPLE * 8
        return ((at - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class TokenFile:
    """A file's content with random access by document."""

    def __init__(self, content: bytes) -> None:
        magic, self.width, self.docs, self.n_ids, self.null_ids, self.smallest = _HEAD.unpack_from(content)
        if magic != _MAGIC:
            raise ValueError("not a token-id file")
        data = memoryview(content)
        self.bounds, at = EliasFano.load(data, _HEAD.size)
        self.keys, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.null_ids + [int(k) + self.smallest for k in self.keys.values()]


def dump(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """doc_ids: nulls first, then ascending."""
    known = [i for i in doc_ids if i is not None]
    smallest = known[0] if known else 0
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    keys = np.array([i - smallest for i in known], dtype=np.uint64)
    head = _HEAD.pack(_MAGIC, width, len(doc_ids), len(ids) // width, len(doc_ids) - len(known), smallest)
    return b"".join((head, EliasFano.of(bounds).dump(), EliasFano.of(keys).dump(), ids))


class Encoder:
    """The tokenizers library's ids as little-endian bytes.

    Texts are cut at the added tokens of the tokenizer's file first, which have ids of their own.  What stands between is cut into the pieces of the library's
    pretokenizer here, many characters at a time, and each distinct piece is encoded by the library once; no piece's ids depend on its neighbours.  Pieces
    are told apart by two 64-bit hashes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.array = {2: "H", 4: "I"}[self.width]
        added = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.added = {t.content: array(self.array, [i]).tobytes() for i, t in added.items()}
        # The leftmost is taken, of those that start at one place the longest.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and END_ID."""
        out: list[tuple[bytes, bool]] = []
        part: list[str] = []
        ends: list[bool] = []
        after: list[bytes] = []
        size = 0
        for text in texts:
            for chunk, last, added in self._parts(text):
                part.append(chunk)
                ends.append(last)
                after.append(added)
                size += len(chunk) + 1
                if size >= CHUNK_CHARS:
                    out += self._encode(part, ends)
                    part, ends, size = [], [], 0
        if part:
            out += self._encode(part, ends)
        # A chunk's ids and the added token behind it, joined up to the chunk that ends its text.
        joined, held = [], []
        for (ids, last), added in zip(out, after, strict=True):
            held.append(ids + added if added else ids)
            if last:
                joined.append(held[0] if len(held) == 1 else b"".join(held))
                held = []
        return joined

    def _parts(self, text: str) -> Iterator[tuple[str, bool, bytes]]:
        """A text's chunks between its added tokens; whether the text ends there, and the id of the added token that follows."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            for chunk, last in _chunks(text[at : m.start()]):
                yield chunk, False, self.added[m.group()] if last else b""
            at = m.end()
        for chunk, last in _chunks(text[at:] if at else text):
            yield chunk, last, b""

    def _encode(self, chunks: list[str], ends: list[bool]) -> list[tuple[bytes, bool]]:
        if len(self.known) > CACHE_PIECES // 2:  # pieces not met since the last time are forgotten
            self.known, self.older = {}, self.known
        text = "\0".join((*chunks, ""))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        borders = np.cumsum([len(c) + 1 for c in chunks]) - 1
        points[borders] = np.where(ends, pretokenize.END, pretokenize.GAP)
        starts = pretokenize.starts(points)
        stops = np.append(starts[1:], len(points))
        one, two = pretokenize.hashes(points, starts, stops)
        unique, first, of = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[first][of]).any():
            return self._whole(chunks, ends)
        keys = unique.tolist()
        found = list(map(self.known.get, keys))
        if new := [k for k, f in enumerate(found) if f is None]:
            for k in new:
                if (f := self.older.get(keys[k])) is not None:
                    found[k] = self.known[keys[k]] = f
            new = [k for k in new if found[k] is None]
        if new:
            begin, stop = starts[first[new]].tolist(), stops[first[new]].tolist()
            coded = self.library.encode_batch_fast([text[a:b] for a, b in zip(begin, stop, strict=True)], add_special_tokens=False)
            check = two[first[new]].tobytes()
            for at, (k, e, point) in enumerate(zip(new, coded, points[begin].tolist(), strict=True)):
                ids = e.ids if point < pretokenize.END else [END_ID] if point == pretokenize.END else []
                found[k] = check[8 * at : 8 * at + 8] + array(self.array, ids).tobytes()
            self.known.update((keys[k], found[k]) for k in new if len(found[k]) <= CACHE_BYTES)
        # Of each distinct piece the second hash and the ids stand one after the other.
        store = np.frombuffer(b"".join(found), f"<u{self.width}")
        size, head = np.fromiter(map(len, found), np.int64, len(found)) // self.width, 8 // self.width
        place = np.cumsum(size) - size
        if (store[place[:, None] + np.arange(head)].view("<u8").ravel() != two[first]).any():
            return self._whole(chunks, ends)
        length, source = (size - head)[of], (place + head)[of]
        total = np.cumsum(length)
        ids = store[np.repeat(source - total + length, length) + np.arange(total[-1])]
        cut = [0, *total[np.searchsorted(starts, borders)].tolist()]
        return [(ids[a:b].tobytes(), last) for a, b, last in zip(cut[:-1], cut[1:], ends, strict=True)]


    def _whole(self, chunks: list[str], ends: list[bool]) -> list[tuple[bytes, bool]]:
        """The library's ids of whole chunks: two pieces have one hash (at odds below 2^-60 a chunk)."""
        coded = (c.ids for c in self.library.encode_batch_fast(chunks, add_special_tokens=False))
        return [(array(self.array, [*ids, END_ID] if last else ids).tobytes(), last) for ids, last in zip(coded, ends, strict=True)]


def _chunks(text: str) -> Iterator[tuple[str, bool]]:
    """A text in chunks of bounded size, cut only before a space between two words, where a piece always starts; whether it is the last."""
    at = 0
    while len(text) - at > CHUNK_CHARS and (m := _CUT.search(text, at + CHUNK_CHARS)):
        yield text[at : m.start()], False
        at = m.start()
    yield text[at:], True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{os.path.abspath(uri)}")


def _publish(uri: str, name: str, content: bytes) -> None:
    files, folder = _filesystem(uri)
    own = f"{folder}/_{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(content)
    files.move(own, f"{folder}/{name}")


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER_PATH, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write the ids of docs (doc_id, text) to path/ids in ascending doc_id order (nulls first, null and equal ids by hash of the text, so that they may fill several files)
    and return the manifest: file string, first_id bigint, docs bigint, ids bigint.  Null texts count as empty; each document ends with END_ID."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    files = max(1, -(-common.total_bytes(docs, "text") // file_text_bytes))
    by = F.col("doc_id"), F.xxhash64("text")
    ordered = docs.repartitionByRange(files, *by).sortWithinPartitions(*by, "text")
    ids_path, (fs, folder) = f"{path}/ids", _filesystem(f"{path}/ids")
    fs.create_dir(folder)
    out = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, doc_ids, lengths, ids = encoder(tokenizer), [], [], []
        for batch in common.slices(batches):
            doc_ids += batch.column(0).to_pylist()
            for coded in e.encode(batch.column(1).to_pylist()):
                lengths.append(len(coded) // e.width)
                ids.append(coded)
        if doc_ids:
            name = f"{TaskContext.get().partitionId():08d}.eft"
            _publish(ids_path, name, dump(doc_ids, lengths, b"".join(ids), e.width))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, doc_ids[0], len(doc_ids), sum(lengths)), out.types, strict=True)], schema=out)

    common.map_arrow(ordered, run, "file string, first_id bigint, docs bigint, ids bigint").write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema("file string, first_id bigint, docs bigint, ids bigint").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document of the files under path, from the files themselves."""
    manifest = spark.read.schema("file string, first_id bigint, docs bigint, ids bigint").parquet(f"{path}/manifest")
    # one row per file; files are in the order of their range partitions
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(f"{path}/ids").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    out = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                f = TokenFile(content.as_buffer())
                bounds = f.bounds.values().astype(np.int64)
                crcs = [zlib.crc32(f.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * f.docs, pa.string()), pa.array(f.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], schema=out)

    found = common.map_arrow(files, run, "file string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
