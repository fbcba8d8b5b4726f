"""Exact substring deduplication with fixed-block anchors.

Words are maximal runs of bytes other than ASCII white space.  A window is 50 consecutive words of a document; every word covered by a window whose word
sequence also starts in a document with a smaller doc_id is removed.

Any window holds a whole block of 25 words that starts at a multiple of 25, wherever the window starts.  So the blocks at these places of every document are
indexed, and every rolling sequence of 25 words of every document probes the index.  Where a block and a sequence of another document meet, only the windows
around the hit can repeat.  These get strong digests, which tell for each window whether it starts in a smaller document.

Documents stay in groups of bounded size; what groups tell each other is packed and dealt out by hash: first 30 bits of each distinct
rolling hash with two flags (packed to about two bytes), then 96-bit digests of candidate windows.  A hit is extended window by window in both directions, as
long as digests match; the union of matching windows is the maximal exact repeat.  Either kind of value comes at most once from each group,
whatever its number of occurrences: the group judges its other documents by its own smallest one, and only that one by the other groups.

Null doc_ids count as larger than any other; null texts have no words; documents with equal ids don't remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

WINDOW = 50
BLOCK = 25
#: Text bytes of a group of documents, and text bytes per bucket of hashes.
GROUP_BYTES, BUCKET_BYTES = 5 << 20, 12 << 20
CACHE_WORDS = 150_000
#: Bytes of a word that is remembered, at most.
CACHE_BYTES = 64
#: Powers that a rolling hash keeps, at most; those of longer texts are made anew.
KEPT_POWERS = 1 << 17
_VALUE_BITS = 30
_NO_ID = np.iinfo(np.int64).max
# Odd constants of the three rolling hashes.
_WEAK, _STRONG_A, _STRONG_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            self[word] = h
        return h


_known = _Words()
common.keeps("words", _known.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > CACHE_WORDS:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all sequences of size words: sums of word hashes times powers of an odd number, modulo 2^64, mixed."""

    def __init__(self, factor: int) -> None:
        self.factor, self.powers = factor, np.ones(1, np.uint64)
        self.inverse = pow(factor, -1, 1 << 64)
        self.inverses = np.ones(1, np.uint64)

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least n powers, and their inverses."""
        if len(self.powers) >= n:
            return self.powers, self.inverses
        n = max(n, min(2 * len(self.powers), KEPT_POWERS), 4096)
        made = [np.concatenate(([np.uint64(1)], np.full(n - 1, f, np.uint64))).cumprod(dtype=np.uint64) for f in (self.factor, self.inverse)]
        if n <= KEPT_POWERS:
            self.powers, self.inverses = made
        return made[0], made[1]

    def __call__(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.uint64)
        powers, inverses = self._table(n)
        sums = np.concatenate((np.zeros(1, np.uint64), (hashes * powers[:n]).cumsum(dtype=np.uint64)))
        x = (sums[size:] - sums[:-size]) * inverses[: n - size + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


weak, strong_a, strong_b = Rolling(_WEAK), Rolling(_STRONG_A), Rolling(_STRONG_B)


def pack(values: np.ndarray) -> bytes:
    """Ascending uint32 as differences, byte planes apart, so that the shuffle's compression drops the empty ones."""
    return np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().cumsum(dtype=np.uint32)


def _order(table: pa.Table) -> list[int]:
    """An order of the group's rows that doesn't depend on how they came."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    return sorted(range(table.num_rows), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or b""))


def _documents(table: pa.Table) -> Iterator[tuple[int | None, list[bytes]]]:
    """doc_id and words of the group's rows, in that order."""
    rows = table.select(["doc_id", "text"]).take(_order(table))
    for doc_id, text in zip(rows.column("doc_id"), rows.column("text"), strict=True):
        yield doc_id.as_py(), (text.as_py() or b"").split()


def _keys(hashes: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 30-bit value, as one number, of every rolling block-sized sequence; documents' lengths."""
    parts = [weak(h, BLOCK) for h in hashes]
    r = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return ((r >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(_VALUE_BITS) | (r & np.uint64((1 << _VALUE_BITS) - 1)), np.array([len(p) for p in parts])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each run in an ascending array."""
    if len(bucket):
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True)


_PROBES = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("packed", pa.binary())])
_WINDOWS = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("place", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary()), ("twins", pa.binary())])
_GONE = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("packed", pa.binary()), ("twins", pa.binary())])


def probes(grp: int, table: pa.Table, buckets: int) -> pa.Table:
    """Every distinct rolling hash of a group, flagged 1 if it is an indexed block, 2 if two documents of the group have it."""
    key, lengths = _keys([word_hashes(w) for _, w in _documents(table) if len(w) >= WINDOW], buckets)
    if not len(key):
        return _PROBES.empty_table()
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    doc, block = np.repeat(np.arange(len(lengths)), lengths), (np.arange(len(key)) - starts) % BLOCK == 0
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(first[1:], len(key)) - 1
    flags = np.maximum.reduceat(block[order].astype(np.uint32), first) | (doc[first] != doc[last]).astype(np.uint32) << 1
    key = key[first]
    value = (key & np.uint64((1 << _VALUE_BITS) - 1)).astype(np.uint32) << np.uint32(2) | flags
    rows = [(b, grp, pack(value[i:j])) for b, i, j in _by_bucket((key >> np.uint64(_VALUE_BITS)).astype(np.int64))]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PROBES.types, strict=True)], schema=_PROBES)


def matches(bucket: int, table: pa.Table) -> pa.Table:
    """The values of a bucket that are a block somewhere and stand in two documents, for each group that has them."""
    groups = table.column("grp").to_pylist()
    parts = [unpack(p) for p in table.column("packed").to_pylist()]
    value, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(value >> np.uint32(2), kind="stable")
    flags, v, of = value[order] & np.uint32(3), value[order] >> np.uint32(2), of[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    size = np.diff(np.append(first, len(v)))
    seen = np.bitwise_or.reduceat(flags, first)
    hit = np.repeat((seen & 1 > 0) & ((seen & 2 > 0) | (size > 1)), size)
    v, of = v[hit], of[hit]
    order = np.argsort(of, kind="stable")
    v, of = v[order], of[order]
    rows = [(bucket, groups[k], pack(v[i:j])) for k, i, j in _by_bucket(of)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PROBES.types, strict=True)], schema=_PROBES) if rows else _PROBES.empty_table()


def windows(grp: int, table: pa.Table, hits: pa.Table, buckets: int) -> pa.Table:
    """Each strong digest of a group's windows around hits once, with its first place in the group's smallest document that has it, and runs of doc_ids.

    A row of bucket -1 - grp holds what the group knows by itself: places that go for a smaller document of the group, and twins, places
    that go if their first place does."""
    if not hits.num_rows:
        return _WINDOWS.empty_table()
    found = np.sort(np.concatenate([np.uint64(b) << np.uint64(_VALUE_BITS) | unpack(p).astype(np.uint64) for b, p in zip(hits.column("bucket").to_pylist(), hits.column("packed").to_pylist(), strict=True)]))
    base, out = 0, []
    for doc_id, words in _documents(table):
        n = len(words)
        if n >= WINDOW:
            h = word_hashes(words)
            key, _ = _keys([h], buckets)
            at = np.minimum(np.searchsorted(found, key), len(found) - 1)
            hit = np.concatenate(([0], (found[at] == key).cumsum()))
            reach = WINDOW - BLOCK + 1  # places in a window where a whole block can start
            start = np.flatnonzero(hit[reach:] - hit[:-reach])
            if len(start):
                out.append((strong_a(h, WINDOW)[start], strong_b(h, WINDOW)[start] >> np.uint64(32), start + base, np.full(len(start), _NO_ID if doc_id is None else doc_id)))
        base += n
    if not out:
        return _WINDOWS.empty_table()
    high, low, place, ids = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((low, high))  # stable: of one digest the smallest document comes first, then the first place
    first = np.flatnonzero(np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))))
    head = np.repeat(order[first], np.diff(np.append(first, len(order))))
    later, twin = ids[order] > ids[head], (ids[order] == ids[head]) & (order != head)
    own = pack(np.sort(place[order[later]]))
    twins = np.stack((place[head[twin]], place[order[twin]])).astype("<u4")
    rows = [(-1 - grp, grp, b"", b"", own, b"", b"", twins.tobytes())] if later.any() or twin.any() else []
    once = np.sort(order[first])
    high, low, place, ids = high[once], low[once], place[once], ids[once]
    bucket = ((high >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for b, i, j in _by_bucket(bucket[order]):
        k = order[i:j]
        run = np.flatnonzero(np.concatenate(([True], ids[k][1:] != ids[k][:-1])))
        rows.append((b, grp, high[k].tobytes(), low[k].astype("<u4").tobytes(), pack(place[k]), ids[k][run].tobytes(), np.diff(np.append(run, len(k))).astype("<u4").tobytes(), b""))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _WINDOWS.types, strict=True)], schema=_WINDOWS)


def verdicts(bucket: int, table: pa.Table) -> pa.Table:
    """For each group the places of windows whose digest a document with a smaller id has too; what a group knows by itself is handed on."""
    if bucket < 0:
        return pa.Table.from_arrays([table.column(c) for c in ("bucket", "grp", "place", "twins")], schema=_GONE)
    groups, parts = table.column("grp").to_pylist(), []
    for k in range(table.num_rows):
        high, low, place, ids, runs = (table.column(c)[k].as_py() for c in ("high", "low", "place", "ids", "runs"))
        place = unpack(place)
        parts.append((np.frombuffer(high, np.uint64), np.frombuffer(low, "<u4"), np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(runs, "<u4")), place, np.full(len(place), k)))
    high, low, ids, place, of = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, low, high))
    high, low, ids, place, of = high[order], low[order], ids[order], place[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    gone = ids > np.repeat(ids[first], np.diff(np.append(first, len(ids))))
    place, of = place[gone], of[gone]
    order = np.lexsort((place, of))
    rows = [(bucket, groups[k], pack(place[order[i:j]]), b"") for k, i, j in _by_bucket(of[order])]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _GONE.types, strict=True)], schema=_GONE) if rows else _GONE.empty_table()


def _removed(table: pa.Table, gone: pa.Table) -> Iterator[tuple[int | None, list[bytes], np.ndarray | None]]:
    """doc_id, words, and which words go (None: none), for each document of a group."""
    place = np.concatenate([unpack(p) for p in gone.column("packed").to_pylist()]).astype(np.int64) if gone.num_rows else np.zeros(0, np.int64)
    for twins in filter(None, gone.column("twins").to_pylist()):
        head, other = np.frombuffer(twins, "<u4").reshape(2, -1).astype(np.int64)
        place = np.concatenate((place, other[np.isin(head, place)]))
    place.sort()
    base = 0
    for doc_id, words in _documents(table):
        n = len(words)
        a, b = np.searchsorted(place, (base, base + n))
        mask = None
        if b > a:
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, place[a:b] - base, 1)
            np.add.at(edge, place[a:b] - base + WINDOW, -1)
            mask = edge.cumsum()[:n] > 0
        yield doc_id, words, mask
        base += n


def _grouped(docs: DataFrame, group_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, text, rest (all other columns), grp; number of buckets."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.struct(*rest).alias("rest"))
    size = common.total_bytes(docs, "text")
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // bucket_bytes))
    return docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))), buckets


def find(docs: DataFrame, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents by group, and for each group the packed places of windows that go."""
    docs, buckets = _grouped(docs, group_bytes, bucket_bytes)
    key = lambda k: k[0].as_py()
    probe = docs.groupBy("grp").applyInArrow(lambda k, t: probes(key(k), t, buckets), "bucket bigint, grp bigint, packed binary")
    hits = probe.groupBy("bucket").applyInArrow(lambda k, t: matches(key(k), t), "bucket bigint, grp bigint, packed binary")
    strong = docs.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(lambda k, t, h: windows(key(k), t, h, buckets), "bucket bigint, grp bigint, high binary, low binary, place binary, ids binary, runs binary, twins binary")
    return docs, strong.groupBy("bucket").applyInArrow(lambda k, t: verdicts(key(k), t), "bucket bigint, grp bigint, packed binary, twins binary")


def dedup(docs: DataFrame, **sizes: int) -> DataFrame:
    """docs with the repeated words taken out of text (kept words joined by one space; unchanged where nothing is removed); all other columns stay.

    Every row stays, also one whose words all went."""
    columns = docs.columns
    docs, gone = find(docs, **sizes)
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), docs.schema["rest"]])

    def run(table: pa.Table, gone: pa.Table) -> pa.Table:
        rows = table.take(_order(table))
        texts = rows.column("text").cast(pa.string()).to_pylist()
        if gone.num_rows:
            for k, (_, words, mask) in enumerate(_removed(table, gone)):
                if mask is not None:
                    texts[k] = b" ".join(w for w, g in zip(words, mask.tolist(), strict=True) if not g).decode()
        return pa.Table.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string()), rows.column("rest")], names=["doc_id", "text", "rest"])

    out = docs.groupBy("grp").cogroup(gone.groupBy("grp")).applyInArrow(run, schema)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in columns])


def digests(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    docs, gone = find(docs, **sizes)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(table: pa.Table, gone: pa.Table) -> pa.Table:
        rows = []
        for doc_id, words, mask in _removed(table, gone):
            kept = words if mask is None else [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out) if rows else out.empty_table()

    return docs.groupBy("grp").cogroup(gone.groupBy("grp")).applyInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
