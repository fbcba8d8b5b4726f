"""Benchmark decontamination by a prefix-filtered containment join.

Words: A-Z are lower-cased, then maximal runs of anything but ASCII other than letters and digits, on UTF-8 bytes.  A window is 13 consecutive words of an item (the
whole item if it has fewer).  A window is the set of its shingles of three words (all its words if it has fewer).

1. Windows are made once, each different one counts once, whatever items have it.
2. Over all documents it is counted in how many of them each shingle of a window is; this is the order by rarity.
3. A text contains a window only if it contains all its shingles, so the necessary prefix of the ordered window is its rarest shingle.  Windows whose rarest
   shingle is in no document go.
4. Documents meet windows in an equi-join at this shingle.  The shingle's place in the window bounds where the window starts and ends in the document (the
   positional and the length bound), and the words there are compared with the window's, exactly.  A document sends the words around a shingle once for all its
   places with the same ones, and its places packed; a window of no more words than a shingle needs no words around it.  So what a document sends does not
   grow with its words times the window's, even for an item of a single frequent word.
5. Where windows occur is put together by text, so that copies of a text are searched as one.

What tasks need beforehand is a Bloom filter over the shingles, of FILTER_BITS at most whatever the benchmark's size (a full one lets more through to the join, which
is exact).  Both passes over the documents stay two for any benchmark.  Nothing of the benchmark is held by the driver but the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .substring_dedup import Rolling, pack, unpack, word_hashes

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: A document counts as contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20
#: Bits of a Bloom filter at most, and bits for each shingle below that.
FILTER_BITS, BITS_EACH = 1 << 27, 16
#: Bytes of a join's smaller side up to which it is broadcast, and parts that the rows of one key are dealt to beyond it.
BROADCAST_BYTES, SALTS = 8 << 20, 16
#: Words that a task hashes at once (a document's words stay together).
GROUP_WORDS = 1 << 15
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 500_000
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_rolling = Rolling(0xA24BAED4963EE407)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all sequences of so many words."""
    return _rolling(word_hashes(words), size)


def grouped(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words, some texts at a time: the first one's place, and the words of each."""
    first, group, held = 0, [], 0
    for at, text in enumerate(texts):
        words = words_of(text)
        if group and held + len(words) > GROUP_WORDS:
            yield first, group
            first, group, held = at, [], 0
        group.append(words)
        held += len(words)
    if group:
        yield first, group


class Shingled:
    """The shingles of a group of texts: their hashes by size, each text's own ones only, whatever stands beside it."""

    def __init__(self, group: list[list[bytes]]) -> None:
        self.lengths = np.array([len(w) for w in group])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.of = np.repeat(np.arange(len(group)), self.lengths)
        self.hashes = word_hashes([w for words in group for w in words])

    def found(self, k: int, *filters: Filter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each filter the shingles of k words that it lets through: text, place in it and hash, in order."""
        r, out = _rolling(self.hashes, k), []
        for f in filters:
            at = np.flatnonzero(f(r))
            at = at[self.of[at] == self.of[at + k - 1]]
            of = self.of[at]
            out.append((of, at - self.starts[of], r[at]))
        return out


class Filter:
    """A Bloom filter over 64-bit hashes, two bits each."""

    def __init__(self, hashes: DataFrame, most_bits: int | None = None) -> None:
        """hashes: one bigint column of distinct values."""
        name = hashes.columns[0]
        count = hashes.count()
        bits = 1 << min((most_bits or FILTER_BITS).bit_length() - 1, max(10, (count * BITS_EACH).bit_length()))
        self.mask = bits - 1
        places = F.explode(F.array(F.col(name).bitwiseAND(self.mask), F.shiftrightunsigned(name, 32).bitwiseAND(self.mask)))
        slots = hashes.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("set"))
        found = slots.toArrow()  # at most a row per 64 bits
        self.words = np.zeros(bits // 64, np.int64)
        self.words[found.column("slot").to_numpy()] = found.column("set").to_numpy()
        self.words, self.empty = self.words.view(np.uint64), count == 0

    def _set(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        at = (hashes >> np.uint64(shift)) & np.uint64(self.mask)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be in it."""
        out = np.zeros(len(hashes), bool)
        if not self.empty:
            first = np.flatnonzero(self._set(hashes, 0))
            out[first[self._set(hashes[first], 32)]] = True
        return out


_WINDOWS = pa.schema([("item", pa.string()), ("win", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))])


def windows(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """item (null where item_id is), win (its words, joined), n (words), k (words of a shingle), shingles of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 16):
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                k = min(SHINGLE_WORDS, n)
                of = shingles(words, k).view(np.int64) if n else None
                for i in range(len(words) - n + 1 if n else 0):
                    rows.append((item, b" ".join(words[i : i + n]).decode(), n, k, of[i : i + n - k + 1]))
                    if len(rows) == 4096:
                        yield _batch(rows, _WINDOWS)
                        rows = []
            yield _batch(rows, _WINDOWS)

    return common.map_arrow(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")), run, "item string, win string, n int, k int, shingles array<bigint>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def document_frequency(docs: DataFrame, wanted: Filter, sizes: list[int]) -> DataFrame:
    """shingle, df: in how many of docs (text binary) each shingle is that the filter lets through."""
    schema = pa.schema([("shingle", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in common.slices(batches):
            for _, group in grouped(batch.column(0).to_pylist()):
                of_group = Shingled(group)
                for k in sizes:
                    of, _, h = of_group.found(k, wanted)[0]
                    order = np.lexsort((h, of))
                    of, h = of[order], h[order]
                    once = np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])))[: len(h)]
                    found, df = np.unique(h[once], return_counts=True)
                    for x, n in zip(found.view(np.int64).tolist(), df.tolist(), strict=True):
                        held[x] = held.get(x, 0) + n
            if len(held) > HELD_COUNTS:
                yield _batch(list(held.items()), schema)
                held = {}
        yield _batch(list(held.items()), schema)

    return common.map_arrow(docs, run, "shingle bigint, df bigint").groupBy("shingle").agg(F.sum("df").alias("df"))


def prefixes(wins: DataFrame, frequency: DataFrame) -> DataFrame:
    """win, n, k, shingle, place of the rarest shingle of each window that may occur (ties: the smaller hash, then the first place)."""
    each = wins.select("win", "n", "k", F.posexplode("shingles").alias("place", "shingle")).join(frequency, "shingle", "left")
    least = each.groupBy("win", "n", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "place")).alias("least"))
    return least.where("least.df > 0").select("win", "n", "k", F.col("least.shingle").alias("shingle"), F.col("least.place").alias("place"))


_PROBED = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("shingle", pa.int64()), ("short", pa.bool_()), ("off", pa.int32()), ("around", pa.string()), ("places", pa.binary())])


def _contexts(words: list[bytes], places: np.ndarray, hashes: np.ndarray, k: int, reach: int) -> dict[tuple, list[int]]:
    """(hash, words around, place among them) -> places, of the shingles at the places; reach: words that count on each side."""
    out: dict[tuple, list[int]] = {}
    for at, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
        first = max(0, at - reach)
        out.setdefault((h, b" ".join(words[first : at + k + reach]), at - first), []).append(at)
    return out


def probe(docs: DataFrame, long: Filter, short: Filter, sizes: list[int], window: int) -> DataFrame:
    """Of every document (doc_id, k1, k2, text binary) a row with its number of words, and a row for each shingle that a filter lets through and each different
    surrounding of it: the words that a window may cover there (of short windows the shingle alone), its place among them, and its places in the document, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows: list[tuple] = []
            ids = [c.to_pylist() for c in batch.columns[:3]]
            for start, group in grouped(batch.column(3).to_pylist()):
                keys = list(zip(*(c[start : start + len(group)] for c in ids), strict=True))
                rows += [(*key, len(words), None, None, None, None, None) for key, words in zip(keys, group, strict=True)]
                of_group = Shingled(group)
                for k in sizes:
                    for is_short, (of, place, hashes) in zip((True, False), of_group.found(k, short, long), strict=True):
                        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
                        for a, b in zip(edges, edges[1:]):
                            text = int(of[a])
                            for (h, around, off), places in _contexts(group[text], place[a:b], hashes[a:b], k, 0 if is_short else window - k).items():
                                rows.append((*keys[text], len(group[text]), h, is_short, off, around.decode(), pack(np.array(places))))
                                if len(rows) >= 4096:
                                    yield _batch(rows, _PROBED)
                                    rows = []
            yield _batch(rows, _PROBED)

    return common.map_arrow(docs, run, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, shingle bigint, short boolean, off int, around string, places binary")


_SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("spans", pa.list_(pa.int64()))])


def _spans(table: pa.Table) -> pa.Table:
    """Starts and ends of the runs of hit words of a text, alternating, from its windows (n words, lead words before each place)."""
    starts, ends = [], []
    for n, lead, places in zip(*(table.column(c).to_pylist() for c in ("n", "lead", "places")), strict=True):
        at = unpack(places).astype(np.int64) - lead
        starts.append(at)
        ends.append(at + n)
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    spans = np.stack((a[new], b[np.append(new[1:], len(a)) - 1]), axis=1).ravel()
    return pa.Table.from_arrays([table.column("k1")[:1], table.column("k2")[:1], pa.array([spans.tolist()], pa.list_(pa.int64()))], schema=_SPANS)


def joined(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """large joined with small: broadcast if small's bytes allow, else with the rows of one key of large dealt to SALTS parts by spread."""
    bytes_each = 40 + sum(F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in small.dtypes if not t.startswith("array"))
    bytes_each = sum((F.coalesce(F.size(c), F.lit(0)) * 24 for c, t in small.dtypes if t.startswith("array")), bytes_each)
    if (small.agg(F.sum(bytes_each)).first()[0] or 0) <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), keys, how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def text_keys(text: str) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _search(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, k1, k2, n_words of every document; k1, k2, spans, items of every text with hits (None: no windows)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys("text"), F.col("text").cast("binary").alias("text"))
    every = common.written(windows(benchmark, window), "decontaminate-windows")
    wins = common.written(every.drop("item").dropDuplicates(["win"]), "decontaminate-distinct")
    sizes = sorted(r[0] for r in wins.select("k").distinct().collect())  # at most SHINGLE_WORDS
    if not sizes:
        return common.map_arrow(docs, _counted, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint"), None
    frequency = document_frequency(docs.select("text"), Filter(wins.select(F.explode("shingles").alias("h")).distinct()), sizes)
    prefix = common.written(prefixes(wins, frequency), "decontaminate-prefixes")
    long, short = (Filter(prefix.where(c).select("shingle").distinct()) for c in ("n > k", "n = k"))
    probed = common.written(probe(docs, long, short, sizes, window), "decontaminate-probed")

    met = joined(probed.where("shingle is not null"), prefix, ["shingle"], F.xxhash64("k1", "around"))
    begin = F.col("off") - F.col("place")
    met = met.where(F.col("short") == (F.col("n") == F.col("k"))).withColumn("begin", begin).withColumn("w", F.split("around", " ")).where("begin >= 0 and begin + n <= size(w)")
    hits = met.where(F.array_join(F.slice("w", F.col("begin") + 1, F.col("n")), " ") == F.col("win")).select("k1", "k2", "win", "n", F.col("place").alias("lead"), "places")
    hits = common.written(hits.distinct(), "decontaminate-hits")
    runs = hits.select("k1", "k2", "n", "lead", "places").groupBy("k1", "k2").applyInArrow(_spans, "k1 bigint, k2 bigint, spans array<bigint>")
    holders = every.where("item is not null").select("win", "item").distinct()
    items = joined(hits.select("k1", "k2", "win").distinct(), holders, ["win"], F.xxhash64("k1")).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = runs.join(items, ["k1", "k2"], "left").select("k1", "k2", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return probed.where("shingle is null").select("doc_id", "k1", "k2", "n_words"), common.written(found, "decontaminate-found")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        n = [len(words_of(t)) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "k1", "k2", "n_words"])


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, spans array<bigint> (starts and ends of hit runs of words, alternating), items array<string> (ascending) for every row of docs.

    Null and empty texts have no words and no hits; items without text or words never occur; windows of items without item_id hit words but name no item; a
    repeated row of docs gives a row each; equal item_ids are one item."""
    base, found = _search(docs, benchmark, window)
    none = F.array()
    if found is None:
        return base.select("doc_id", "n_words", none.cast("array<bigint>").alias("spans"), none.cast("array<string>").alias("items"))
    out = joined(base, found, ["k1", "k2"], F.xxhash64("doc_id"), "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", none.cast("array<bigint>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def judged(found: DataFrame, share: int = HIT_SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from search()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: x - acc)  # ends minus starts: alternating sum
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = HIT_SHARE, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated; all columns stay, whatever their names."""
    base, found = _search(docs, benchmark, window)
    if found is None:
        return docs
    sizes = base.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    dirty = judged(found.join(sizes, ["k1", "k2"]).withColumn("doc_id", F.struct("k1", "k2")), share).where("contaminated").select("doc_id.k1", "doc_id.k2")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_keys("text"))
    kept = joined(rows, common.written(dirty.distinct(), "decontaminate-dirty"), ["k1", "k2"], F.xxhash64("row.doc_id"), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
