"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its five-word shingles (all its words if it has fewer); words are runs of anything but ASCII white space.  Documents with equal sets
are one node.  Two nodes are linked if the Jaccard similarity of their sets is at least 0.8; a class is a connected component of links.

1. MinHash values of each distinct set.  Bands of three values name buckets; a pair at 0.8 misses all buckets with probability (1 - 0.8^3)^30 < 1e-9.
2. In a bucket, MinHash values (a byte each) are compared eight at a time.  A pair is dropped as soon as the posterior probability, over a uniform prior,
   that its similarity reaches the threshold falls below the tolerance.  What survives joins a bucket's nodes to candidate components; a bucket
   gives one edge a node at most, never its pairs.  A bucket beyond BUCKET_NODES is dealt out as pairs of parts, so that every two of its nodes still meet.
3. Candidate components are verified exactly: intersection sizes of all pairs inside, counted by matrix products over shingles.  A component beyond
   PART_NODES nodes, or beyond GROUP_BYTES of text, is dealt out as pairs of parts.  Each task returns sums of link weights and one edge a node, never pairs.

Documents without words are classes of their own with no links, however often they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .substring_dedup import Rolling, word_hashes

SHINGLE_WORDS = 5
#: Similarity as a ratio of whole numbers.
THRESHOLD = (4, 5)
BANDS, BAND_ROWS = 30, 3
#: MinHash bytes compared in a bucket, and how many at a time.
COMPARED, STEP = 32, 8
#: A pair is dropped when its posterior probability of reaching the threshold falls below this.
TOLERANCE = 1e-7
PART_NODES = 1024
#: Nodes of a bucket that are compared in one task.
BUCKET_NODES = 2048
#: Text bytes of a group of small components, and of a part of a large one.
GROUP_BYTES = 8 << 20
_HASHES = BANDS * BAND_ROWS
_rolling = Rolling(0x9FB21C651E98DF25)
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def shingles(text: str | bytes | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles."""
    words = (text.encode() if isinstance(text, str) else text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    return np.unique(_rolling(word_hashes(words), SHINGLE_WORDS))


def minhashes(values: np.ndarray) -> np.ndarray:
    """Least of each of the 90 multiply-add hashes, its upper 32 bits."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        for k in range(0, _HASHES, 15):  # blocks that stay in cache
            x = part[None, :] * _MULTIPLY[k : k + 15, None]
            x += _ADD[k : k + 15, None]
            np.minimum(least[k : k + 15], x.min(axis=1), out=least[k : k + 15])
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=8)
def least_matches(compared: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """The fewest equal bytes among so many compared with which a pair isn't dropped."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    for m in range(compared + 1):
        logs = m * np.log(p) + (compared - m) * np.log1p(-p)
        w = np.exp(logs - logs.max())
        if w[s >= threshold].sum() / w.sum() >= tolerance:
            return m
    return compared


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the rows of others (nodes x COMPARED bytes) that are not dropped against one row."""
    left, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for at in range(0, COMPARED, STEP):
        equal = equal + (others[left, at : at + STEP] == one[at : at + STEP]).sum(axis=1)
        keep = equal >= least_matches(at + STEP)
        left, equal = left[keep], equal[keep]
        if not len(left):
            break
    return left


def bucket_edges(nodes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its component) over surviving pairs of a bucket; found breadth first against the nodes not yet reached."""
    unseen, edges = np.arange(len(nodes)), []
    while len(unseen):
        component, queue, unseen = [unseen[0]], [unseen[0]], unseen[1:]
        while queue and len(unseen):
            near = survivors(sketches[queue.pop()], sketches[unseen])
            if len(near):
                found = unseen[near]
                component.extend(found)
                queue.extend(found)
                unseen = np.delete(unseen, near)
        if len(component) > 1:
            own = nodes[component]
            root = own.min()
            edges += [(int(n), int(root)) for n in own if n != root]
    return edges


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, bytes (of text), set_key (digest of the shingle set; null without words), sketch (MinHash values) for every row."""

    def rows(batch: pa.RecordBatch) -> list:
        keys, sketches, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            sizes.append(len(text or b""))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketches.append(minhashes(s).tobytes() if len(s) else None)
        return [batch.column(0), batch.column(2), sizes, keys, sketches]

    return common.mapped(_plain(docs), rows, "doc_id bigint, text_hash bigint, bytes bigint, set_key binary, sketch binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))


_BAND_SCHEMA = "bucket bigint, node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
#: Edges (a, b); or, with a bucket, nodes a of one that is too large, by parts.
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("part", pa.int64()), *((f"s{k}", pa.int64()) for k in range(4))])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 4096):
        n = batch.num_rows
        if not n:
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, _HASHES)
        wide = values.astype(np.uint64).reshape(n, BANDS, BAND_ROWS)
        key = np.full((n, BANDS), 0x2545F4914F6CDD1D, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(BAND_ROWS):
            key = (key ^ wide[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        compared = np.ascontiguousarray(values[:, :: _HASHES // COMPARED][:, :COMPARED].astype(np.uint8)).view("<i8")
        columns = [key.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), BANDS), *(np.repeat(compared[:, k], BANDS) for k in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "node", "s0", "s1", "s2", "s3"])


def _bucket_stream(batches: Iterator[pa.RecordBatch], bucket_nodes: int = BUCKET_NODES) -> Iterator[pa.RecordBatch]:
    """Edges of rows that come sorted by bucket; an unfinished bucket waits for the next batch.  Nodes of a bucket beyond bucket_nodes are handed on, by parts."""
    rest, over, dealt = np.zeros((6, 0), np.int64), None, 0

    def handed_on(t: np.ndarray, first: int) -> pa.RecordBatch:
        part = (first + np.arange(t.shape[1])) // bucket_nodes
        return pa.RecordBatch.from_arrays([pa.array(t[1]), pa.nulls(t.shape[1], pa.int64()), pa.array(t[0]), pa.array(part), *(pa.array(t[2 + k]) for k in range(4))], schema=_FOUND)

    def finished(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], t[0, 1:] != t[0, :-1]))) if t.shape[1] else np.zeros(0, int)
        size = np.diff(np.append(first, t.shape[1]))
        found: set[tuple[int, int]] = set()
        sketches = np.ascontiguousarray(t[2:].T).view(np.uint8).reshape(-1, COMPARED)
        two = first[size == 2]  # most buckets
        if len(two):
            same = sketches[two] == sketches[two + 1]
            ok = np.ones(len(two), bool)
            for at in range(STEP, COMPARED + 1, STEP):
                ok &= same[:, :at].sum(axis=1) >= least_matches(at)
            a, b = t[1, two[ok]], t[1, two[ok] + 1]
            found.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > bucket_nodes:
                yield handed_on(t[:, i : i + n], 0)
            else:
                found.update(bucket_edges(t[1, i : i + n], sketches[i : i + n]))
        yield _edge_rows(found)

    for batch in batches:
        t = np.stack([c.to_numpy() for c in batch.columns])
        if over is not None:  # more of the bucket that is handed on
            n = int(np.searchsorted(t[0], over, side="right"))
            if n:
                yield handed_on(t[:, :n], dealt)
                dealt += n
            t = t[:, n:]
        if t.shape[1]:
            over, t = None, np.concatenate((rest, t), axis=1)
            cut = int(np.searchsorted(t[0], t[0, -1]))
            if cut:
                yield from finished(t[:, :cut])
            rest = t[:, cut:]
            if rest.shape[1] > bucket_nodes:
                yield handed_on(rest, 0)
                over, dealt, rest = int(rest[0, 0]), rest.shape[1], rest[:, :0]
    yield from finished(rest)


def _edge_rows(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([e[k] for e in found] for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), pa.int64()) for _ in range(6))], schema=_FOUND)


def _compared(table: pa.Table) -> pa.Table:
    """Edges of a pair of a bucket's parts."""
    sketches = np.ascontiguousarray(np.stack([table.column(f"s{k}").to_numpy() for k in range(4)]).T).view(np.uint8).reshape(-1, COMPARED)
    found = bucket_edges(table.column("node").to_numpy(), sketches)
    return pa.Table.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _candidate_edges(nodes: DataFrame, bucket_nodes: int) -> DataFrame:
    """a, b: edges that join the nodes (node, sketch) of surviving pairs."""
    dealt = max(1, -(-nodes.count() * BANDS // 400_000))
    bands = common.map_arrow(nodes.select("node", "sketch"), _bands, _BAND_SCHEMA).repartition(dealt, "bucket").sortWithinPartitions("bucket")
    schema = "a bigint, b bigint, bucket bigint, part bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    found = common.written(common.map_arrow(bands, lambda batches: _bucket_stream(batches, bucket_nodes), schema), "jaccard-buckets")
    large, edges = found.where("bucket is not null").withColumnRenamed("a", "node"), found.where("bucket is null").select("a", "b")
    if not large.limit(1).count():
        return edges
    parts = common.written(large.groupBy("bucket").agg(F.max("part").alias("last")), "jaccard-large")
    met = large.drop("b").join(parts, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = met.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "s0", "s1", "s2", "s3")
    return edges.unionByName(pairs.groupBy("bucket", "i", "j").applyInArrow(_compared, "a bigint, b bigint"))


def _linked(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """Which pairs of sets are linked; with split, only those of one set before it and one after it."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[at] > 1
    rows, at = rows[shared], at[shared]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], np.unique(at[order], return_inverse=True)[1]
    n = int(at[-1]) + 1 if len(at) else 0
    left, right = (slice(None), slice(None)) if split is None else (slice(0, split), slice(split, None))
    inter = np.zeros((len(sizes[left]), len(sizes[right])), np.float32)
    width = max(256, (16 << 20) // (4 * len(sets)))
    for start in range(0, n, width):
        a, b = np.searchsorted(at, (start, start + width))
        block = np.zeros((len(sets), min(width, n - start)), np.float32)
        block[rows[a:b], at[a:b] - start] = 1
        inter += block[left] @ block[right].T
    inter = inter.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    linked = THRESHOLD[1] * inter >= THRESHOLD[0] * union
    if split is None:
        np.fill_diagonal(linked, False)
        return linked
    whole = np.zeros((len(sets), len(sets)), bool)
    whole[:split, split:] = linked
    whole[split:, :split] = linked.T
    return whole


def _verified(nodes: list[int], weights: list[int], sets: list[np.ndarray], parts: list[int]) -> list[tuple[int, int, int]]:
    """(node, weight of its linked nodes, smallest node that links reach from it here) of each node with a link."""
    order = sorted(range(len(nodes)), key=lambda k: (parts[k], nodes[k]))
    nodes, weights, sets, parts = ([x[k] for k in order] for x in (nodes, weights, sets, parts))
    split = next((k for k, p in enumerate(parts) if p != parts[0]), None)
    if len(sets) == 2:
        inter = len(np.intersect1d(*sets, assume_unique=True))
        linked = np.full((2, 2), THRESHOLD[1] * inter >= THRESHOLD[0] * (len(sets[0]) + len(sets[1]) - inter))
        np.fill_diagonal(linked, False)
    else:
        linked = _linked(sets, split)
    total, n = linked @ np.array(weights, np.int64), np.array(nodes)
    root = n.copy()
    while True:  # smallest node over links, until it stays
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    return [(int(a), int(t), int(r)) for a, t, r, any_ in zip(n, total, root, linked.any(axis=1), strict=True) if any_]


def _verify(table: pa.Table) -> pa.Table:
    """Components of a group; columns comp, i, j, node, weight, part, text.  A group holds whole small components, or one pair of parts."""
    by: dict[int, list[tuple]] = {}
    if table.num_rows and table.column("i")[0] != table.column("j")[0] and len(table.column("part").unique()) == 1:
        table = table.slice(0, 0)  # the other part is empty, and this one's own pairs are counted alone
    for comp, node, weight, part, text in zip(*(table.column(c).to_pylist() for c in ("comp", "node", "weight", "part", "text")), strict=True):
        by.setdefault(comp, []).append((node, weight, shingles(text), part))
    out = [r for members in by.values() if len(members) > 1 for r in _verified(*(list(x) for x in zip(*[(m[0], m[1], m[2], m[3]) for m in members], strict=True)))]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["node", "links", "root"])


def join(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links (other documents with similarity of at least 0.8) for every row of docs.

    Null doc_ids take part; a class with no doc_id has a null class_id.  Repeated rows are documents of their own, linked to each other.  Null and
    empty texts, and texts of white space, have no words: their class is their own doc_id and they have no links."""
    out = _classes(docs, **sizes)
    return out.select("doc_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(docs: DataFrame, group_bytes: int = GROUP_BYTES, part_nodes: int = PART_NODES, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """doc_id, text_hash, set_key (null without words), first (unnamed, doc_id, text_hash of the class's first row: smallest doc_id, null last), n_links."""
    signed = common.written(_signed(docs), "jaccard-signed")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = signed.where("set_key is not null").groupBy("set_key").agg(F.min(row).alias("row"), F.count("*").alias("weight"), F.max("bytes").alias("bytes"), F.any_value("sketch").alias("sketch"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    candidates = connected_components(_candidate_edges(nodes, bucket_nodes))

    members = candidates.join(nodes.select("node", "weight", "bytes", F.col("row.text_hash").alias("text_hash"), F.col("row.doc_id").alias("doc_id")), "node")
    n_parts = F.greatest(F.ceil(F.count("*") / part_nodes), F.ceil(F.sum("bytes") / group_bytes), F.lit(1)).cast("int")
    sizes = common.written(members.groupBy("comp").agg(F.least(n_parts, F.count("*").cast("int")).alias("n_parts")), "jaccard-sizes")  # written, so that Spark can split a large component's join
    texts = _texts(docs, members.join(sizes, "comp"))
    total = max(1, common.total_bytes(texts, "text"))
    groups = max(1, -(-total // group_bytes))

    whole = texts.where("n_parts = 1").select(F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("grp"), F.lit(0).alias("i"), F.lit(0).alias("j"), "comp", "node", "weight", F.lit(0).alias("part"), "text")
    cut = texts.where("n_parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_parts").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    cut = cut.select((-1 - F.col("comp")).alias("grp"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "comp", "node", "weight", "part", "text")
    found = common.written(whole.unionByName(cut).groupBy("grp", "i", "j").applyInArrow(_verify, "node bigint, links bigint, root bigint"), "jaccard-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    labelled = nodes.select("node", "set_key", "row", "weight").join(links, "node", "left").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = common.written(labelled, "jaccard-labelled")
    least = common.written(labelled.groupBy("comp").agg(F.min("row").alias("first")), "jaccard-classes")
    named = labelled.join(least, "comp").select("set_key", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return signed.join(named, "set_key", "left").select("doc_id", "text_hash", "set_key", "first", "n_links")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One text of each member node: that of a row with the node's smallest doc_id, told by its hash from other rows with that id (null ids too)."""
    docs, m = _plain(docs), members.select("comp", "node", "weight", "n_parts", F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    met = docs.join(m, (F.col("text_hash") == F.col("m_hash")) & F.col("doc_id").eqNullSafe(F.col("m_id")))
    return common.written(met.select("comp", "node", "weight", "n_parts", "text").dropDuplicates(["node"]), "jaccard-texts")


def one_of_each(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row of each class of docs, that of its smallest doc_id (of those with it, that of the smallest hash of its text); all columns stay, whatever their names.

    A class without any doc_id keeps the row of the smallest hash.  Rows without words stay.  Of rows equal in doc_id and text one stays."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    stay = _classes(docs, **sizes).where(F.col("set_key").isNull() | first).select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash")).distinct()
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
