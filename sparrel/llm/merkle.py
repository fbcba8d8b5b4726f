"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

The monoid is the sparse forest: unresolved nodes by (level, index) of a tree with a known number of leaves.  Two forests merge by uniting their nodes and, level
by level, replacing each complete run of siblings by its parent; a run's arity is known (ARITY, or what is left of the level), so the result doesn't depend on
the order of merging.  Rows are dealt out by range in the tree's order, each range leaves a forest of a few nodes a level, and neighbouring forests are merged
in a tree of rounds (FAN at once).  No task holds more than a range's rows or FAN forests of one group, and the driver holds none."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Siblings of a run, forests merged at once; rows of a range, about: no more than the first, and no fewer than the second to keep every core busy.
ARITY, FAN = 8, 16
RANGE_ROWS, LEAST_ROWS = 100_000, 2_000
Nodes = dict[tuple[int, int], bytes]


def digest_of(*columns: Column) -> Column:
    """Hex SHA-256 of the columns one after the other, each as "-" if null, else its UTF-8 bytes' number, ":" and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def parent(children: list[bytes]) -> bytes:
    """The digest of a run: SHA-256 of its children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def resolved(nodes: Nodes, leaves: int, made: Nodes | None = None) -> Nodes:
    """The forest with every complete run replaced by its parent, up to the root; made gets the parents."""
    level, size, out, now = 0, leaves, {}, {}
    by_level: dict[int, dict[int, bytes]] = {}
    for (at, index), digest in nodes.items():
        by_level.setdefault(at, {})[index] = digest
    while size > 1 and (now or by_level):
        now |= by_level.pop(level, {})
        up = {}
        for run in sorted({index // ARITY for index in now}):
            members = [k for k in range(run * ARITY, min((run + 1) * ARITY, size)) if k in now]
            if len(members) == min(ARITY, size - run * ARITY):
                up[run] = parent([now[k] for k in members])
            else:
                out |= {(level, k): now[k] for k in members}
        level, size, now = level + 1, -(-size // ARITY), up
        if made is not None:
            made |= {(level, k): digest for k, digest in up.items()}
    return out | {(level, k): digest for k, digest in (now | by_level.pop(level, {})).items()}


@dataclass(frozen=True)
class Manifest:
    """rows: the leaves with grp, part, pos (place in the part); spans: grp, part, first, lo, hi (indexes of the part's leaves), leaves (of the whole tree);
    nodes: grp, level, index, digest of every node that a range leaves unresolved or a merge makes; roots: grp, digest."""

    rows: DataFrame
    spans: DataFrame
    nodes: DataFrame
    roots: DataFrame


def build(leaves: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> Manifest:
    """The trees over leaves: grp string (not null), leaf binary, and other columns, among them those of order.

    In each tree leaves go by order (nulls first), then by leaf; rows equal in these are interchangeable and dealt out by their place in the written table, so that
    no number of repeated rows overfills a range.  No leaves give no trees."""
    leaves = common.written(leaves, "merkle-leaves")
    n, spark = leaves.count(), leaves.sparkSession
    ranges = max(1, -(-n // range_rows), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    placed = leaves.withColumn("place", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    by = [F.asc_nulls_first(c) for c in ("grp", *order, "leaf", "place")]
    number = F.monotonically_increasing_id()  # the partition, then the row in it
    dealt = placed.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("place").withColumn("number", number)
    rows = dealt.withColumn("part", F.shiftright("number", 33).cast("int")).withColumn("pos", F.col("number").bitwiseAND((1 << 33) - 1)).drop("number")
    rows = common.written(rows, "merkle-rows")
    counts = rows.groupBy("grp", "part").agg(F.min("pos").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy("grp")  # a row a range, at most
    hi = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    spans = counts.withColumn("hi", hi).withColumn("leaves", F.sum("c").over(whole)).withColumn("lo", F.col("hi") - F.col("c")).drop("c")
    spans = common.written(spans, "merkle-spans")
    start = _beside(rows.select("grp", "part", "pos", "leaf"), spans)
    open_nodes = common.written(common.map_arrow(start, _fragments, _NODE), "merkle-nodes")
    every, width = [open_nodes], (spans.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        blocks = open_nodes.where("open").withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        open_nodes = common.written(blocks.groupBy("grp", "part").applyInArrow(_merge, _NODE), "merkle-nodes")
        every.append(open_nodes)
        width = -(-width // FAN)
    nodes = every[0]
    for more in every[1:]:
        nodes = nodes.unionByName(more.where("made"))
    return Manifest(rows, spans, nodes.select("grp", "level", "index", "digest"), open_nodes.where("open").select("grp", "digest"))


_NODE = "grp string, part int, leaves bigint, level int, index bigint, digest binary, open boolean, made boolean"
_NODE_ARROW = pa.schema([("grp", pa.string()), ("part", pa.int32()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()), ("open", pa.bool_()), ("made", pa.bool_())])


def _node_rows(grp: str, part: int, leaves: int, still: Nodes, made: Nodes) -> list[dict]:
    every = made | still
    return [{"grp": grp, "part": part, "leaves": leaves, "level": k[0], "index": k[1], "digest": d, "open": k in still, "made": k in made} for k, d in every.items()]


def _merge(table: pa.Table) -> pa.Table:
    """The forests of some neighbouring ranges of one tree as one."""
    rows, made = table.to_pylist(), {}
    still = resolved({(r["level"], r["index"]): r["digest"] for r in rows}, rows[0]["leaves"], made)
    return pa.Table.from_pylist(_node_rows(rows[0]["grp"], rows[0]["part"], rows[0]["leaves"], still, made), schema=_NODE_ARROW)


def _beside(rows: DataFrame, *about: DataFrame) -> DataFrame:
    """Rows and what is known about their range, together in one partition: what is known first, then the rows in order."""
    out = rows.withColumn("tag", F.lit(1))
    for more in about:
        out = out.unionByName(more.withColumn("tag", F.lit(0)), allowMissingColumns=True)
    return out.repartition("grp", "part").sortWithinPartitions("grp", "part", "tag", "pos")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[pa.RecordBatch]]]:
    """What is known, and the rows, of one range after the other."""
    now, known, rows = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "part", "tag")), strict=True))
        for (grp, part, tag), run in groupby(range(batch.num_rows), keys.__getitem__):
            run = list(run)
            piece = batch.slice(run[0], len(run))
            if (grp, part) != now and now is not None:
                yield known, rows
                known, rows = [], []
            now = grp, part
            if tag:
                rows.append(piece)
            else:
                known += piece.to_pylist()
    if now is not None:
        yield known, rows


def _leaves(span: dict, rows: list[pa.RecordBatch]) -> Nodes:
    """The leaves of a range by (0, index)."""
    out = {}
    for batch in rows:
        column = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pos", "leaf")}
        out |= {(0, span["lo"] + pos - span["first"]): leaf for pos, leaf in zip(column["pos"], column["leaf"], strict=True)}
    return out


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of each range."""
    for known, rows in _ranges(batches):
        span = known[0]
        still = resolved(_leaves(span, rows), span["leaves"])
        yield pa.RecordBatch.from_pylist(_node_rows(span["grp"], span["part"], span["leaves"], still, {}), schema=_NODE_ARROW)


def proofs(manifest: Manifest, above: DataFrame | None = None) -> DataFrame:
    """The rows of a manifest (without part and pos) with path: position int, siblings string (hex digests, left to right) of each level, from the leaf up.

    above (grp, path) is put after each row's own path, such as that of its tree's root in a tree over the roots.  A range gets the nodes beside it that it can't
    make itself: at each level those of its first and its last run."""
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log(float(ARITY), F.col("leaves").cast("double"))).cast("int")))
    wide = lambda k: F.pow(F.lit(float(ARITY)), k + 1).cast("long")
    spans = manifest.spans.select("grp", "part", "lo", "hi", F.explode(levels).alias("level"))
    runs = F.explode(F.array_distinct(F.array(F.floor(F.col("lo") / wide(F.col("level"))), F.floor((F.col("hi") - 1) / wide(F.col("level"))))))
    wanted = spans.select("grp", "part", "level", runs.alias("run"))
    held = manifest.nodes.withColumn("run", F.floor(F.col("index") / ARITY)).distinct()
    beside = wanted.join(held, ["grp", "level", "run"]).select("grp", "part", "level", "index", "digest")
    known = manifest.spans
    if above is not None:
        known = known.join(above.select("grp", F.col("path").alias("above")), "grp", "left")
    schema = manifest.rows.drop("part", "pos").schema
    rows = _beside(manifest.rows, known, beside)
    kept = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for about, leaves in _ranges(batches):
            span = next(r for r in about if r["lo"] is not None)
            mine = _leaves(span, leaves)
            nodes = mine | {(r["level"], r["index"]): r["digest"] for r in about if r["level"] is not None}
            resolved(mine, span["leaves"], nodes)
            path = _paths(nodes, span["leaves"], [(p["position"], p["siblings"]) for p in span.get("above") or []])
            for batch in leaves:
                for piece in common.slices([batch], 1024):
                    at = [span["lo"] + p - span["first"] for p in piece.column(piece.schema.get_field_index("pos")).to_pylist()]
                    column = pa.array([[{"position": k, "siblings": s} for k, s in path(i)] for i in at], _PATH_ARROW)
                    yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in kept), column], names=[*kept, "path"])

    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return common.map_arrow(rows, run, f"{text}, path array<struct<position: int, siblings: string>>")


_PATH_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("siblings", pa.string())]))


def _paths(nodes: Nodes, leaves: int, above: list[tuple[int, str]]):
    """A function from a leaf's index to its path; the part above the last run asked for is kept for each level."""
    last: dict[int, tuple[int, list]] = {}

    def path(index: int, level: int = 0, size: int = leaves) -> list[tuple[int, str]]:
        if size == 1:
            return above
        run = index // ARITY
        if last.get(level, (None,))[0] != run:
            last[level] = (run, path(run, level + 1, -(-size // ARITY)))
        siblings = "".join(nodes[level, k].hex() for k in range(run * ARITY, min((run + 1) * ARITY, size)) if k != index)
        return [(index % ARITY, siblings), *last[level][1]]

    return path


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and its path give."""
    at = lambda p: 64 * p.position
    step = lambda node, p: F.sha2(F.concat(F.substr(p.siblings, F.lit(1), at(p)), node, F.substr(p.siblings, at(p) + 1)).cast("binary"), 256)
    return F.aggregate(path, leaf, step)


def documents_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """lang, doc_id, leaf, tampered (null unless 3 divides crc32(doc_id)) of each row of docs; the leaves of lang's tree, in order of doc_id.

    Any column may be null; a null doc_id comes first in its tree and is never tampered with; rows may repeat; other columns are left out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate("text", upper, upper.lower())
    fields = [F.col(c) for c in columns]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(changed, digest_of(*[lower if c == "text" else F.col(c) for c in columns]))
    return docs.select(
        # Nulls as the smallest group: bytewise order stays that of lang.
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), "lang", "doc_id", F.unhex(digest_of(*fields)).alias("leaf"), F.unhex(other).alias("tampered"),
    )


def proven(leaves: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """leaves (see build()) with hex leaf, subroot (of its tree), root (of the tree over all subroots, by grp), and path from the leaf to root."""
    trees = build(leaves, order, range_rows)
    top = build(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("tree"), F.col("digest").alias("leaf")), ["tree"], range_rows)
    crown = F.lower(F.hex(F.col("digest"))).alias("root")
    roots = proofs(top).join(top.roots.select("grp", crown), "grp").select(F.col("tree").alias("grp"), F.lower(F.hex("leaf")).alias("subroot"), "root", "path")
    roots = common.written(roots, "merkle-roots")
    out = proofs(trees, roots)
    return out.withColumn("leaf", F.lower(F.hex("leaf"))).join(roots.select("grp", "subroot", "root"), "grp")


def audited(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs; see documents_manifest().  No rows give none."""
    rows = proven(documents_manifest(docs), ["doc_id"], range_rows)
    siblings = F.array_join(F.transform("path", lambda p: p.siblings), "")
    shown = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(shown, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
