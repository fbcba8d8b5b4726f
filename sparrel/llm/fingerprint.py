"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame and SQL functions only.

A paragraph is a line, cut after every end of a sentence, in any script (so cuts depend on the characters around them alone, and long lines give several
paragraphs); empty ones don't count.  Its digest is a 64-bit hash; a text is the set of its digests.

A sketch has three parts of T cells each, T a power of two that is at least eight times the number of digests (and at least LEAST_CELLS).  A digest goes to one
cell of each part; a cell holds a count, the XOR of its digests and the XOR of their checks, and only cells that aren't empty are kept, in order of place.
A place modulo a smaller power of two is the place in a smaller sketch, so sketches fold, and two of different sizes meet at the smaller size.

Subtracting two sketches leaves the digests that differ; peeling takes out cells of a single digest until all are empty, which recovers these digests.  If
cells remain (one set is many times as large as the other, or by chance), both sketches are made anew with RETRY times the cells of the larger; if
cells remain there too, the two digest lists themselves are compared.

Likeness is the Jaccard similarity of the digest sets, from the recovered differences; two texts without paragraphs are alike (1.0).
Descending order of documents: doc_id, null ids last; equal (and null) ids by descending hash of the text, then by text.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_CELLS = 16
RETRY = 4
#: A peeling round takes out all digests that stand alone; sketches that can be peeled need about log(log(size)) rounds.
ROUNDS = 20
#: The end of a sentence inside a line, as a pattern: marks, a quote or bracket that closes, and the spaces behind them; also the marks of scripts that put no space
#: there.  The first class only tells quickly where none of the marks can be.
ENDS = '([.!?\u0589-\uff61](?:(?<=[.!?…؟۔।॥։።])[")”’»]?(?= )|(?<=[。！？｡．])[。！？｡．]*[”’」』）]?)) *'
#: Above so many cells left, peeling adds up all cells anew instead of those that aren't emptied; only the speed depends on it.
FEW_CELLS = 256
#: Text bytes of a range of neighbouring documents; ranges at most, and bounds between them at most (a bound's range is cut evenly by id beyond that).
RANGE_BYTES, MAX_RANGES, MAX_BOUNDS = 8 << 20, 1 << 17, 1 << 13


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def keys(text: str) -> str:
    """SQL for the distinct paragraph digests of a text."""
    return f"array_distinct(transform(filter(split(regexp_replace({text}, r'{ENDS}', '$1\n'), '\n'), p -> p <> ''), p -> xxhash64(p)))"


def cells_of(count: str) -> str:
    """SQL for T, the cells of each part of a sketch of so many digests."""
    return f"if({count} = 0, {LEAST_CELLS}, shiftleft(1, greatest({LEAST_CELLS.bit_length() - 1}, length(bin(8 * {count} - 1)))))"


def _entries(digests: str, cells: str, sign: int) -> str:
    """SQL for what digests add to a sketch (sign 1) or take from it (-1)."""
    part = lambda j: f"named_struct('p', {j} * {cells} + cast(xxhash64(dg, {j}L) & ({cells} - 1) as int), 'n', {sign}, 'k', dg, 'h', hash(dg))"
    return f"flatten(transform({digests}, dg -> array({part(0)}, {part(1)}, {part(2)})))"


def _merged(entries: str) -> str:
    """SQL for cells from entries: those of one place are added up; empty cells go.  Linear in the entries, but for the sort."""
    add = "named_struct('p', a.p, 'n', a.n + so[i - 1].n, 'k', a.k ^ so[i - 1].k, 'h', a.h ^ so[i - 1].h)"
    end = "coalesce(get(fi, j + 1), size(so) + 1)"
    cell = f"if({end} = b + 1, so[b - 1], aggregate(sequence(b + 1, {end} - 1), so[b - 1], (a, i) -> {add}))"
    cells = f"filter(transform(fi, (b, j) -> {cell}), c -> c.n <> 0 OR c.k <> 0L OR c.h <> 0)"
    firsts = "filter(sequence(1, size(so)), i -> i = 1 OR so[i - 1].p <> so[i - 2].p)"
    return _let(f"sort_array({entries})", "so", f"if(size(so) = 0, so, {_let(firsts, 'fi', cells)})")


def sketch(digests: str, cells: str | None = None) -> str:
    """SQL for the sketch of an array of distinct digests: z digests, t cells a part (unless given, by their number), c cells that aren't empty."""
    return _let(cells or cells_of(f"size({digests})"), "ce", f"named_struct('z', size({digests}), 't', ce, 'c', {_merged(_entries(digests, 'ce', 1))})")


def _folded(s: str, cells: str, sign: int) -> str:
    """SQL for a sketch's cells, signed and not yet added up, in a sketch of as many cells or fewer."""
    n = "c.n" if sign > 0 else "-c.n"
    same = f"{s}.c" if sign > 0 else f"transform({s}.c, c -> named_struct('p', c.p, 'n', {n}, 'k', c.k, 'h', c.h))"
    return f"if({s}.t = {cells}, {same}, transform({s}.c, c -> named_struct('p', cast(c.p div {s}.t as int) * {cells} + (c.p & ({cells} - 1)), 'n', {n}, 'k', c.k, 'h', c.h)))"


def peeled(one: str, other: str, cells: str) -> str:
    """SQL for the digests that only one or the other sketch holds (fields one, other), found by subtracting and peeling both at a size; null if cells remain."""
    state = "named_struct('c', {c}, 'one', {one}, 'other', {other}, 'go', {go})"
    none = "cast(array() as array<bigint>)"
    alone = lambda n: f"array_distinct(transform(filter(pu, c -> c.n = {n}), c -> c.k))"
    taken = f"concat({_entries('pos', 'ce', -1)}, {_entries('neg', 'ce', 1)})"
    # A cell of one digest is emptied; other cells change only where a taken digest lies.
    few = _let("transform(re, c -> c.p)", "pl", _merged(f"concat(re, filter({taken}, e -> array_contains(pl, e.p)))"))
    left = f"if(size(re) = 0, re, if(size(re) <= {FEW_CELLS}, {few}, {_merged(f'concat(st.c, {taken})')}))"
    rest = _let("filter(st.c, c -> NOT ((c.n = 1 OR c.n = -1) AND c.h = hash(c.k)))", "re", state.format(c=left, one="concat(st.one, pos)", other="concat(st.other, neg)", go="true"))
    taken = _let(alone(1), "pos", _let(alone(-1), "neg", rest))
    stuck = state.format(c="st.c", one="st.one", other="st.other", go="false")
    step = f"if(st.go AND size(st.c) > 0, {_let('filter(st.c, c -> (c.n = 1 OR c.n = -1) AND c.h = hash(c.k))', 'pu', f'if(size(pu) = 0, {stuck}, {taken})')}, st)"
    start = state.format(c=_merged(f"concat({_folded(one, 'ce', 1)}, {_folded(other, 'ce', -1)})"), one=none, other=none, go="true")
    end = "if(size(st.c) = 0, named_struct('one', st.one, 'other', st.other), null)"
    return _let(cells, "ce", f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> {step}, st -> {end})")


def difference(one: str, other: str) -> str:
    """SQL for the digests that two sketches differ in (fields one, other), peeled at the smaller size; null if cells remain."""
    least = f"least({one}.t, {other}.t)"
    # More digests than a sketch of that size can give back aren't tried.
    return f"if(abs({one}.z - {other}.z) > 3 * {least}, null, {peeled(one, other, least)})"


def likeness_of(one: str, other: str) -> str:
    """SQL for the likeness of two sketches; null if cells remain."""
    return f"if({one}.c = {other}.c, 1.0D, {_jaccard(difference(one, other), f'{one}.z + {other}.z')})"


def _jaccard(differing: str, total: str) -> str:
    return _let(_let(differing, "di", "size(di.one) + size(di.other)"), "df", f"if(df < 0, null, cast({total} - df as double) / ({total} + df))")


def likeness(one: str, other: str, a: str, b: str) -> str:
    """SQL for the likeness of two sketches; where cells remain, of larger ones made from the digest lists a and b, and where they remain there too, of these lists."""
    larger = _let(sketch(a, f"{RETRY} * greatest({one}.t, {other}.t)"), "la", _let(sketch(b, f"{RETRY} * greatest({one}.t, {other}.t)"), "lb", peeled("la", "lb", "la.t")))
    exact = f"cast(size(array_intersect({a}, {b})) as double) / size(array_union({a}, {b}))"
    return f"coalesce({likeness_of(one, other)}, {_jaccard(larger, f'{one}.z + {other}.z')}, {exact})"


def text_of(s: str) -> str:
    """SQL for a sketch as text: the number of digests, then the cells as place.count.digests.checks, apart by spaces."""
    return f"array_join(concat(array(cast({s}.z as string)), transform({s}.c, c -> concat_ws('.', c.p, c.n, c.k, c.h))), ' ')"


def sketch_of(text: str) -> str:
    """SQL for the sketch that text_of() made a text of."""
    cell = "transform(array(split(w, '[.]')), f -> named_struct('p', cast(f[0] as int), 'n', cast(f[1] as int), 'k', cast(f[2] as bigint), 'h', cast(f[3] as int)))[0]"
    count = f"cast(split({text}, ' ')[0] as int)"
    return f"named_struct('z', {count}, 't', {cells_of(count)}, 'c', transform(filter(split({text}, ' '), w -> w LIKE '%.%'), w -> {cell}))"


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES, keyed: bool = False) -> DataFrame:
    """doc_id, t (text, not null), next_t (the text of the next document in descending order; after the last, of the first) for every row of docs; keyed: also
    the paragraph digests of t and next_t (own_keys, next_keys) and their sketches (own, next), made once.

    Texts are dealt once, to ranges of neighbouring documents between quantiles of doc_id; rows of one id that fills several ranges, and null ids, are dealt by
    hash of the text.  Each range also gets the first document of the following one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).withColumn("hash", F.xxhash64("t"))
    total, nulls = docs.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("doc_id").isNull().cast("long")), F.lit(0))).first()
    ranges = max(1, min(MAX_RANGES, -(-total // range_bytes)))
    n = min(ranges, MAX_BOUNDS)
    bounds = []
    if n > 1:
        shares = F.array(*[F.lit(k / n) for k in range(1, n)])
        bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] or []
    docs = docs.withColumn("range", _range(F.col("doc_id"), F.col("hash"), [int(b) for b in bounds], -(-ranges // n), ranges))

    # The first document of each range in descending order goes to the range before it as well, the very first to the last range.
    firsts = docs.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("first"))
    order = Window.orderBy(F.desc("range"))  # one row per range, MAX_RANGES and as many of null ids at most
    last = firsts.agg(F.min("range")).first()[0]
    firsts = common.written(firsts.select("range", "first", F.coalesce(F.lag("range").over(order), F.lit(last)).alias("to")), "fingerprint-firsts")
    guests = docs.join(F.broadcast(firsts), "range").where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")))
    dealt = docs.select("range", "doc_id", "hash", "t", F.lit(False).alias("guest")).unionByName(guests.select(F.col("to").alias("range"), "doc_id", "hash", "t", F.lit(True).alias("guest")))
    if keyed:  # behind the shuffle, before the window
        dealt = dealt.repartition("range").withColumn("own_keys", F.expr(keys("t"))).withColumn("own", F.expr(sketch("own_keys")))
    inside = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("hash"), "t")
    following = [F.lead("t").over(inside).alias("next_t"), *([F.lead("own_keys").over(inside).alias("next_keys"), F.lead("own").over(inside).alias("next")] if keyed else [])]
    return dealt.select("*", *following).where("not guest").select("doc_id", "t", "next_t", *(["own_keys", "next_keys", "own", "next"] if keyed else []))


def _range(doc_id: Column, hashed: Column, bounds: list[int], fine: int, ranges: int) -> Column:
    """Number of the range of a row, ascending with (doc_id, hash); null ids have negative numbers.

    bounds ascend; a value that stands there several times fills several ranges, over which its rows are dealt by hash."""
    share = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(1 << 63))), 33).cast("double") / (1 << 31)  # ascending with the hash
    null_range = -F.lit(ranges).cast("long") + F.floor(share * ranges)
    if not bounds:
        return F.when(doc_id.isNull(), null_range).otherwise(F.lit(0).cast("long"))
    cuts = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    found = lambda inside: F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & inside(F.element_at(cuts, F.least(at + s, F.lit(len(bounds))))), at + s).otherwise(at))

    def number(place: Column) -> Column:
        below, upto = place["below"], place["upto"]
        hot, spread = upto - below > 1, share * (upto - below)
        cell = F.when(hot, below + 1 + F.floor(spread).cast("int")).otherwise(upto).cast("long")
        if fine == 1:
            return cell
        low, high = F.coalesce(F.get(cuts, upto - 1), F.lit(bounds[0] - 1)), F.coalesce(F.get(cuts, upto), F.lit(bounds[-1] + 1))
        inner = F.least(F.greatest(F.floor((doc_id - low).cast("double") * fine / F.greatest(high - low, F.lit(1))), F.lit(0)), F.lit(fine - 1))
        return cell * fine + F.when(hot, F.floor((spread - F.floor(spread)) * fine)).otherwise(inner)

    place = F.struct(found(lambda b: b < doc_id).alias("below"), found(lambda b: b <= doc_id).alias("upto"))
    return F.when(doc_id.isNull(), null_range).otherwise(F.element_at(F.transform(F.array(place), number), 1))


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Both likenesses are likeness_of() the two fingerprints wherever their peeling ends.  Null ids, repeated rows and extra columns as in with_next()."""
    d = with_next(docs, range_bytes, keyed=True).withColumn("n_chars", F.char_length("t").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(t, 1, cast(n_chars - n_chars div 2 as int)), substring(next_t, 1, cast(n_chars div 2 as int)))"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own_keys", F.expr(keys("edited")).alias("edited_keys"), "next_keys", "own", "next")
    d = d.withColumn("edited", F.expr(sketch("edited_keys")))
    near = [F.expr(likeness("own", c, "own_keys", f"{c}_keys")).alias(f"near_{c}") for c in ("edited", "next")]
    return d.select("doc_id", "n_chars", "edited_sha256", F.expr(text_of("own")).alias("fingerprint"), F.expr(text_of("edited")).alias("edited_fingerprint"), *near)
