"""Scalar functions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relation labels in index order, limits of a changed brightness, means and deviations of the colour channels, severities in order, and their (pHash, dHash) limits.
LABELS = ("MATCH", "MISMATCH", "PARTIAL_MATCH")
BRIGHTNESS = (0.9, 1.1)
CHANNEL_MEANS, CHANNEL_DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SEVERITIES = (("very_strict", 4, 6), ("strict", 6, 8), ("screen", 8, 10))


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def ratio(x: Column, y: Column) -> Column:
    """x / y, 0 where y is 0."""
    return F.coalesce(x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)), F.lit(0.0))


def strict_bool(c: Column) -> Column:
    """true/false in any case and with spaces around; anything else, null too, is an error."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s == "true", True).when(s == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def relation_label(image_category: Column, text_category: Column, image_family: Column, text_family: Column) -> Column:
    """MATCH: one category; PARTIAL_MATCH: one family; MISMATCH: else.  A null family is an unknown category, which is an error."""
    unknown = image_family.isNull() | text_family.isNull()
    error = F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(image_category, F.lit("null")), F.lit(" or "), F.coalesce(text_category, F.lit("null"))))
    return F.when(unknown, error.cast("string")).when(image_category == text_category, "MATCH").when(image_family == text_family, "PARTIAL_MATCH").otherwise("MISMATCH")


def encode(c: Column, values: list[str] | tuple[str, ...]) -> Column:
    """Index of a value in a short list; a value outside it is an error, null stays null."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1
    return F.when(c.isNull(), F.lit(None).cast("long")).when(at < 0, F.raise_error(F.concat(F.lit("unknown value: "), c)).cast("long")).otherwise(at)


def severity(phash_distance: Column, dhash_distance: Column, limits=SEVERITIES) -> Column:
    """First severity of which both distances are within the limits; null if none."""
    out = F.lit(None).cast("string")
    for name, p, d in reversed(limits):
        out = F.when((phash_distance <= p) & (dhash_distance <= d), name).otherwise(out)
    return out


def severity_rank(c: Column, limits=SEVERITIES) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(s[0]) for s in limits]), c), F.lit(0).cast("long"))


def stable_seed(c: Column, base: int = 44) -> Column:
    return base + F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def display_name(category: Column) -> Column:
    return F.replace(category, F.lit("_"), F.lit(" "))


def content_id(prefix: str, category: Column, split: Column, rank: Column, sha: Column) -> Column:
    """prefix_category_split_rank_sha: rank in four digits, 16 digits of the digest."""
    return F.concat_ws("_", F.lit(prefix), category, split, F.lpad(rank.cast("string"), 4, "0"), F.substring(sha, 1, 16))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _as_bits(bits: Column) -> Column:
    """Up to 64 zeros and ones as a long, the first one highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def difference_hash(rows: Column) -> Column:
    """A bit for every two neighbours in each row (8 rows of 9 values give 64), set if the right value is larger; the first pair's bit is the highest."""
    return _as_bits(F.flatten(F.transform(rows, lambda r: F.zip_with(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, F.size(r) - 1), lambda right, left: (right > left).cast("int")))))


def cosine_rows(size: int, low: int) -> list[list[float]]:
    """The first rows of the orthonormal DCT-II matrix."""
    return [[math.sqrt((1 if u == 0 else 2) / size) * math.cos(math.pi * (2 * i + 1) * u / (2 * size)) for i in range(size)] for u in range(low)]


def perceptual_hash(pixels: Column, size: int = 32, low: int = 8) -> Column:
    """64 bits of a size x size matrix: its orthonormal DCT-II's low x low corner, row by row, set where a value exceeds the median of all but the first."""
    weights = F.array(*[F.array(*[F.lit(v) for v in row]) for row in cosine_rows(size, low)])
    zeros = F.array_repeat(F.lit(0.0), size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    down = lambda px: F.transform(weights, lambda w: F.aggregate(F.zip_with(w, px, lambda c, row: F.transform(row, lambda x: x * c)), zeros, add))
    dot = lambda t, w: F.aggregate(F.zip_with(t, w, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    corner = lambda px: F.flatten(F.transform(down(px), lambda t: F.transform(weights, lambda w: dot(t, w))))
    middle = lambda flat: F.get(F.sort_array(F.slice(flat, 2, low * low - 1)), F.lit((low * low - 2) // 2))
    bits = lambda flat: _bound(middle(flat), lambda m: _as_bits(F.transform(flat, lambda v: (v > m).cast("int"))))
    numbers = F.transform(pixels, lambda row: F.transform(row, lambda x: x.cast("double")))
    return _bound(numbers, lambda px: _bound(corner(px), bits))


def softmax(logits: Column) -> Column:
    e = _bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return _bound(e, lambda e: _bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalize(pixels: Column, means: Sequence[float], stds: Sequence[float]) -> Column:
    """Pixels (arrays of one value a channel, 0..255, row after row) as one array a channel, scaled to 0..1 and by the channel's mean and deviation."""

    def channel(k: int, mean: float, std: float) -> Column:
        return F.transform(pixels, lambda x: (F.get(x, F.lit(k)).cast("double") / 255.0 - mean) / std)

    return F.array(*[channel(k, m, s) for k, (m, s) in enumerate(zip(means, stds, strict=True))])


def augment(rows: Column, key: Column, seed: int = 44) -> Column:
    """A channel's rows (0..1), mirrored for half of the keys and times a brightness within BRIGHTNESS, cut to 0..1.

    Both come from the SHA-256 of "seed|key", so a row is changed alike on every run: the first digit mirrors if below 8, the next eight give the brightness."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)
    low, high = BRIGHTNESS
    factor = low + (high - low) * F.conv(F.substring(h, 2, 8), 16, 10).cast("double") / float(1 << 32)
    turned = F.when(F.substring(h, 1, 1) < "8", F.transform(rows, F.reverse)).otherwise(rows)
    return _bound(factor, lambda f: F.transform(turned, lambda r: F.transform(r, lambda x: F.least(F.greatest(x * f, F.lit(0.0)), F.lit(1.0)))))


def beside(*arrays: Column) -> Column:
    """Feature arrays put one after the other, as numbers; null if one of them is."""
    return F.concat(*[F.transform(a, lambda x: x.cast("double")) for a in arrays])


def pixel_vector(rows: Column) -> Column:
    """Nested rows of 0..255 flattened to 0..1."""
    return F.transform(F.flatten(rows), lambda x: x.cast("double") / 255.0)


def any_contains(df: DataFrame, text: str) -> Column:
    """Whether any column, as text, holds the text in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in df.columns])


def safe_archive_path(path: Column) -> Column:
    """Whether a path inside an archive stays in it: relative, no drive, no .. part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~(p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), ".."))


def parts_of_path(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
