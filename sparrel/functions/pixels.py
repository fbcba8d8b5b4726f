"""Pictures as arrays: a channel is an array of rows of numbers, a picture an array of channels.

resized() works on whole numbers of 0..255 in the fixed-point arithmetic that image libraries share: a pass over each row, then one over the columns, weights as
22-bit fractions, results rounded and cut to 0..255 after each pass.  Weights come from the size of each picture, so pictures of any size may be mixed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import _bound

# Reach of each filter, bits of a weight, weights of red, green and blue in a grey value (16-bit fractions, then shares), limits of the changes.
REACH = {"bilinear": 1.0, "lanczos": 3.0}
WEIGHT_BITS = 22
GREY, GREY_SHARES = (19595, 38470, 7471), (0.2989, 0.587, 0.114)
DEGREES, BRIGHTNESS, CONTRAST, SATURATION = 6.0, 0.10, 0.10, 0.08


def _curve(kind: str, x: Column) -> Column:
    if kind == "bilinear":
        return F.greatest(1.0 - F.abs(x), F.lit(0.0))
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v * math.pi) / (v * math.pi))
    return F.when((x >= -3.0) & (x < 3.0), sinc(x) * sinc(x / 3.0)).otherwise(0.0)


def kernel(size: Column, target: int, kind: str) -> Column:
    """For each place of the result: start (from 0) of the places it is made of, and their weights.

    Where the result is smaller the filter grows with the ratio, so that every place of the source counts."""
    scale = size.cast("double") / float(target)
    wide = F.greatest(scale, F.lit(1.0))
    reach = REACH[kind] * wide

    def place(i: Column) -> Column:
        center = (i.cast("double") + 0.5) * scale
        start = F.greatest((center - reach + 0.5).cast("int"), F.lit(0))
        end = F.least((center + reach + 0.5).cast("int"), size)
        raw = F.transform(F.sequence(start, end - 1), lambda x: _curve(kind, (x.cast("double") - center + 0.5) / wide))
        total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
        fixed = lambda share: (share * float(1 << WEIGHT_BITS) + F.when(share < 0, -0.5).otherwise(0.5)).cast("long")
        return F.struct(start.alias("start"), _bound(raw, lambda w: _bound(total(w), lambda t: F.transform(w, lambda v: fixed(v / t)))).alias("weights"))

    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), place)


def _whole(total: Column) -> Column:
    return F.least(F.greatest(F.shiftright(total, WEIGHT_BITS), F.lit(0).cast("long")), F.lit(255).cast("long"))


def resized(channel: Column, width: int, height: int, kind: str = "bilinear") -> Column:
    """A channel (rows of 0..255, all of one length, at least one) in another size; null stays null."""
    half = F.lit(1 << (WEIGHT_BITS - 1)).cast("long")
    piece = lambda values, k: F.slice(values, k.start + 1, F.size(k.weights))

    def across(rows: Column) -> Column:
        dot = lambda row, k: F.aggregate(F.zip_with(piece(row, k), k.weights, lambda v, w: v.cast("long") * w), half, lambda a, b: a + b)
        return _bound(kernel(F.size(F.get(rows, F.lit(0))), width, kind), lambda ks: F.transform(rows, lambda row: F.transform(ks, lambda k: _whole(dot(row, k)))))

    def down(rows: Column) -> Column:
        add = lambda total, part: F.zip_with(total, part, lambda a, b: a + b)
        weighed = lambda k: F.zip_with(piece(rows, k), k.weights, lambda row, w: F.transform(row, lambda v: v * w))
        column = lambda k: F.transform(F.aggregate(weighed(k), F.array_repeat(half, width), add), _whole)
        return F.transform(kernel(F.size(rows), height, kind), column)

    return F.when(channel.isNotNull(), _bound(across(channel), down))


def grey(channels: Column) -> Column:
    """One channel of three: the usual luminance, in whole numbers."""
    red, green, blue = (F.get(channels, F.lit(k)) for k in range(3))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    weighed = lambda rows, w: F.transform(rows, lambda row: F.transform(row, lambda v: v.cast("long") * w))
    total = F.zip_with(F.zip_with(weighed(red, GREY[0]), weighed(green, GREY[1]), both), weighed(blue, GREY[2]), both)
    return F.transform(total, lambda row: F.transform(row, lambda v: F.shiftright(v + (1 << 15), 16)))


def interleaved(channels: Column) -> Column:
    """All values of a picture, row by row, pixel by pixel, channel by channel."""
    of = lambda y, x: F.transform(channels, lambda c: F.get(F.get(c, y), x))
    first = F.get(channels, F.lit(0))
    across = F.sequence(F.lit(0), F.size(F.get(first, F.lit(0))) - 1)
    rows = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda y: F.flatten(F.transform(across, lambda x: of(y, x))))
    return F.flatten(rows)


def rotated(channel: Column, degrees: Column, kind: str = "bilinear") -> Column:
    """A channel turned counter-clockwise about its centre, in its own size; what comes from outside is 0.

    Each place takes the value of the place it came from: of the nearest pixel, or of the four around it by their nearness."""
    height, width = F.size(channel), F.size(F.get(channel, F.lit(0)))
    value = lambda y, x: F.coalesce(F.get(F.get(channel, y), x), F.lit(0.0))

    def sampled(y: Column, x: Column) -> Column:
        if kind == "nearest":
            return value(F.floor(y + 0.5).cast("int"), F.floor(x + 0.5).cast("int"))
        corner = F.struct(F.floor(y).cast("int").alias("y"), F.floor(x).cast("int").alias("x"), (y - F.floor(y)).alias("v"), (x - F.floor(x)).alias("u"))
        near = lambda c, a, b: value(c.y + a, c.x + b) * (c.v if a else 1.0 - c.v) * (c.u if b else 1.0 - c.u)
        return _bound(corner, lambda c: near(c, 0, 0) + near(c, 0, 1) + near(c, 1, 0) + near(c, 1, 1))

    def turned(t: Column) -> Column:
        def place(y: Column, x: Column) -> Column:
            across, along = x + 0.5 - width / 2, y + 0.5 - height / 2
            return sampled(t.s * across + t.c * along + height / 2 - 0.5, t.c * across - t.s * along + width / 2 - 0.5)

        xs = F.sequence(F.lit(0), width - 1)
        return F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.transform(xs, lambda x: place(y, x)))

    return _bound(F.struct(F.cos(F.radians(degrees)).alias("c"), F.sin(F.radians(degrees)).alias("s")), turned)


def _each(channels: Column, change) -> Column:
    """change(value) of every value, cut to 0..1."""
    cut = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.transform(channels, lambda c: F.transform(c, lambda row: F.transform(row, lambda v: cut(change(v)))))


def _shares(channels: Column) -> Column:
    """The grey value of each place, from shares of 0..1."""
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    weighed = lambda k: F.transform(F.get(channels, F.lit(k)), lambda row: F.transform(row, lambda v: v * GREY_SHARES[k]))
    return F.zip_with(F.zip_with(weighed(0), weighed(1), both), weighed(2), both)


def brighter(channels: Column, factor: Column) -> Column:
    return _each(channels, lambda v: v * factor)


def contrasted(channels: Column, factor: Column) -> Column:
    """Every value moved from or towards the picture's mean grey."""
    flat = F.flatten(_shares(channels))
    return _bound(F.aggregate(flat, F.lit(0.0), lambda a, b: a + b) / F.size(flat), lambda m: _each(channels, lambda v: m + factor * (v - m)))


def saturated(channels: Column, factor: Column) -> Column:
    """Every value moved from or towards its place's grey."""
    cut = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    mixed = lambda row, greys: F.zip_with(row, greys, lambda v, g: cut(g + factor * (v - g)))
    return _bound(_shares(channels), lambda greys: F.transform(channels, lambda c: F.zip_with(c, greys, mixed)))


def changed(channels: Column, key: Column, seed: int = 44, kind: str = "bilinear") -> Column:
    """A picture (three channels of 0..1) mirrored for half of the keys, turned by up to DEGREES, and brightness, contrast and saturation changed in an order of its own.

    All draws come from the SHA-256 of "seed|key": the first digit mirrors if below 8, then eight digits each give the angle, the three factors, and the order."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"), 256)
    draw = lambda h, k: F.conv(F.substring(h, 2 + 8 * k, 8), 16, 10).cast("double") / float(1 << 32)
    around = lambda h, k, limit: 1.0 - limit + 2.0 * limit * draw(h, k)
    # The six orders of brightness (0), contrast (1) and saturation (2).
    orders = F.array(*[F.array(*[F.lit(o) for o in order]) for order in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))])

    def whole(d: Column) -> Column:
        mirrored = F.when(d.mirror, F.transform(channels, lambda c: F.transform(c, F.reverse))).otherwise(channels)
        turned = F.transform(mirrored, lambda c: rotated(c, d.angle, kind))
        change = lambda p, o: F.when(o == 0, brighter(p, d.brightness)).when(o == 1, contrasted(p, d.contrast)).otherwise(saturated(p, d.saturation))
        return F.aggregate(F.get(orders, d.order), turned, change)

    draws = lambda h: F.struct(
        (F.substring(h, 1, 1) < "8").alias("mirror"), (2.0 * DEGREES * draw(h, 0) - DEGREES).alias("angle"), around(h, 1, BRIGHTNESS).alias("brightness"),
        around(h, 2, CONTRAST).alias("contrast"), around(h, 3, SATURATION).alias("saturation"), (draw(h, 4) * 6).cast("int").alias("order"),
    )
    return _bound(digest, lambda h: _bound(draws(h), whole))
