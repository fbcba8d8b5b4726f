"""Resampling, augmentation and PNG files against plain Python."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.functions import pixels as P
from sparrel.sources import images


def weights(size, target, kind):
    """Per place of the result a list of (place, whole-number weight)."""
    scale = size / target
    wide, out = max(scale, 1.0), []
    reach = {"bilinear": 1, "lanczos": 3}[kind] * wide
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    curve = (lambda t: max(1 - abs(t), 0.0)) if kind == "bilinear" else (lambda t: sinc(t) * sinc(t / 3) if -3 <= t < 3 else 0.0)
    for o in range(target):
        c = (o + 0.5) * scale
        places = range(max(int(c - reach + 0.5), 0), min(int(c + reach + 0.5), size))
        raw = [curve((i - c + 0.5) / wide) for i in places]
        out.append([(i, int(w / sum(raw) * (1 << 22) + (0.5 if w >= 0 else -0.5))) for i, w in zip(places, raw)])
    return out


def resized(rows, width, height, kind):
    whole = lambda t: min(max((t + (1 << 21)) >> 22, 0), 255)
    rows = [[whole(sum(row[i] * w for i, w in taps)) for taps in weights(len(row), width, kind)] for row in rows]
    return [[whole(sum(rows[i][x] * w for i, w in taps)) for x in range(width)] for taps in weights(len(rows), height, kind)]


@pytest.mark.parametrize("kind", ["bilinear", "lanczos"])
@pytest.mark.parametrize("target", [(16, 16), (9, 8), (32, 32), (1, 1)])
def test_resizing(spark, kind, target):
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 256, (h, w)).tolist() for h, w in ((40, 57), (1, 1), (7, 3), (16, 16), (100, 2))] + [[[255] * 30] * 20]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pictures)] + [(99, None)], "id int, rows array<array<int>>")
    got = {r.id: r.out for r in df.select("id", P.resized(F.col("rows"), *target, kind).alias("out")).collect()}
    assert got.pop(99) is None
    assert got == {k: resized(p, *target, kind) for k, p in enumerate(pictures)}
    assert got[5] == [[255] * target[0]] * target[1]


def test_same_size_changes_nothing(spark):
    rows = np.random.default_rng(2).integers(0, 256, (8, 9)).tolist()
    df = spark.createDataFrame([(rows,)], "rows array<array<int>>")
    for kind in P.REACH:
        assert df.select(P.resized(F.col("rows"), 9, 8, kind)).first()[0] == rows


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(width, height, depth, kind, lines, palette=None, interlace=0):
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlace))
    return images.PNG + body + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def filtered(rows, step):
    """Each line of bytes by another filter."""
    out, above = [], bytes(len(rows[0]))
    for y, row in enumerate(rows):
        line = []
        for x, v in enumerate(row):
            left, up, corner = (row[x - step], above[x], above[x - step]) if x >= step else (0, above[x], 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((v - (0, left, up, (left + up) // 2, paeth)[y % 5]) & 255)
        out.append(bytes([y % 5, *line]))
        above = bytes(row)
    return out


@pytest.mark.parametrize("kind, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_png_colours_and_filters(kind, channels, depth):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 256, (11, 6, channels))
    rows = [[b for v in row.ravel().tolist() for b in ((v,) if depth == 8 else (v, 17))] for row in values]
    got = images.decode_png(png(6, 11, depth, kind, filtered(rows, channels * depth // 8)))
    want = values[:, :, :3] if channels > 2 else np.repeat(values[:, :, :1], 3, axis=2)
    assert (got == want).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palettes_and_few_bits(depth):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << depth, (5, 7))
    bits = lambda row: int("".join(f"{v:0{depth}b}" for v in row).ljust(-(-7 * depth // 8) * 8, "0"), 2).to_bytes(-(-7 * depth // 8), "big")
    lines = [b"\0" + bits(row.tolist()) for row in values]
    palette = bytes(rng.integers(0, 256, 3 << depth).tolist())
    assert (images.decode_png(png(7, 5, depth, 3, lines, palette)) == np.frombuffer(palette, np.uint8).reshape(-1, 3)[values]).all()
    assert (images.decode_png(png(7, 5, depth, 0, lines)) == (values * (255 // ((1 << depth) - 1)))[:, :, None]).all()


def test_png_round_trip_and_damage():
    picture = np.random.default_rng(5).integers(0, 256, (13, 9, 3))
    content = images.encode_png(picture)
    assert (images.decode_png(content) == picture).all()
    for wrong in (b"", b"x" * 40, content[:-40], content[:60] + b"?" + content[61:], png(7, 5, 8, 0, [b"\0" * 8] * 5, interlace=1), png(7, 5, 8, 0, [b"\0" * 8] * 4), png(7, 5, 8, 0, [b"\7" + b"1" * 7] * 5)):
        with pytest.raises(ValueError):
            images.decode_png(wrong)


def test_each_picture_is_decoded_once(spark, tmp_path):
    picture = np.random.default_rng(6).integers(0, 256, (10, 12, 3))
    contents = spark.createDataFrame([("a/x.png", images.encode_png(picture)), ("a/unused.png", b"broken")], "path string, content binary")
    asked = spark.createDataFrame([(k, "a\\x.png" if k % 2 else "a/x.png") for k in range(20)], "id int, path string")
    marks = str(tmp_path)

    def decode(content):
        import tempfile

        tempfile.mkstemp(dir=marks)
        return images.decode_png(content)

    rows = images.loaded(asked, contents, 4, 4, decode).collect()
    want = [resized(picture[:, :, k].tolist(), 4, 4, "bilinear") for k in range(3)]
    assert len(rows) == 20 and all(r.channels == want for r in rows) and len(list(tmp_path.iterdir())) == 1
    for path, why in (("b.png", "no file"), ("a/unused.png", "not a PNG"), (None, "no picture at null")):
        with pytest.raises(Exception, match=why):
            images.loaded(spark.createDataFrame([(1, path)], "id int, path string"), contents, 4, 4).collect()


def draws(key):
    h = hashlib.sha256(f"44|{key}".encode()).hexdigest()
    return h[0] < "8", [int(h[1 + 8 * k : 9 + 8 * k], 16) / 2**32 for k in range(5)]


def rotated(channel, degrees, kind):
    h, w = channel.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    at = lambda y, x: channel[y, x] if 0 <= y < h and 0 <= x < w else 0.0
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            a, b = x + 0.5 - w / 2, y + 0.5 - h / 2
            sx, sy = c * a - s * b + w / 2 - 0.5, s * a + c * b + h / 2 - 0.5
            if kind == "nearest":
                out[y, x] = at(math.floor(sy + 0.5), math.floor(sx + 0.5))
                continue
            y0, x0 = math.floor(sy), math.floor(sx)
            v, u = sy - y0, sx - x0
            out[y, x] = at(y0, x0) * (1 - v) * (1 - u) + at(y0, x0 + 1) * (1 - v) * u + at(y0 + 1, x0) * v * (1 - u) + at(y0 + 1, x0 + 1) * v * u
    return out


def changed(picture, key, kind):
    mirror, u = draws(key)
    p = picture[:, :, ::-1] if mirror else picture
    p = np.stack([rotated(c, 12 * u[0] - 6, kind) for c in p])
    factors = {"b": 0.9 + 0.2 * u[1], "c": 0.9 + 0.2 * u[2], "s": 0.92 + 0.16 * u[3]}
    for o in ("bcs", "bsc", "cbs", "csb", "sbc", "scb")[int(u[4] * 6)]:
        greys = 0.2989 * p[0] + 0.587 * p[1] + 0.114 * p[2]
        base = {"b": 0.0, "c": greys.mean(), "s": greys}[o]
        p = np.clip(base + factors[o] * (p - base), 0, 1)
    return p


@pytest.mark.parametrize("kind", ["bilinear", "nearest"])
def test_augmentation(spark, kind):
    rng = np.random.default_rng(7)
    pictures = {k: rng.random((3, h, w)) for k, (h, w) in enumerate([(8, 8), (5, 9), (1, 1), (12, 4)] * 4)}
    df = spark.createDataFrame([(k, p.tolist()) for k, p in pictures.items()], "id int, p array<array<array<double>>>")
    for r in df.select("id", P.changed(F.col("p"), F.col("id"), kind=kind).alias("out")).collect():
        assert np.allclose(np.array(r.out), changed(pictures[r.id], r.id, kind), atol=1e-12)


def test_a_quarter_turn_goes_against_the_clock(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "c array<array<double>>")
    got = df.select(P.rotated(F.col("c"), F.lit(90.0), "nearest")).first()[0]
    assert got == [[2.0, 4.0], [1.0, 3.0]]
