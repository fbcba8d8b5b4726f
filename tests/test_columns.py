import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparrel.functions import columns as C
from sparrel.functions import text as T


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "distance"), [(0, 0, 0), (0, 15, 4), (0b1010, 0b0011, 2), (-1, 5, 62)])
def test_hamming(spark, a, b, distance):
    assert one(spark, C.hamming(F.lit(a).cast("long"), F.lit(b).cast("long"))) == distance


@pytest.mark.parametrize(("p", "d", "name"), [(4, 6, "very_strict"), (6, 8, "strict"), (8, 10, "screen"), (9, 10, None), (8, 11, None), (4, 7, "strict"), (0, 10, "screen")])
def test_severity(spark, p, d, name):
    assert one(spark, C.severity(F.lit(p), F.lit(d))) == name


def test_severity_rank_orders_and_skips_null(spark):
    ranks = [one(spark, C.severity_rank(F.lit(s).cast("string"))) for s in ("very_strict", "strict", "screen", None)]
    assert ranks[:3] == [1, 2, 3] and ranks[3] is None


@pytest.mark.parametrize(("x", "n"), [(28.5, 28), (31.5, 32), (29.5, 30), (0.45, 0)])
def test_half_even(spark, x, n):
    assert one(spark, C.half_even(F.lit(x))) == n


def test_strict_bool(spark):
    assert [one(spark, C.strict_bool(F.lit(s))) for s in (" True ", "FALSE", "true")] == [True, False, True]
    for bad in ("yes", "", None):
        with pytest.raises(PySparkException):
            one(spark, C.strict_bool(F.lit(bad).cast("string")))


def test_relation_label(spark):
    rows = spark.createDataFrame([("a", "a", "f", "f", "MATCH"), ("a", "b", "f", "f", "PARTIAL_MATCH"), ("a", "c", "f", "g", "MISMATCH")], "ic string, tc string, if string, tf string, want string")
    rule = C.relation_label(F.col("ic"), F.col("tc"), F.col("if"), F.col("tf"))
    assert rows.where(rule != F.col("want")).count() == 0
    with pytest.raises(PySparkException, match="unknown category"):
        spark.range(1).select(C.relation_label(F.lit("a"), F.lit("b"), F.lit("f"), F.lit(None).cast("string"))).collect()


def test_encode(spark):
    assert [one(spark, C.encode(F.lit(v).cast("string"), C.LABELS)) for v in (*C.LABELS, None)] == [0, 1, 2, None]
    with pytest.raises(PySparkException, match="unknown value"):
        one(spark, C.encode(F.lit("OTHER"), C.LABELS))


def test_hashes_of_arrays(spark):
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((9, 1, 3, 2, 8), (1, 2, 2, 1, 9))])
    assert one(spark, C.difference_hash(rows)) == 0b01011001
    rng = np.random.default_rng(1)
    for k in range(3):
        pixels = rng.integers(0, 256, (32, 32)).astype(float)
        u, i = np.arange(8)[:, None], np.arange(32)[None, :]
        a = np.sqrt(np.where(u == 0, 1, 2) / 32) * np.cos(np.pi * (2 * i + 1) * u / 64)
        low = (a @ pixels @ a.T).ravel()
        want = int("".join("01"[int(v > np.median(low[1:]))] for v in low), 2)
        df = spark.createDataFrame([(pixels.tolist(),)], "p array<array<double>>")
        assert df.select(C.perceptual_hash(F.col("p"))).first()[0] % (1 << 64) == want
    assert one(spark, C.stable_seed(F.lit("x"))) == 44 + int(__import__("hashlib").sha256(b"x").hexdigest()[:8], 16)


def test_softmax_and_argmax(spark):
    p = one(spark, C.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))))
    assert p == [0.5, 0.5, 0.0] and one(spark, C.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1


def test_paths(spark):
    assert [one(spark, C.safe_archive_path(F.lit(p))) for p in ("a/b.jpg", "../a", "a\\..\\b", "/a", "C:\\a", "a..b/c")] == [True, False, False, False, False, True]
    assert one(spark, C.content_id("v4", F.lit("brake"), F.lit("test"), F.lit(7), F.lit("0123456789abcdef99"))) == "v4_brake_test_0007_0123456789abcdef"


def test_any_contains_skips_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "Has It"), (317, "no")], "a int, b string")
    assert [r.a for r in df.where(C.any_contains(df, "has")).collect()] == [2] and df.where(C.any_contains(df, "17")).count() == 1


def brute_tfidf(train, test, k):
    import math
    import re
    from collections import Counter

    terms = lambda t: (w := re.findall(r"\w{2,}", (t or "").lower())) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    total, df = Counter(), Counter()
    for t in train:
        c = Counter(terms(t))
        total.update(c)
        df.update(c.keys())
    vocab = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]]
    idf = {w: math.log((1 + len(train)) / (1 + df[w])) + 1 for w in vocab}
    out = []
    for t in test:
        raw = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(terms(t)).items() if w in idf}
        z = math.sqrt(sum(v * v for v in raw.values()))
        out.append({w: v / z for w, v in raw.items()})
    return vocab, out


def test_tfidf_against_brute_force(spark):
    train = ["the red fox a b", "the blue fox and the red hen", "a hen", None, ""]
    test = ["red hen unseen words", "", None, "THE the fox"]
    vocab, want = brute_tfidf(train, test, 8)
    fitted = T.fit(spark.createDataFrame(list(enumerate(train)), "id long, text string"), "id", "text", 8)
    assert {r.term: r["index"] for r in fitted.collect()} == {w: k for k, w in enumerate(sorted(vocab))}
    rows = spark.createDataFrame(list(enumerate(test)), "id long, text string")
    got = {}
    for r in T.transform(rows, fitted, "id", "text").collect():
        got.setdefault(r.id, {})[r.term] = r.weight
    for k, w in enumerate(want):
        assert got.get(k, {}).keys() == w.keys() and all(abs(got[k][t] - v) < 1e-12 for t, v in w.items())
    assert {r.id: r.recognised for r in T.recognised(rows, fitted, "id", "text").collect()} == {k: len(w) for k, w in enumerate(want)}
    unlimited = T.fit(spark.createDataFrame(list(enumerate(train)), "id long, text string"), "id", "text", None)
    assert unlimited.count() == len(brute_tfidf(train, test, 10**6)[0])


def test_blank_descriptions_are_an_error(spark):
    assert one(spark, T.require_text(F.lit(" a "))) == "a"
    with pytest.raises(PySparkException, match="description"):
        one(spark, T.require_text(F.lit("  ")))


def test_feature_arrays(spark):
    assert one(spark, C.beside(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.5)))) == [1.0, 2.0, 0.5]
    assert one(spark, C.pixel_vector(F.array(F.array(F.lit(0), F.lit(255)), F.array(F.lit(51), F.lit(102))))) == [0.0, 1.0, 0.2, 0.4]
    assert one(spark, C.normalize(F.array(*[F.array(F.lit(v), F.lit(255.0)) for v in (51.0, 102.0)]), (0.2, 0.5), (0.5, 0.25))) == [[0.0, 0.4], [2.0, 2.0]]
