import math
import random
import zlib

import numpy as np

from sparrel.llm import language_id as L, toxicity as T

LETTERS = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}


def prose(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def languages(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        rows.append((i, prose(rng, LETTERS[lang] + "yz", rng.randrange(2, 60)), lang))
    rows += [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "12 345 !", "bb"), (n + 3, prose(rng, LETTERS["cc"], 50_000), "cc"), (n + 4, "abc", None), (None, "abc abc", "aa")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy_and_unknown_texts(spark):
    df = languages(spark)
    model = L.fit(df)
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.3  # sparse
    got, want = {r.doc_id: r for r in L.predict(df, model).collect()}, {r.doc_id: r.lang for r in df.collect()}
    assert len(got) == 406 and all(r.held_out == held_out(d) for d, r in got.items() if d is not None) and got[None].held_out is None
    test = [d for d in range(400) if held_out(d)]
    assert len(test) > 50 and np.mean([got[d].lang_pred == want[d] for d in test]) > 0.97
    assert [(got[d].lang_pred, got[d].score) for d in (400, 401, 402)] == [("und", 0.0)] * 3
    assert got[403].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got.values())
    assert L.known(df, model).columns == df.columns and L.known(df, model).where("doc_id in (400, 401, 402)").count() == 0


def test_predictions_depend_on_text_only(spark):
    df = languages(spark)
    model = L.fit(df)
    changed = df.selectExpr("doc_id + 1 as doc_id", "text", "'zz' as lang")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.predict(x, model).where("doc_id is not null").collect()} for x in (df, changed))
    assert {d + 1: v for d, v in a.items()} == b


def test_counts_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(1), "abcdeéß漢", 500)
    whole = L.counts(text)
    monkeypatch.setattr(L, "_CHUNK", 37)
    assert (L.counts(text) == whole).all() and whole.sum() == 3 * len(text.lower()) - 3


def test_temperature_makes_scores_fit():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    z = np.where(rng.random(4000) < 0.8, y, 1 - y)
    assert abs(L.fit_temperature(np.stack((10.0 * (z == 0), 10.0 * (z == 1)), axis=1), y) - 10 / np.log(4)) < 0.6


def test_no_labels_at_all(spark, empty, odd):
    model = L.fit(empty)
    assert [r.lang_pred for r in L.predict(odd, model).collect()] == ["und"] * 7 and L.predict(empty, model).count() == 0
    assert L.predict(odd, L.fit(odd)).count() == 7


def comments(spark, n=1500):
    rng = random.Random(6)
    stems = [prose(rng, "abcdefghijklm", 1).split()[0] + "xqz" for _ in range(3)]
    rows, labels = [], []
    for i in range(n):
        w, toxic = prose(rng, "abcdefghijklmnopqrst", rng.randrange(5, 80)).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(("idiot", "m0ron", rng.choice(stems) + rng.choice("abc"))))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, toxic))
    rows += [(n, None), (n + 1, ""), (None, "you idiot"), (n + 2, "word " * 100_000)]
    labels += [(None, 1), (n, None), (1, 0), (1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_rows_are_found(spark):
    docs, labels = comments(spark)
    model = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(got) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [d for d in range(1500) if held_out(d)]
    assert np.mean([got[d].predicted == (d % 4 == 0) for d in test]) > 0.95
    assert got[1500].predicted == got[1501].predicted == got[1502].predicted == 0 and got[None].predicted == 1


def test_labels_of_held_out_rows_are_never_learned_from(spark):
    docs, labels = comments(spark, 600)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = (T.score(docs, T.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_few_or_no_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in T.score(odd, T.fit(odd, none)).collect()} == {0.0}
    assert T.score(empty, T.fit(empty, none)).count() == 0
    one = spark.createDataFrame([(3, 1), (4, 1), (5, 1), (-7, 1)], "doc_id bigint, toxic int")
    assert T.score(odd, T.fit(odd, one)).count() == 7
    assert T.score(odd, T.fit(odd, spark.createDataFrame([(i, i % 2) for i in range(-8, 8)], "doc_id bigint, toxic int"))).count() == 7


def test_isotonic():
    x, y = T.isotonic(np.array([1, 2, 2, 3, 4]), np.array([0, 1, 0, 0, 1.0]))
    assert (np.diff(y) >= 0).all() and x.tolist() == [1, 3, 4] and np.allclose(y, [0, 1 / 3, 1])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    raw = T.Trees().fit(x, y).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.97


def test_the_lexicon_against_brute_force():
    rng = np.random.default_rng(4)
    candidates = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "xyz", "xyzu*", "q")]
    rows = [sorted(rng.choice(len(candidates), rng.integers(0, 9), replace=False).tolist()) for _ in range(300)]
    covered, gone, want = [0] * len(rows), set(), []
    while len(want) < 12:
        gain = [sum(covered[k] < T.COVER and c in own for k, own in enumerate(rows)) if c not in gone else -1 for c in range(len(candidates))]
        best = gain.index(max(gain))
        if gain[best] < 3:
            break
        want.append(best)
        covered = [n + (best in own) for n, own in zip(covered, rows, strict=True)]
        stem = candidates[best].rstrip("*")
        gone |= {c for c, u in enumerate(candidates) if stem.startswith(u.rstrip("*")) or u.rstrip("*").startswith(stem)}
    starts = np.cumsum([0, *map(len, rows)])
    assert T.covering(candidates, starts, np.array([c for own in rows for c in own]), 12) == want and len(want) > 3


def test_trees_and_isotonic_regression_against_brute_force():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) | (rng.random(400) < 0.05)).astype(float)
    trees = T.Trees(rounds=8).fit(x, y)
    raw = trees.raw(x)
    for row, got in zip(x[:50], raw, strict=False):  # walked node by node
        total = trees.start
        for feature, cut, value in trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(feature[node] >= 0 and row[feature[node]] > cut[node])
            total += value[node - len(feature)]
        assert abs(total - got) < 1e-9
    # The first split is the best of all cuts by gain, counted over all rows.
    g, h, best = y - y.mean(), np.full(400, y.mean() * (1 - y.mean())), {}
    for j in range(3):
        for c in range(6):
            left = x[:, j] <= c
            if left.any() and not left.all():
                best[j, c] = sum(g[m].sum() ** 2 / (h[m].sum() + trees.ridge) for m in (left, ~left))
    (j, c) = max(best, key=best.get)
    assert trees.trees[0][0][0] == j and trees.trees[0][1][0] == c
    v = rng.integers(0, 30, 120).astype(float)
    t = (rng.random(120) < v / 30).astype(float)
    knots = T.isotonic(v, t)
    at = sorted(set(v.tolist()))
    mean = lambda a, b: t[(v >= a) & (v <= b)].mean()
    for q in at:  # the largest, over starts, of the smallest mean, over ends
        want = max(min(mean(a, b) for b in at if b >= q) for a in at if a <= q)
        assert abs(knots[1][np.searchsorted(knots[0], q)] - want) < 1e-12


def test_language_scores_against_brute_force(spark):
    rng = np.random.default_rng(6)
    text = lambda letters: "".join(rng.choice(list(letters + " "), 60))
    rows = [(k, text("abc" if k % 2 else "äöc"), "one" if k % 2 else "two") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit(df)

    def grams(t):
        found, points, m = {}, [ord(c) for c in t.lower()], 0xFFFFFFFF
        for n in range(1, L.MAX_N + 1):
            for i in range(len(points) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h ^ (points[i + k] * int(L._FACTORS[k]) + k + 1 & m)) * 0x27D4EB2F) & m
                    h ^= h >> 15
                b = ((h * 0x2C1B3C6D) & m) >> (32 - L.BUCKET_BITS)
                found[b] = found.get(b, 0) + 1
        return found

    train = [(grams(t), lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 5 != 0]
    df_of = {}
    for found, _ in train:
        for b in found:
            df_of[b] = df_of.get(b, 0) + 1
    for d, t, _ in rows[:20]:
        x = {b: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df_of.get(b, 0))) + 1) for b, n in grams(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / norm * float(model.weights[b, k]) for b, v in x.items()) + float(model.bias[k]) for k in range(2)]
        e = [math.exp((v - max(z)) / model.temperature) for v in z]
        lang, score = model.predict(t)
        assert lang == model.languages[e.index(max(e))] and abs(score - max(e) / sum(e)) < 1e-4
    held = [(t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(model.predict(t)[0] == lang for t, lang in held)


def test_regression_steps_against_brute_force():
    rng = np.random.default_rng(7)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4).astype(np.float32), int(rng.integers(3))) for _ in range(30)]
    w, bias = L.ftrl(rows, 12, 3, epochs=2)
    z, n = np.zeros((13, 3)), np.zeros((13, 3))
    weight = lambda i, c: 0.0 if abs(z[i, c]) <= 1e-3 else -(z[i, c] - math.copysign(1e-3, z[i, c])) / ((1 + math.sqrt(n[i, c])) / 0.5 + 1e-3)
    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            bucket, x, label = rows[k]
            at = [*zip(bucket.tolist(), x.tolist(), strict=True), (12, 0.1)]
            s = [sum(v * weight(i, c) for i, v in at) for c in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            now = {(i, c): weight(i, c) for i, _ in at for c in range(3)}
            for i, v in at:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == label))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / 0.5 * now[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(13)])
    assert np.abs(w - want[:-1]).max() < 1e-3 and np.abs(bias - want[-1] * 0.1).max() < 1e-3
