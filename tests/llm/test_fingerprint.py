import hashlib
import re

from pyspark.sql import functions as F

from sparrel.llm import fingerprint as P


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    cells = lambda s: {p for p in re.sub(P.ENDS, r"\1\n", s).split("\n") if p}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 2
        e = t[: len(t) - k] + n[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), like(cells(t), cells(e)), like(cells(t), cells(n))))
    return out


def same(df, rows):
    got = df.collect()
    want = sorted(brute(rows), key=repr)
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12 and abs(a[4] - b[4]) < 1e-12
    return got


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(200, "\n".join(f"line {i}" for i in range(3000))), (199, "\n".join(f"line {i}" for i in range(5, 3000))), (198, "🎉é" * 7), (197, "One. It is. Then so.  Ends! É? Île. e. N " * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = same(P.fingerprints(df), rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({f for v in by_text.values() for f in v}) >= len(by_text) - 3  # texts without paragraphs are alike


def test_small_ranges_and_single_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = P.with_next(docs, range_bytes=3000).collect()
    ordered = sorted(rows, reverse=True)
    want = {d: ordered[(i + 1) % len(ordered)][1] or "" for i, (d, _) in enumerate(ordered)}
    assert {r.doc_id: r.next_t for r in pairs} == want and len(pairs) == len(rows)
    same(P.fingerprints(docs.where("doc_id = 10")), [r for r in rows if r[0] == 10])


def test_odd_and_empty_tables(spark, odd, empty):
    out = P.fingerprints(odd).collect()
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(r.doc_id) for r in odd.collect())
    assert P.fingerprints(empty).count() == 0


def test_differences_are_recovered_also_when_small_sketches_fail(spark):
    a, b = "array_distinct(transform(sequence(1, n), v -> xxhash64(v)))", "array_distinct(transform(sequence(n, 3 * n), v -> xxhash64(v)))"
    rows = spark.createDataFrame([(n,) for n in (1, 2, 15, 16, 17, 40, 100, 700)], "n int").select("n", F.expr(a).alias("a"), F.expr(b).alias("b"))
    rows = rows.select("*", F.expr(P.sketch("a")).alias("s"), F.expr(P.sketch("b")).alias("t"))
    both = F.expr(P.peeled("s", "t", "16")).alias("small"), F.expr(P.difference("s", "t")).alias("d"), F.expr(P.likeness("s", "t", "a", "b")).alias("l")
    for r in rows.select("n", "a", "b", *both).collect():
        assert set(r.d.one) == set(r.a) - set(r.b) and set(r.d.other) == set(r.b) - set(r.a)
        assert r.small is None or len(r.small.one) + len(r.small.other) == 3 * r.n - 1
        assert r.n < 40 or r.small is None
        assert abs(r.l - 1 / (3 * r.n)) < 1e-12


def test_likeness_follows_from_the_fingerprints(spark, docs):
    found = P.fingerprints(docs).select("*", F.expr(P.sketch_of("fingerprint")).alias("s"), F.expr(P.sketch_of("edited_fingerprint")).alias("t"))
    rows = found.select("doc_id", "near_edited", F.expr(P.likeness_of("s", "t")).alias("l")).collect()
    assert sum(r.l is None for r in rows) <= len(rows) // 10
    assert all(r.l is None or r.l == r.near_edited for r in rows)


def test_hot_and_null_ids_are_dealt_to_several_ranges(spark):
    rows = [(None if k % 3 else 7, f"Text {k}. It is. " * 5) for k in range(600)] + [(k, f"Other {k}.") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    d = df.select("doc_id", F.xxhash64("text").alias("h"))
    n = d.select(P._range(F.col("doc_id"), F.col("h"), [3, 7, 7, 7, 7, 200], 2, 12).alias("r"), "doc_id").groupBy("r").agg(F.count("*").alias("n")).collect()
    assert len(n) > 14 and max(r.n for r in n) < 200
    pairs = {}
    for r in P.with_next(df, range_bytes=2000).collect():
        pairs.setdefault((r.doc_id, r.t), []).append(r.next_t)
    assert sum(map(len, pairs.values())) == len(rows)
    followed = sorted(x for v in pairs.values() for x in v)
    assert followed == sorted(t for _, t in rows)  # a cycle: every text follows exactly one row


def test_the_plan_has_no_python(spark, docs):
    plan = P.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_of_one_line_in_any_script_are_near_their_edited_text(spark):
    sentence = {
        5: ("Some words {}.", " "), 4: ("some words {}!", " "), 3: ("Слова числа {}.", " "), 2: ("这是第{}句话。", ""), 1: ("هل هذا {}؟", " "), 0: ('He said "words {}."', " "),
    }
    rows = [(d, gap.join(s.format(chr(97 + k) * 3) for k in range(12))) for d, (s, gap) in sentence.items()]
    for r in same(P.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")), rows):
        assert 0.2 < r.near_edited < 0.8, r.doc_id
        assert r.near_next == 0
