import random

import numpy as np

from sparrel.llm import common, jaccard_join as J
from sparrel.llm.components import connected_components

from .conftest import words


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    linked = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == label:
            break
        label = new
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None] if sets[i] else [doc_id]
        out.append((doc_id, min(ids) if ids and ids[0] is not None else None, sum(linked[i])))
    return sorted(out, key=repr)


def near_copies(seed, n=60, size=60):
    rng = random.Random(seed)
    base = words(rng, size)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(("edit", "other"))
        rows.append((i, " ".join(w)))
    return rows


def result(df, **sizes):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in J.join(df, **sizes).collect()), key=repr)


def test_against_brute_force(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in near_copies(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df) == brute(rows)
    assert result(df, part_nodes=7, group_bytes=2000) == brute(rows)  # components in several parts
    assert result(df, bucket_nodes=3) == brute(rows)  # buckets in several parts
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_short_texts_are_compared_as_a_whole(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a c"), (4, "a b c d e"), (5, "a b c d e"), (6, None), (7, " ")]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_one_of_each_class_stays(spark, docs, odd, empty):
    want = {c if c is not None else d for d, c, _ in brute([(r.doc_id, r.text) for r in docs.collect()])}
    out = J.one_of_each(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((repr(r.doc_id), r.text) for r in kept.where("text <> ''").collect()) in ([("-7", "a b c d e f g"), ("3", "same same")], [("3", "same same"), ("None", "a b c d e f g")])
    assert J.join(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_a_pair_at_the_threshold_is_hardly_ever_dropped():
    from math import comb

    p = 0.8 + 0.2 / 256
    lost = sum(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(J.least_matches(n))) for n in (8, 16, 24, 32))
    assert lost < 1e-4
    assert (1 - 0.8**J.BAND_ROWS) ** J.BANDS < 1e-8
    assert J.least_matches(32) > J.least_matches(16) > J.least_matches(8) >= 0


def test_minhash_values_estimate_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    share = (J.minhashes(a) == J.minhashes(np.concatenate((a[:850], b)))).mean()
    assert abs(share - 850 / 1000) < 0.15


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_checkpoint_folder_is_the_sessions(spark):
    assert common.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_large_bucket_is_dealt_out(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    t = np.zeros((6, n + 4), np.int64)
    t[0, n:] = (1, 1, 2, 3)
    t[1], t[2:] = np.arange(n + 4), rng.integers(0, 1 << 62, (4, n + 4))
    t[2:, n] = t[2:, n + 1]
    batches = [J.pa.RecordBatch.from_arrays([J.pa.array(c) for c in t[:, i : i + 1000]], names=["bucket", "node", "s0", "s1", "s2", "s3"]) for i in range(0, n + 4, 1000)]
    out = J.pa.Table.from_batches(J._bucket_stream(iter(batches), 512)).to_pylist()
    large, edges = [r for r in out if r["bucket"] is not None], [r for r in out if r["bucket"] is None]
    assert sorted(r["a"] for r in large) == list(range(n)) and [(r["a"], r["b"]) for r in edges] == [(n + 1, n)]
    sizes = np.bincount([r["part"] for r in large])
    assert sizes.max() <= 512 and len(sizes) == -(-n // 512)


def test_equal_ids_and_columns_that_clash(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "mine", 1), (1, "quite other words are in this one", "mine", 2), (2, text, "mine", 3), (None, text, "mine", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _no_id string, row int")
    assert sorted(tuple(r) for r in J.one_of_each(df).collect()) == sorted(rows[:2])


def test_parts_are_bounded_by_bytes(spark):
    rng = random.Random(7)
    base = words(rng, 400)
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(12)]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string"), group_bytes=6000) == brute(rows)
