import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrel.llm import substring_dedup as S

from .conftest import DOCUMENTS, words


def brute(rows):
    first, out = {}, []
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for i, w in docs:
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            first[key] = min(first.get(key, rank(i)), rank(i))
    for i, w in docs:
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < rank(i):
                gone |= set(range(a, a + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (49, 50, 51, 80, 130, 300)]
    rows = []
    for i in range(50):
        w = words(rng, rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) - 40))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : a + rng.randrange(40, 300)]
        rows.append((i * 3 % 50, " ".join(w) if i % 2 else " \t".join(w) + "\n"))
    rows += [(60, " ".join(["loop"] * 200)), (61, " ".join(["loop"] * 49)), (62, " ".join(["loop"] * 50)), (None, rows[5][1]), (None, " ".join(words(rng, 70))), (7, rows[8][1]), (7, rows[8][1]), (70, None), (71, "")]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = passages(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        for sizes in ({}, {"group_bytes": 3000, "bucket_bytes": 2000}):
            got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.digests(df, **sizes).collect()), key=repr)
            assert got == brute(rows)


def test_dedup_keeps_rows_and_columns(spark, docs, odd, empty):
    out = S.dedup(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    want = {r[0]: r for r in brute([(r.doc_id, r.text) for r in docs.collect()])}
    for before, after in zip(docs.orderBy("doc_id").collect(), out.orderBy("doc_id").collect(), strict=True):
        assert (before.lang, before.source) == (after.lang, after.source)
        if want[before.doc_id][2] == 0:
            assert before.text == after.text
        else:
            assert hashlib.sha256(after.text.encode()).hexdigest() == want[before.doc_id][3]
    assert sorted(map(repr, S.dedup(odd).collect())) == sorted(map(repr, odd.collect()))
    assert S.digests(empty).count() == 0 and S.dedup(empty).columns == empty.columns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_pack_round_trip(values):
    values = np.sort(np.array(values, np.uint32))
    assert S.unpack(S.pack(values)).tolist() == values.tolist()


def test_rolling_hash_tells_sequences_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    r = S.Rolling(S._WEAK)(h, 3)
    assert r[0] == r[3] and len(set(r.tolist())) == 4


def test_dedup_of_long_copies_leaves_the_smallest_id(spark):
    rng = random.Random(5)
    text = " ".join(words(rng, 20_000))
    df = spark.createDataFrame([(i, text, "en", "s", 1) for i in (4, 2, 9)], DOCUMENTS)
    assert {r.doc_id: len(r.text) for r in S.dedup(df).collect()} == {2: len(text), 4: 0, 9: 0}


def test_a_group_sends_each_digest_once_however_often_it_occurs():
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = [" ".join([*words(rng, 9), *passage, *words(rng, 9)]).encode() for _ in range(1000)]
    texts.append(" ".join(passage * 3).encode())
    table = pa.table({"doc_id": pa.array(range(1001), pa.int64()), "text": texts})
    hits = S.matches(0, S.probes(0, table, 1))
    rows = S.windows(0, table, hits, 1).to_pylist()
    (own,), (sent,) = [r for r in rows if r["bucket"] < 0], [r for r in rows if r["bucket"] >= 0]
    digests = np.frombuffer(sent["high"], np.uint64)
    assert len(digests) == len(set(digests.tolist())) < 27_000
    shared = 11  # windows inside the passage
    assert len(S.unpack(own["place"])) >= 999 * shared + 3 * shared  # the last document has it three times
    assert S.verdicts(0, pa.Table.from_pylist([sent], schema=S._WINDOWS)).num_rows == 0
