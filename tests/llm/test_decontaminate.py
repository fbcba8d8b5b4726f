import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sparrel.llm import decontaminate as D

from .conftest import words


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w = D.words_of((text or "").encode())
        hit, found = set(), set()
        for item, t in items:
            x = D.words_of((t or "").encode())
            for win in D.windows_of(x):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found |= {str(item)} - {'None'}
        out.setdefault(doc_id, []).append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


def case(seed=3):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 300))) for i, n in enumerate((1, 4, 13, 14, 40, 40))] + [(6, None), (7, "  ?! "), (None, "lost item"), (8, "Mixed CASE, with-punctuation ünï 12")]
    docs = []
    for d in range(40):
        w = words(rng, rng.randrange(120), 300)
        if d % 3 == 0:
            x = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(x))
            w[len(w) // 2 : len(w) // 2] = x[a:] if d % 2 else [t.upper() for t in x]
        docs.append((d, " ".join(w)))
    docs += [(40, None), (41, ""), (None, items[4][1]), (None, items[4][1]), (42, "mixed case with punctuation ünï 12 " * 3)]
    return docs, items


def check(found, docs, items):
    want, got = brute(docs, items), {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_against_brute_force_with_broadcast_and_with_salted_joins(spark, monkeypatch):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    check(D.judged(D.search(d, b)), docs, items)
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(D, "FILTER_BITS", 1 << 10)
    check(D.judged(D.search(d, b)), docs, items)
    dirty = [d for d, rows in brute(docs, items).items() for r in rows if r[4]]
    for size in (1 << 20, -1):
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        kept = [r.doc_id for r in D.clean(d, b).collect()]
        assert len(kept) + len(dirty) == len(docs) and not set(kept) & set(dirty)


def test_odd_and_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    assert D.judged(D.search(empty, some)).count() == 0
    assert [r.n_hit for r in D.judged(D.search(odd, none)).collect()] == [0] * 7
    assert sorted(r.n_hit for r in D.judged(D.search(odd, some)).collect()) == [0, 0, 0, 0, 3, 3, 3]
    assert D.clean(odd, some).columns == odd.columns and D.clean(odd, some).count() == 4 and D.clean(odd, none).count() == 7


def test_the_prefix_is_the_rarest_shingle(spark):
    b = spark.createDataFrame([(1, "common one two rare x y"), (2, "never seen here")], "item_id bigint, text string")
    wins = D.windows(b).drop("item").dropDuplicates(["win"])
    docs = spark.createDataFrame([("common one two",), ("common one two rare x",), ("rare x y",), ("a one two rare common one two",)], "text string").select(F.col("text").cast("binary"))
    frequency = D.document_frequency(docs, D.Filter(wins.select(F.explode("shingles").alias("h")).distinct()), [3])
    hashes = {r.shingle: r.df for r in frequency.collect()}
    words = b"common one two rare x y".split()
    each = [hashes.get(int(h), 0) for h in D.shingles(words, 3).view("i8")]
    assert each == [3, 2, 1, 1]
    (found,) = D.prefixes(wins, frequency).collect()  # the other item's shingle is in no document
    assert found.win == "common one two rare x y" and found.place in (2, 3)


def test_columns_that_clash_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d", "mine", 5, 6), (2, "x y", "mine", 7, 8)], "doc_id bigint, text string, _row string, k1 int, salt int")
    b = spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    assert [tuple(r) for r in D.clean(docs, b).collect()] == [(2, "x y", "mine", 7, 8)]


def test_a_larger_benchmark_with_one_hot_passage(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, 60))) for k in range(300)]
    docs = [(k, " ".join(words(rng, 20)) + " " + items[5][1]) for k in range(500)] + [(600, items[7][1][:200])]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {r.doc_id: (r.n_hit, r.n_items) for r in D.judged(D.search(d, b)).collect()}
    assert all(found[k] == (60, 1) for k in range(500)) and found[600][1] == 1


def size_of(spark, path):
    from pathlib import Path

    return sum(f.stat().st_size for f in Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_an_item_of_one_frequent_word_costs_less_than_the_text(spark, monkeypatch):
    """Every second word of the text is an item; another of two words and one of four are frequent too."""
    rng = random.Random(10)
    docs = [(k, " ".join(w for x in words(rng, 10_000) for w in ("the", x))) for k in range(20)] + [(30, "of the of the " * 5000)]
    items = [(1, "the"), (2, "of the"), (3, "of the of the"), (4, "of the of the of the of the of the of the of")]
    made, written = [], D.common.written

    def seen(df, label):
        out = written(df, label)
        if label.startswith("decontaminate-"):
            made.append(size_of(spark, out.inputFiles()[0].rpartition("/")[0]) if out.inputFiles() else 0)
        return out

    monkeypatch.setattr(D.common, "written", seen)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {r.doc_id: r for r in D.judged(D.search(d, b)).collect()}
    assert all((found[k].n_words, found[k].n_hit, found[k].n_items) == (20_000, 10_000, 1) for k in range(20))
    assert (found[30].n_words, found[30].n_hit, found[30].n_items) == (20_000, 20_000, 4)
    text = sum(len(t) for _, t in docs)
    assert sum(made) < text / 2  # the spans of the hits themselves, which are the result, are most of it
    assert sum(made) - made[-1] < text / 20


def test_short_and_long_items_side_by_side(spark):
    """Items of one to fourteen words over few words, so that windows overlap, repeat and share their shingles."""
    rng = random.Random(11)
    for n in range(6):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 4, 5, 12, 13, 14))))) for k in range(6)]
        docs = [(k, " ".join(rng.choice("abcd" if k % 2 else "abc") for _ in range(rng.randrange(60)))) for k in range(25)] + [(90, items[0][1])] * 2
        d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        check(D.judged(D.search(d, b)), docs, items)


def test_texts_hashed_together_keep_their_own_shingles(monkeypatch):
    texts = [None, b"", b"a", b"A b", b"a b c", b"d", b"a b c d a b c", b" ".join(b"w%d" % k for k in range(40)), b"c d"]
    calls = []
    real = D.word_hashes
    monkeypatch.setattr(D, "word_hashes", lambda words: calls.append(len(words)) or real(words))

    class Every:
        def __call__(self, hashes):
            return np.ones(len(hashes), bool)

    for size in (1, 5, 1000):
        monkeypatch.setattr(D, "GROUP_WORDS", size)
        for k in (1, 2, 3):
            found = []
            for first, group in D.grouped(texts):
                found += [(first + t, p, h) for t, p, h in zip(*(x.tolist() for x in D.Shingled(group).found(k, Every())[0]), strict=True)]
            alone = [D.shingles(D.words_of(t), k).tolist() for t in texts]
            assert found == [(t, p, h) for t, hashes in enumerate(alone) for p, h in enumerate(hashes)]
    calls.clear()
    list(map(lambda g: D.Shingled(g[1]), D.grouped(texts)))
    assert len(calls) == 1  # one call for all texts and sizes
