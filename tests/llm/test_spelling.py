import random
import re
import zlib
from collections import Counter

import pytest

from sparrel.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int, key int, root string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA)


def made(rows, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    """word -> form, root, n, n_near, form_n, by comparing every two words."""
    form, near = {}, {}
    for w, n in counts.items():
        found = [x for x in counts if one_edit(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, near[w], form[w] and counts[form[w]])
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def corpus(seed, letters, texts=40):
    """Words with misspelt copies of falling frequency, in texts with other characters between."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(30)]
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.append(rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :])))
    bag = [w for w in words for _ in range(rng.choice((1, 5, 6, 30, 160)))]
    rng.shuffle(bag)
    step = -(-len(bag) // texts)
    return [(k, rng.choice((" ", "\n", "9", "–")).join(rng.choice((w, w.upper(), w.title())) for w in bag[k * step : (k + 1) * step])) for k in range(texts)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aäéßÿ×÷öz"])
def test_against_every_two_words(spark, letters):
    rows = corpus(7, letters)
    assert found(spelling.variants(docs(spark, rows))) == brute(made(rows))


def test_runs_lose_a_letter(spark):
    rows = corpus(8, "abc")
    assert made(rows, 3) != made(rows)
    assert found(spelling.variants(docs(spark, rows), every=3)) == brute(made(rows, 3))


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_split_buckets_lose_no_pair(spark, bucket):
    rng = random.Random(9)
    words = sorted({"x" * 4 + "".join(rng.choice("ab") for _ in range(rng.randrange(3, 8))) + "y" * 3 for _ in range(250)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaaa"})
    vocabulary = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(words)], "word string, n bigint")
    got = [tuple(r) for r in spelling.near_words(vocabulary, bucket).select("x", "y").collect()]
    key = lambda w: (len(w), w.encode())
    want = {(a, b) for a in words for b in words if key(a) < key(b) and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_half_does_not_meet_in_pairs(spark):
    """2,000 words that share their first half: what meets stays far below all pairs."""
    rng = random.Random(10)
    words = {"common" + "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)}
    entries = spelling._split(spelling._entries(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")))
    for _ in range(2):
        hot = entries.where("indexed and b - a > 1").groupBy("key").count().where("count > 32").select("key").cache()
        entries = spelling._split(entries.join(hot, "key", "left_semi"))
    index, probe = entries.where("indexed").select("key"), entries.where("not indexed").select("key")
    assert index.join(probe, "key").count() < 2000 * 40


def test_chains_of_forms(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zzzzzz": 5}
    rows = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    table = found(spelling.variants(docs(spark, rows), every=1 << 40))
    assert table == brute(counts)
    assert table["aaaaaa"] == ("aaaaab", "aabbbb", 5, 1, 25) and table["zzzzzz"] == (None, "zzzzzz", 5, 0, None)


def test_ties_go_by_code_point(spark):
    counts = {"aaaaax": 5, "aaaaaz": 25, "aaaaaÿ": 25, "aaaaaé": 25}
    rows = [(None, " ".join(w for w, n in counts.items() for _ in range(n))), (3, None), (3, None), (4, ""), (5, "short 12345 --")]
    assert found(spelling.variants(docs(spark, rows), every=1 << 40))["aaaaax"][0] == "aaaaaz"
    assert found(spelling.variants(docs(spark, rows))) == brute(made(rows))


def test_odd_input(spark):
    long = "q" * 40_000
    rows = [(k, f"{long} {long}q {long[1:]}w") for k in range(6)] + [(1, "Repeat Repeat repeat")] * 2
    assert found(spelling.variants(docs(spark, rows))) == brute(made(rows))
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, "few words")])).collect() == []
