import hashlib
import random
import re
import zlib

import pytest

from sparrel.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, leaf int, part int, path string, pos int, tag int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", 3, 4) for r in rows], SCHEMA)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[k : k + 8])) for k in range(0, len(now), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append((i - run, [d for k, d in enumerate(level[run : run + 8], run) if k != i]))
        i //= 8
    return out


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = tree([leaf(*r) for r in by_lang[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            path = siblings(trees[lang], i) + siblings(top, g)
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                shown = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            node = leaf(*shown)
            for k, s in path:
                node = H("".join([*s[:k], node, *s[k:]]))
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[lang][-1][0], root, H("".join("".join(s) for _, s in path)), node, node == root))
    return sorted(out, key=repr)


def audited(spark, rows, **options):
    return sorted((tuple(r) for r in merkle.audited(docs(spark, rows), **options).collect()), key=repr)


def table(n, langs, seed=5):
    rng = random.Random(seed)
    return [(k, rng.choice(("web", None, "bücher")), rng.choice(langs), rng.choice((k, None)), rng.choice((f"Text {k}", None, "", "ÄA:b-", "lower"))) for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 73, 513, 700])
def test_one_tree(spark, n):
    rows = table(n, ["en"])
    assert audited(spark, rows, range_rows=100) == brute(rows)


@pytest.mark.parametrize("range_rows", [3, 50, 10_000])
def test_ranges_do_not_change_the_result(spark, range_rows):
    rows = table(300, [None, "", "=", "de", "en", "en", "en", "zz\U0001f600", "z￿"])
    assert audited(spark, rows, range_rows=range_rows) == brute(rows)


def test_many_trees(spark):
    rows = table(150, [f"l{k}" for k in range(90)])
    assert audited(spark, rows, range_rows=20) == brute(rows)


def test_odd_input(spark):
    rows = [(None, None, None, None, None)] * 3 + [(4, "s", "en", 1, "Same")] * 40 + [(4, "s", "en", 1, "Other")] * 2 + [(None, "s", "en", 2, "X" * 300_000), (9, "", "", 0, "")]
    assert audited(spark, rows, range_rows=4) == brute(rows)
    assert audited(spark, []) == []


def test_repeated_rows_do_not_overfill_a_range(spark):
    built = merkle.build(merkle.documents_manifest(docs(spark, [(4, "s", "en", 1, "Same")] * 2000)), ["doc_id"], 200)
    sizes = [r["count"] for r in built.rows.groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 600


def test_forests_merge_in_any_order():
    rng, n = random.Random(6), 700
    leaves = {(0, k): hashlib.sha256(str(k).encode()).digest() for k in range(n)}
    for _ in range(20):
        parts = [{} for _ in range(12)]
        for k, d in leaves.items():
            rng.choice(parts)[k] = d
        parts = [merkle.resolved(p, n) for p in parts]
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            parts.append(merkle.resolved(a | b, n))
        assert parts[0] == merkle.resolved(leaves, n) and len(parts[0]) == 1
    assert merkle.resolved({}, 5) == {} and len(merkle.resolved({k: leaves[k] for k in list(leaves)[100:600]}, n)) < 40


def test_a_proof_shows_a_changed_text(spark):
    rows = [(k, "s", "en", 1, f"Text {k}") for k in range(30)]
    got = {r.doc_id: r.verified for r in merkle.audited(docs(spark, rows)).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 != 0 for k in range(30)} and not all(got.values())
