import hashlib
import random

import corpus_pipeline as C
from sparrel.llm import bpe, common, queries
from sparrel.llm import language_id as L

from .conftest import DOCUMENTS, corpus, words
from .test_decontaminate import brute as contamination
from .test_jaccard_join import brute as classes
from .test_substring_dedup import brute as repeats


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 20))) for i in range(4)]
    rows = corpus(11, 90) + [(200 + i, " ".join(words(rng, 30)) + " " + items[i % 4][1], "en", "s", 1) for i in range(8)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")

    known = {r.doc_id for r in L.predict(docs, L.fit(docs)).collect() if r.lang_pred != L.UNKNOWN and r.score >= L.LEAST_SCORE}
    kept = [(r[0], r[1]) for r in rows if r[0] in known]
    assert 0 < len(kept) < len(rows)
    first = {c for _, c, _ in classes(kept)}
    kept = sorted(r for r in kept if r[0] in first)
    gone = {r[0]: r for r in repeats(kept)}
    texts = []
    for doc_id, text in kept:
        if gone[doc_id][2]:
            text = next(r.text for r in C.repeated_passages(spark, spark.createDataFrame([(a, b, "", "", 0) for a, b in kept], DOCUMENTS), "").where(f"doc_id = {doc_id}").collect())
            assert hashlib.sha256(text.encode()).hexdigest() == gone[doc_id][3]
        texts.append((doc_id, text))
    dirty = {d for d, found in contamination(texts, items).items() if found[0][4]}
    assert dirty
    codec = bpe.codec(bpe.RANKS_PATH)
    want = sorted((d, *codec.digests(t)) for d, t in texts if d not in dirty)

    got = sorted(tuple(r) for r in C.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_stages_keep_the_columns_and_take_odd_tables(spark, tmp_path, odd, empty):
    spark.createDataFrame([(1, "b c d")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, empty):
        docs = table
        for name, stage in C.STAGES:
            docs = common.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
            if name != C.STAGES[-1][0]:
                assert docs.columns == table.columns
        docs.count()


def test_stages_and_queries_are_complete():
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_passages", "tokens"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
