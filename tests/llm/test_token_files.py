import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrel.llm import common, token_files


def library():
    return Tokenizer.from_file(token_files.TOKENIZER_PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.booleans())
def test_elias_fano_round_trip_and_select(values, dense):
    values = np.sort(np.array([v % 50 if dense else v for v in values], np.uint64))
    coded, end = token_files.EliasFano.load(memoryview(token_files.EliasFano.of(values).dump()), 0)
    assert end == len(token_files.EliasFano.of(values).dump())
    assert coded.values().tolist() == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000)).astype(np.uint64)
    bits = 8 * len(token_files.EliasFano.of(values).dump()) / len(values)
    assert bits <= 2 + np.ceil(np.log2(values[-1] / len(values))) + 0.1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("aab  \n\t'stdlmrve<|>.,!-0²ⅷ١éß漢🎉\x1c\x85\xa0\0")), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=5), st.integers(3, 60))
def test_ids_are_the_librarys(texts, chunk):
    encoder, kept = token_files.encoder(token_files.TOKENIZER_PATH), token_files.CHUNK_CHARS
    token_files.CHUNK_CHARS = chunk
    try:
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    finally:
        token_files.CHUNK_CHARS = kept
    assert got == [encoder.library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def brute(rows):
    t, start, out = library(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(spark, df, **sizes):
    path = common.shared_dir(spark, "test-tokens")
    token_files.write(df, path, **sizes)
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, path).collect()), key=lambda r: r[1]), path


def test_files_against_brute_force(spark, docs):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for size in (1 << 30, 20_000):
        assert result(spark, docs.repartition(5), file_text_bytes=size)[0] == want


def test_random_access_by_document(spark, docs):
    _, path = result(spark, docs)
    content = bytes(spark.read.format("binaryFile").load(f"{path}/ids").first().content)
    file, t = token_files.TokenFile(content), library()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, doc_id in enumerate(file.doc_ids()):
        assert file.document(i).tolist() == t.encode(texts[doc_id], add_special_tokens=False).ids + [0]


def test_odd_and_empty_tables(spark, odd, empty):
    assert result(spark, odd)[0] == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert result(spark, empty)[0] == []


ADDED = "<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.just(ADDED), st.sampled_from([ADDED[:-1], ADDED[1:], "<|", " ", "  ", "\n ", "'s", "\0"]), st.text("ab 1'\n<|>é", max_size=6)), max_size=8).map("".join), min_size=1, max_size=4), st.integers(3, 60))
def test_added_tokens_have_their_own_ids(texts, chunk):
    untouched, encoder, kept = Tokenizer.from_file(token_files.TOKENIZER_PATH), token_files.encoder(token_files.TOKENIZER_PATH), token_files.CHUNK_CHARS
    token_files.CHUNK_CHARS = chunk
    try:
        got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    finally:
        token_files.CHUNK_CHARS = kept
    assert got == [untouched.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_files_with_added_tokens(spark):
    rows = [(1, f"x{ADDED}"), (2, ADDED), (3, f"a b {ADDED} {ADDED}{ADDED}\n\n{ADDED}s"), (4, "after")]
    untouched, start, want = Tokenizer.from_file(token_files.TOKENIZER_PATH), 0, []
    assert untouched.encode(rows[0][1], add_special_tokens=False).ids == [87, 50256]
    for doc_id, text in rows:
        ids = untouched.encode(text, add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert result(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))[0] == want


def test_null_and_equal_ids_fill_several_files(spark):
    rows = [(None if k % 2 else 5, f"text number {k} " * 20) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = common.shared_dir(spark, "test-tokens")
    manifest = token_files.write(df, path, file_text_bytes=15_000).collect()
    assert len(manifest) >= 6 and max(r.docs for r in manifest) < 200
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + [5] * 200
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    t = library()
    ids = lambda text: zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(ids(text) for _, text in rows)


def test_a_chunk_with_colliding_hashes_is_encoded_whole(monkeypatch):
    encoder = token_files.Encoder(token_files.TOKENIZER_PATH)
    monkeypatch.setattr(token_files.pretokenize, "hashes", lambda points, starts, stops: (np.zeros(len(starts), np.uint64), np.arange(len(starts)).astype(np.uint64)))
    texts = ["one two  three's", "", "four <|endoftext|> five"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
