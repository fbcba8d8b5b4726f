import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrel.llm import bpe

TEXT = st.text(st.one_of(st.sampled_from(list("aab  \n\t'stdlmrve<|>.,!-0²ⅷ١éß漢🎉\x1c\x85\xa0")), st.characters(codec="utf-8")), max_size=40)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.RANKS_PATH)


@pytest.fixture(scope="module")
def library():
    with open(bpe.RANKS_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_ids_are_the_librarys_and_decode_to_the_text(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=TEXT, more=TEXT, at=st.integers(0, 40), size=st.integers(0, 10))
def test_edits_and_appends_match_a_new_encoding(codec, library, text, more, at, size):
    edited = bpe.EditableText(codec, text)
    a = min(at, len(text))
    edited.edit(a, min(len(text), a + size), more)
    edited.append(more)
    assert edited.text == text[:a] + more + text[min(len(text), a + size) :] + more
    assert edited.ids() == library.encode_ordinary(edited.text)


def test_an_edit_encodes_only_pieces_near_it(codec):
    text = bpe.EditableText(codec, "some words of prose " * 500)
    text.edit(5000, 5003, "xyz")
    assert text.reencoded < 12


def test_prefix_table_gives_the_encoding_of_every_prefix(codec):
    piece = b"unbelievableness"
    table = bpe.PrefixTable(codec.bpe, piece[:5])
    table.append(piece[5:])
    for n in range(1, len(piece) + 1):
        fresh = bpe.PrefixTable(codec.bpe, piece[:n])
        assert table.ids(n) == fresh.ids()
        assert codec.decode(table.ids(n)) == piece[:n]
    table.edit(3, 6, b"zz")
    assert table.ids() == bpe.PrefixTable(codec.bpe, piece[:3] + b"zz" + piece[6:]).ids()


def test_digests_of_a_table(spark, docs, library):
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip_digests(docs).collect():
        ids = library.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_long_texts_are_encoded_in_blocks(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 3)
    text = "a long text, of many words and  spaces\n\n" * 9
    ids = library.encode_ordinary(text)
    assert codec.encode(text) == ids
    assert codec.digests(text)[:2] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_odd_and_empty_tables(spark, odd, empty):
    out = bpe.round_trip_digests(odd).collect()
    assert len(out) == 7 and sum(r.doc_id is None for r in out) == 2
    assert {r.n_tokens for r in out if r.doc_id in (4, 5)} == {0}
    assert bpe.round_trip_digests(empty).count() == 0
    assert [bytes(r.content) for r in bpe.decode(bpe.encode(odd.where("doc_id = 3"))).collect()] == [b"same same"] * 2
