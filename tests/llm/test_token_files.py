"""op1: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mnemoframe.llm import idcoder, token_files as t
from mnemoframe.llm.token_counts import public_vocabulary
from mnemoframe.scratch import new_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_vocabulary())


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n).clip(max=50000) for n in (4096, 100, 1, 2, 3000)]
    blocks += [np.full(4096, 7), np.arange(4096)[::-1], np.tile(np.arange(50), 80), np.array([2**32 - 1, 0, 2**31])]
    for want, got in zip(blocks, idcoder.decode_blocks(idcoder.encode_blocks(blocks)), strict=True):
        assert np.array_equal(want.astype(np.uint32), got)
    assert len(idcoder.encode_blocks([np.full(4096, 7)])[0]) < 100  # it learns


def test_any_block_round_trips():
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), min_size=1, max_size=300), min_size=1, max_size=5))
    def same(blocks):
        for want, got in zip(blocks, idcoder.decode_blocks(idcoder.encode_blocks([np.array(b, np.uint64) for b in blocks])), strict=True):
            assert want == got.tolist()

    same()


def test_damage_is_found():
    (data,) = idcoder.encode_blocks([np.arange(1000) % 37])
    broken = 0
    for at in range(20, len(data), 7):
        bad = bytearray(data)
        bad[at] ^= 1
        try:
            (ids,) = idcoder.decode_blocks([bytes(bad)])
            assert np.array_equal(ids, np.arange(1000) % 37)  # a bit that no id depends on
        except ValueError:
            broken += 1
    assert broken > len(range(20, len(data), 7)) // 2
    with pytest.raises(ValueError):
        idcoder.decode_blocks([data[:-1]])


def test_words_give_the_library_ids(library):
    texts = [None, "", " ", "a b", "a  b", "x\n y", " lead", "trail ", "<|endoftext|> a<|endoftext|>b", "don't stop 's", "漢字 かな é", "a\tb c", "# \" #"]
    for x, ids, same in zip(texts, t.Encoder(public_vocabulary()).encode(texts), t.public_encoder().encode(texts), strict=True):
        assert ids == same and np.frombuffer(ids, "<u4").tolist() == library.encode(x or "", add_special_tokens=False).ids


def test_other_vocabularies_are_asked_for_whole_texts():
    path = public_vocabulary().replace("byte_bpe_50k", "word_bpe_49k")
    texts = ["Two  words", None, "Don't  stop,\nnow ", "a b"]
    library = Tokenizer.from_file(path)
    encoder = t.Encoder(path)
    assert not encoder.by_words and t.Encoder(public_vocabulary()).by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_forgotten_words_are_asked_again(library, monkeypatch):
    monkeypatch.setattr(t, "_REMEMBERED", 5)
    encoder = t.Encoder(public_vocabulary())
    texts = [" ".join(f"w{(7 * i + j) % 23}" for j in range(6)) for i in range(30)]
    for k in range(0, 30, 2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[k : k + 2])] == [library.encode(x, add_special_tokens=False).ids for x in texts[k : k + 2]]


@pytest.mark.parametrize("make", [lambda: t.Encoder(public_vocabulary()), t.public_encoder])
def test_any_texts_give_the_library_ids(library, make):
    encoder = make()

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sd.a1é漢<|"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=50), max_size=4))
    def same(xs):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(xs)] == [library.encode(x, add_special_tokens=False).ids for x in xs]

    same()


def expected(docs, library):
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, small, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert sorted(tuple(r) for r in t.op1_token_files(spark, small).collect()) == expected(docs, library)


def test_nulls_repeats_long_and_empty(spark, library):
    docs = [(3, "one two"), (1, None), (3, "one two"), (2, "w " * 200_000), (None, "x"), (2, "")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, ids long")
    path = new_path(spark, "test")
    t.write_tokens(df, path, public_vocabulary)
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    got = t.read_tokens(spark, path).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((str(x[0]), *x[1:]) for x in expected(ordered, library))
    assert all(len(r["ids"]) == r.n_tokens and r["ids"][-1] == 2 for r in got)
    path = new_path(spark, "test")
    t.write_tokens(df.limit(0), path, public_vocabulary)
    assert t.read_tokens(spark, path).count() == 0


def test_the_whole_library_is_asked_for_first_words_and_other_scripts_only(library):
    encoder = t.Encoder(public_vocabulary())
    texts = ["One two, don't (four) 5x.\nsix élan Straße** 漢字 a<|endoftext|>b", "two One six\x1c seven"]
    asked = []
    whole = encoder._ask
    encoder._ask = lambda words: asked.extend(words) or whole(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert sorted(w.strip(" ") for w in asked) == sorted(["One", "two", "漢字", "a<|endoftext|>b", "six\x1c"])


def test_a_prediction_that_never_holds_costs_no_more_than_order_0():
    # weights fall to nothing where what followed last never follows again; then ids are coded by their counts
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.permutation(64) for _ in range(64)])
    (data,) = idcoder.encode_blocks([ids])
    assert np.array_equal(idcoder.decode_blocks([data])[0], ids) and len(data) < 4096 * 6.6 / 8
