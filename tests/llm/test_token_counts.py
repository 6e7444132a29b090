"""op10 against the library."""

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mnemoframe.llm import token_counts as t
from pyspark.sql import functions as F

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n\n x", "don't I'LL we've 's", "<|endoftext|>", "x<|endoftext|>y", " <|endoftext|> z <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50,
    "éà ñ ß 漢字 かな 한국어", " x y", "١٢٣ ½ ⅷ", "🙂🙃 👩‍👩‍👧", "tab\tsep\r\nline", "﻿bom", "á", "x　y  z", "__init__ == 3.14e-10;", "A1B2c3",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(t.public_vocabulary())


@pytest.fixture(scope="module")
def counter():
    return t.PairCounter(t.public_vocabulary())


def test_odd_texts(library, counter):
    for x in ODD:
        assert counter.count(x) == len(library.encode(x, add_special_tokens=False).ids), x


def test_any_text(library, counter):
    @settings(max_examples=400, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(" \n\t'setd.a1é漢"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
    def same(x):
        assert counter.count(x) == len(library.encode(x, add_special_tokens=False).ids)

    same()


def test_query_equals_the_library(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = t.op10_token_counts(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        x = docs[r.doc_id] or ""
        n = len(library.encode(x, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), n, n > 512)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "a b", 9), (2, "a b", 9)], "doc_id long, text string, n_tokens long").withColumn("n_bytes", F.lit("x"))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in t.token_counts(df, t.public_vocabulary).collect()) == [("1", 0, 0), ("2", 3, 2), ("2", 3, 2), ("None", 0, 0)]
    assert t.token_counts(df.limit(0), t.public_vocabulary).count() == 0
    with pytest.raises(ValueError):
        t.PairCounter(t.public_vocabulary().replace("byte_bpe_50k", "word_bpe_49k"))
