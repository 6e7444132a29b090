"""Scores of the automaton against the recursive definition of the smoothed probabilities."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from mnemoframe.llm import lm_scores as x
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, learned int, chunk string, score double"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def direct(docs, learned, order, prior):
    grams, n = Counter(), 0
    for d, t in docs:
        if d is not None and learned(d):
            seq = ["<s>", *words(t), "</s>"]
            n += len(seq) - 1
            grams.update(tuple(seq[i : i + k]) for k in range(1, order + 1) for i in range(len(seq) - k + 1))
    v = sum(len(g) == 1 and g != ("<s>",) for g in grams)

    def p(context, w):
        if not context:
            return (grams[w,] + 1) / (n + v + 1)
        return (grams[(*context, w)] + prior * p(context[1:], w)) / (grams[context] + prior)

    out = []
    for d, t in docs:
        seq = ["<s>", *words(t), "</s>"]
        scored = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10((grams[w,] + 1) / (n + v + 1)) for w in seq[1:])
        out.append((d, d is not None and not learned(d), len(seq) - 1, sum(grams[w,] > 0 for w in seq[1:]), n, base, scored))
    return sorted(out, key=str)


def same(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_definition(spark, order, monkeypatch):
    monkeypatch.setattr(x, "CHUNK_BYTES", [10**7, 2000, 300][order - 1])
    monkeypatch.setattr(x, "STRETCH_ENTRIES", [100, 10**7, 50][order - 1])
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["the", "THE", "ÀB", "àb", f"w{rng.randrange(30)}", f"{rng.randrange(900)}"]) for _ in range(rng.choice([0, 1, 7, 60])))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " \n\t"), (None, "the w1 w2"), (None, None), (5, docs[5][1]), (5, docs[5][1]), (5, "other"), (503, "the w1 " * 5000), (504, "z" * 600_000)]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in docs], DOCS).repartition(3)
    got = x.score(df, ~x.held_out(), order, 3.0).collect()
    same(got, direct(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2, order, 3.0))


def test_probabilities_add_up_to_one(spark):
    docs = [(1, "a b a b c"), (2, "b a")]
    probes = [(10 + i, w) for i, w in enumerate(["a", "b", "c", "never"])]
    df = spark.createDataFrame(docs + probes, "doc_id long, text string")
    got = {r.doc_id: r for r in x.score(df, F.col("doc_id") < 10, 2, 5.0).collect()}
    end = direct(docs + probes, lambda d: d < 10, 2, 5.0)
    assert end[0][4] == got[1].train_tokens == 9
    grams = {"a": 3, "b": 3, "c": 1, "</s>": 2}
    lower = {w: (n + 1) / (9 + 4 + 1) for w, n in grams.items()} | {"<unk>": 1 / 14}
    assert sum(lower.values()) == pytest.approx(1)
    first = {"a": 1, "b": 1}  # what follows the start
    assert sum((first.get(w, 0) + 5 * p) / (2 + 5) for w, p in lower.items()) == pytest.approx(1)
    same(got.values(), end)


def test_nothing_learned_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in x.score(df, F.lit(False)).collect()) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert x.score(df.limit(0), ~x.held_out()).count() == 0


def test_query_over_the_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = x.op12_lm_scores(spark, small).collect()
    same(got, direct(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2, x.ORDER, x.PRIOR))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
