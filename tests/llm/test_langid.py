"""op4: accuracy on held-out documents, and every score against a loop."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import langid

DOCS = "doc_id long, text string, lang string"


def rest(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def brute(docs):
    """Predictions by the rule, with dictionaries, in the order of ``docs``."""
    counts, learned = {}, [d for d in docs if d[0] is not None and d[1] is not None and d[2] is not None and rest(d[0])]
    for _, text, lang in learned:
        for w in langid.words(text):
            w = w.decode()
            counts.setdefault(lang, [Counter() for _ in range(5)])[0][w] += 1
            padded = f"^{w}$"
            for n in range(1, 5):
                for i in range(len(padded) - n + 1):
                    counts[lang][n][padded[i : i + n]] += 1
    langs = sorted(counts)
    totals = {x: [sum(c.values()) for c in counts[x]] for x in langs}
    log = lambda x, n, gram: math.log((counts[x][n][gram] + 0.5) / (totals[x][n] + 0.5))
    known = [{g for x in langs for g in counts[x][n]} for n in range(5)]

    def vector(w):
        if w in known[0]:
            return [log(x, 0, w) for x in langs]
        padded, found = f"^{w}$", []
        for i in range(len(padded)):
            for n in range(4, 0, -1):
                if i + n <= len(padded) and padded[i : i + n] in known[n]:
                    found.append([log(x, n, padded[i : i + n]) for x in langs])
                    break
        return [sum(c) / len(found) for c in zip(*found)] if found else [0.0] * len(langs)

    out = []
    for doc_id, text, _ in docs:
        if not langs or not text or not any(c.isalpha() for c in text):
            out.append((doc_id, "und", 0.0))
            continue
        total = [sum(c) for c in zip(*(vector(w.decode()) for w in langid.words(text)))]
        best = max(total)
        out.append((doc_id, langs[total.index(best)], 1 / sum(math.exp(t - best) for t in total)))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[2] == pytest.approx(w[2], abs=1e-6) and (g[1] == w[1] or w[2] < 0.5 + 1e-6), (g, w)


def corpus(seed):
    rng = random.Random(seed)
    letters = {"aa": "abcdef", "bb": "cdefgh", "th": "กขคงจฉชซ", "zz": "àéxyz"}
    stock = {x: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 7))) for _ in range(60)] for x, s in letters.items()}
    docs = []
    for i in range(120):
        x = rng.choice(list(letters))
        n = rng.randrange(1, 30)
        parts = [rng.choice(stock[x]) if rng.random() < 0.8 else "".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(n)]
        docs.append((i, ("" if x == "th" else " ").join(parts), x if rng.random() < 0.9 else None))
    return docs + [(None, "abc def", "aa"), (200, None, "aa"), (201, "", "bb"), (202, "12 !", "bb"), (203, "ж", "aa"), (204, "b" * 1500 + " c", "bb"), (209, "a" * 1200, None), (7, "other text of seven", None)]


@pytest.mark.parametrize(("entries", "broadcast"), [(400_000, 1_000_000), (20, 1_000_000), (0, -1)])
def test_scores_equal_a_loop(spark, entries, broadcast, monkeypatch):
    monkeypatch.setattr(langid, "BROADCAST_ROWS", broadcast)
    docs = corpus(entries)
    df = spark.createDataFrame(docs, DOCS)
    model = langid.learn(df, entries)
    assert len(model.head[0]) <= entries
    same(langid.predict(df, model).collect(), brute(docs))


def test_held_out_accuracy(spark, middle):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{middle}/documents.parquet").collect()}
    rows = langid.op4_langid(spark, middle).collect()
    assert len(rows) == len(docs) and all(r.held_out == (rest(r.doc_id) == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_query_equals_a_loop(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    same([(r.doc_id, r.lang_pred, r.score) for r in langid.op4_langid(spark, small).collect()], brute(docs))


def test_nothing_learned_nulls_and_clashing_columns(spark):
    rows = [(i, f"the cat sat {i}", "en", 0.1) for i in range(30)] + [(100 + i, f"le chat noir {i}", "fr", 0.1) for i in range(30)]
    rows += [(None, "the cat", "en", None), (None, "1 2 3", None, None), (500, None, None, None), (501, "", "en", None), (502, "le chat", None, None), (502, "le chat", None, None), (502, "--", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumn("row", F.lit(1)).withColumn("tk", F.lit("x"))
    model = langid.learn(df)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()]
    assert len(got) == len(rows) and (None, "en") in got and (500, "und") in got and (501, "und") in got and got.count((502, "fr")) == 2
    kept = langid.reject_unknown(df, model)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.text and r.text not in ("1 2 3", "--"))
    empty = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"} and langid.predict(df.limit(0), model).count() == 0
    # nothing held out is learned from, and a language without a word is none
    assert langid.learn(df.where("crc32(cast(doc_id as string)) % 5 = 0")).langs == []
    assert langid.learn(df.where("doc_id = 501 or lang = 'fr'")).langs == ["fr"]
