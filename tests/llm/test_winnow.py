"""op7 against the definition."""

import hashlib
import random

import numpy as np

from mnemoframe.llm import winnow as w


def direct(text, k, window):
    h = [int(w.rolling(np.array([ord(c) for c in text[i : i + k]], np.uint32), min(k, len(text)))[0]) for i in range(max(1, len(text) - k + 1))] if text else []
    chosen = set()
    for i in range(max(1, len(h) - window + 1) if h else 0):
        part = [(x >> 32, -j) for j, x in enumerate(h[i : i + window], i)]
        chosen.add(-min(part)[1])
    return [(h[i], i) for i in sorted(chosen)]


def test_chosen_hashes_equal_the_definition():
    rng = random.Random(0)
    for n in (0, 1, 3, 5, 8, 9, 20, 60, 200):
        for k, window in ((5, 4), (6, 1), (4, 7)):
            text = "".join(rng.choice("ab🙂é") for _ in range(n))
            h, at = w.winnow(text, k, window)
            assert list(zip(h.tolist(), at.tolist())) == direct(text, k, window)


def test_long_matches_share_a_hash():
    rng = random.Random(1)
    for _ in range(100):
        shared = "".join(rng.choice("abc") for _ in range(w.K + w.WINDOW - 1))
        a, b = ("".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + shared + "".join(rng.choice("uvw") for _ in range(rng.randrange(60))) for _ in range(2))
        assert set(w.winnow(a)[0].tolist()) & set(w.winnow(b)[0].tolist())


def expected(docs):
    docs = sorted(docs, key=lambda d: (-(d[0] if d[0] is not None else -(2**63)), d[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, nxt = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text) // 3
        new = text[: len(text) - n] + nxt[:n]
        f, e, x = (w.winnow(t) for t in (text, new, nxt))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), w.digest(*f), w.digest(*e), w.likeness(f[0], e[0]), w.likeness(f[0], x[0])))
    return sorted(out, key=str)


def test_query_equals_one_loop(spark, small, monkeypatch):
    monkeypatch.setattr(w, "RANGE_BYTES", 20_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = w.op7_winnow(spark, small).collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == expected(docs)
    chosen = {r.doc_id: (np.array(r.hashes, np.int64).view(np.uint64), np.array(r.positions, np.int64)) for r in rows}
    after = {a: b for a, b in zip(sorted(chosen, reverse=True), [*sorted(chosen, reverse=True)[1:], max(chosen)])}
    for r in rows:
        assert r.fingerprint == w.digest(*chosen[r.doc_id]) and r.near_next == w.likeness(chosen[r.doc_id][0], chosen[after[r.doc_id]][0])


def test_nulls_repeats_and_single_rows(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE_BYTES", 40)
    docs = [(None, "alpha beta gamma delta"), (3, None), (3, "same text " * 9), (3, "same text " * 9), (7, ""), (-5, "x" * 50), (None, "zed " * 20), (2**62, "first " * 30), (2**62 + 1, "very first " * 30)]
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, part string")
    assert sorted((tuple(r)[:7] for r in w.compare_with_edited(df).collect()), key=str) == expected(docs)
    assert [tuple(r)[:7] for r in w.compare_with_edited(df.limit(1)).collect()] == expected(docs[:1])
    assert w.compare_with_edited(df.limit(0)).count() == 0
    assert w.fingerprints(df).count() == 9
