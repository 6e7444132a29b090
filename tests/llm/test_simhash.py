"""op3 against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemoframe.llm import simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, bound=2):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= bound:
                parent[root(a)] = root(b)
    least = {}
    for i, f in zip(ids, fps):
        r = root(f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(root(f)) for f in fps]


def test_fingerprint_matches_the_definition(spark, small):
    for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect():
        assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)
    for t in (None, "", " \n", "One", "one TWO", "ÀÉ b c d", "a\x0bb\x0cc\td", "a b c", "x " * 70000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = [0, 2**64 - 1, 3, 7, 15, 31]
    for c in centres:
        for _ in range(rng.integers(1, 40)):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(b)
            fps.append(f)
    ids = list(range(len(fps)))
    signed = [(i, f - 2**64 if f >> 63 else f) for i, f in zip(ids, fps)]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    distinct = df.groupBy("fp").agg(F.min("doc_id").alias("least"))
    from mnemoframe.operators.components import connected_components

    parts = {r.node: r.component for r in connected_components(simhash.links(distinct)).collect()}
    want = plain_components(ids, fps)
    groups = {}
    for (i, f), w in zip(signed, want):
        groups.setdefault(parts.get(f, f), set()).add(w)
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want))


def test_one_deep_group_equals_all_pairs():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 14, 1500).astype(np.uint64) << np.uint64(3))
    gray = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    fps = fps[np.argsort(gray)]
    i, j = zip(*simhash._search(fps, np.array([0]), np.array([len(fps)]), 2))
    found = set(zip(np.concatenate(i).tolist(), np.concatenate(j).tolist()))
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 2}
    assert found == want


def test_query_on_documents(spark, small):
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    for r, f, c in zip(docs, fps, plain_components([r.doc_id for r in docs], fps)):
        assert got[r.doc_id].fingerprint == f"{f:016x}" and got[r.doc_id].component_id == c


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b c d", 5), (3, "a b c d", 5), (None, "a b c d", 5), (None, "q w e r t", None)]
    df = spark.createDataFrame(rows, DOCS + ", fp long").withColumn("component_id", F.lit("x"))
    got = sorted(simhash.near_duplicates(df).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (None, None)], key=lambda t: f"Row(doc_id={t[0]}, component_id={t[1]})")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    rows = [(None, "alpha beta gamma delta", 1), (None, "one two three four", 2), (None, "", 3), (None, None, 4), (4, "red green blue", 5), (4, "black white grey", 6), (5, "red green blue", 7), (4, "red green blue", 8), (4, "red green blue", 9)]
    df = spark.createDataFrame(rows, DOCS + ", row long").withColumn("root", F.lit("x")).withColumn("tk", F.lit(1))
    for how in ({}, {"n": 5, "similarity": (4, 5)}):
        out = simhash.drop_near_duplicates(df, **how)
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == df.columns and len(kept) == 5 and (None, "alpha beta gamma delta") in kept and (None, "one two three four") in kept
        assert sum(not t for _, t in kept) == 1 and (4, "red green blue") in kept and (4, "black white grey") in kept
        assert simhash.drop_near_duplicates(df.limit(0), **how).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0
