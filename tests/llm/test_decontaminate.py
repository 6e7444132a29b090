"""op5 against a direct scan."""

import hashlib
import random
import re

import pytest

from mnemoframe.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def direct(docs, items, size=10):
    windows = []
    for i, t in items:
        w = plain(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.append((i, w[k : k + size]))
    out = []
    for doc, t in docs:
        w = plain(t)
        hit, found = set(), set()
        for i, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    found.add(str(i))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def as_rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect())


ITEMS = [(0, "a b c d e f g h i j k l m"), (1, "X y"), (2, "b c d e f g h i j k"), (3, "solo"), (4, None), (5, "--"), (6, "zé zè à b c d e f g h i j"), (7, "r r r r r r r r r r r r")]
DOCS = [
    (1, "a B c-d e f g h i j, k l m n"), (2, "q x Y z"), (3, ""), (4, None), (5, "b c d e f g h i j k b c d e f g h i j k"), (6, "Solo"),
    (7, "zé zè à b c d e f g h i j k l"), (8, "r " * 40), (9, "a b c d e f g h i"), (10, "x y x y"), (11, "j k l m a b c d e f g h i j"), (12, "x"),
]


def test_windows_equal_a_direct_scan(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert as_rows(d.find_matches(docs, items)) == direct(DOCS, ITEMS)
    long_items = [x for x in ITEMS if x[0] not in (1, 3)]
    assert as_rows(d.find_matches(docs, items.where("item_id not in (1, 3)"))) == direct(DOCS, long_items)


def test_blocks_give_the_same(spark):
    docs, items = spark.createDataFrame(DOCS + DOCS[:2], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert as_rows(d.find_matches(docs, items, block_bytes=30)) == sorted(direct(DOCS + DOCS[:2], ITEMS))


def test_matches_are_the_longest_runs(spark):
    docs, items = spark.createDataFrame(DOCS[:1], "doc_id long, text string"), spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    (row,) = d.find_matches(docs, items).collect()
    assert [tuple(m) for m in row.matches] == [("0", 0, 0, 13)]


def longest(doc, item, size=10):
    """Runs of words that both have and that lie in no other such run of the document."""
    a, b = plain(doc), plain(item)
    runs = []
    for p in range(len(a)):
        for t in range(len(b)):
            n = 0
            while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n]:
                n += 1
            if n >= min(size, len(b)):
                runs.append((p, n, t))
    best = {}
    for p, n, t in runs:
        if not any((q <= p and q + m >= p + n and m > n) for q, m, _ in runs):
            best[p, n] = min(t, best.get((p, n), t))
    return sorted((p, t, n) for (p, n), t in best.items())


@pytest.mark.parametrize("seed", range(6))
def test_matches_equal_a_quadratic_search(spark, seed):
    rng = random.Random(seed)
    passage = [rng.choice("abcdefgh") for _ in range(14)]
    texts = ["r " * 14, " ".join(passage * 2), " ".join(["x", *passage, "y", *passage[2:], "z"]), "p q r"]
    texts += [" ".join(rng.choice("ab" if seed % 2 else "r") for _ in range(rng.randrange(5, 40))) for _ in range(4)]
    docs = [(k, " ".join(rng.choice(texts) for _ in range(rng.randrange(1, 4)))) for k in range(12)]
    items = list(enumerate(texts))
    found = d.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=40 if seed > 3 else 10**6)
    got = {(r.doc_id, m.item_id): [] for r in found.collect() for m in r.matches}
    for r in found.collect():
        for m in r.matches:
            got[r.doc_id, m.item_id].append((m.doc_word, m.item_word, m.n_words))
    want = {(k, str(i)): x for k, t in docs for i, item in items if (x := longest(t, item))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_query_equals_a_direct_scan(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    want = {doc: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for doc, n, h, f in direct(docs, items)}
    got = {r.doc_id: tuple(r)[1:6] for r in d.op5_decontaminate(spark, small).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_removal_nulls_and_empty_tables(spark):
    rows = [(1, "x y", 1), (None, "x y", 2), (None, "clean", 5), (None, None, 6), (2, "p", 3), (2, "x y", 4), (2, "p", 3), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit long")
    items = spark.createDataFrame([(1, "x y"), (None, "p")], "item_id long, text string")
    left = lambda *a, **k: sorted(map(tuple, d.remove_contaminated(docs, *a, **k).collect()), key=str)
    assert left(items) == sorted((r for r in rows if r[1] != "x y"), key=str)
    assert left(items, block_bytes=1) == left(items)
    assert left(items.limit(0)) == sorted(rows, key=str)
    assert d.remove_contaminated(docs.limit(0), items).count() == 0
    assert d.find_matches(docs.limit(0), items).count() == 0
