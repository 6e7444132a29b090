"""op6 against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import line_dedup as d


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def direct(docs, bound=1, least=1):
    lines = sorted({(d[0] if d[0] is not None else 2**63 - 1, k, x.strip(" \t\r")) for d in docs if d[1] is not None for k, x in enumerate(d[1].split("\n"))})
    lines = [x for x in lines if len(x[2]) >= least]
    gone = set()
    for i, (doc, k, x) in enumerate(lines):
        if any(edits(x, y[2]) <= bound for y in lines[:i] if y[:2] != (doc, k)):
            gone.add((doc, k, x))
    return [(doc, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (doc if doc is not None else 2**63 - 1, k, x.strip(" \t\r")) not in gone)) for doc, t in docs]


def changed(rng, x):
    i, kind = rng.randrange(len(x) + 1), rng.randrange(3)
    c = rng.choice("abé ")
    return x[:i] + c + x[i:] if kind == 0 else x[:i] + x[i + 1 :] if kind == 1 else x[:i] + c + x[i + 1 :]


@pytest.mark.parametrize(("seed", "bound"), [(0, 1), (1, 1), (2, 1), (3, 0)])
def test_equals_all_pairs(spark, seed, bound):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randrange(18, 30))) for _ in range(12)] + ["a" * 24, "ab" * 12]
    pool = list(base)
    for _ in range(60):
        pool.append(changed(rng, rng.choice(pool)))
    docs = [(i, "\n".join(rng.choice(["", "  "]) + rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in d.dedup_lines(df, bound).collect())
    assert got == sorted(direct(docs, bound))


def test_query_equals_all_pairs(spark, small):
    import hashlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r.doc_id < 2**62]
    lines = {}
    for doc, t in docs:
        for k, x in enumerate((t or "").split("\n")):
            if y := x.strip(" \t\r"):
                lines.setdefault(y, []).append((doc, k))
    first = {x: min(v) for x, v in lines.items()}
    by_size = {}
    for x in lines:
        by_size.setdefault(len(x), []).append(x)
    near = {x for x in lines for n in (-1, 0, 1) for y in by_size.get(len(x) + n, ()) if first[y] < first[x] and (len(x) < 20 or x[:8] == y[:8] or x[-8:] == y[-8:]) and edits(x, y) <= 1}
    for r in d.op6_line_dedup(spark, small).collect():
        t = dict(docs)[r.doc_id]
        kept = [x for k, x in enumerate(t.split("\n")) if (y := x.strip(" \t\r")) not in first or (first[y] == (r.doc_id, k) and y not in near)]
        assert r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest() and r.n_lines - r.n_removed == len(kept)


def test_nulls_repeats_long_lines_and_empty(spark):
    x, y = "a line of some length here", "a line of some length hers"
    docs = [(5, f"{x}\nshort"), (5, f"{x}\nshort"), (7, f"{y}\nshort"), (None, x), (9, None), (10, ""), (11, "q" * 150_000), (12, "q" * 149_999)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_removed long").withColumn("h", F.lit(3)).withColumn("line_no", F.lit("z"))
    out = d.dedup_lines(df.withColumn("_gone", F.lit(0)).withColumn("gone", F.lit(1)).withColumn("lines", F.lit(2)).withColumn("row", F.lit(2))).drop("_gone", "gone", "lines", "row")
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("5", f"{x}\nshort"), ("5", f"{x}\nshort"), ("7", ""), ("None", ""), ("9", None), ("10", ""), ("11", "q" * 150_000), ("12", "")])
    assert d.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        d.removed_lines(df, 2)


def test_shuffled_lookups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", -1)
    docs = [(1, "the first of the lines here\nanother line that is long enough"), (2, "the first of the line here"), (3, "another line that is long enouge")]
    assert sorted((r.doc_id, r.text) for r in d.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == sorted(direct(docs))


def test_short_equal_lines_go_too(spark, middle):
    x, y = "menu", "one character apart a"
    docs = [(1, f" {x}\n\n{y}\nab"), (2, f"{x}\n\nkept\n{x} "), (3, f"menus\n{y[:-1]}b\nac\n\nab")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in d.dedup_lines(df, least_chars=20, least_equal=1).collect())
    assert got == [(1, docs[0][1], 0), (2, "\nkept", 2), (3, "menus\nac\n", 2)]
    seen, later = set(), 0
    for r in spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").where("text is not null").orderBy("doc_id").collect():
        for line in (z.strip(" \t\r") for z in r.text.split("\n")):
            later += 0 < len(line) < 20 and line in seen
            seen.add(line)
    lines = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text")
    short = lambda **more: d.removed_lines(lines, least_chars=20, **more).count()
    assert later > 0 and short(least_equal=1) - short() == later
