"""The pipeline against its rules, stage by stage, and as a whole against loops."""

import random

import numpy as np
import zlib
from pyspark.sql import functions as F

import corpus_pipeline as c
import test_decontaminate
import test_langid
import test_line_dedup
import test_near_copies
import test_packing
from mnemoframe.llm import decontaminate


def test_stages_and_planted_cases(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    assert [n for n, _ in c.STAGES] == ["language", "lines", "near_copies", "benchmarks", "packed"]
    for name, stage in c.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((name, before, docs))
        if name != "packed":
            assert docs.columns == columns and docs.count() > 0.5 * before.count()
    by = {n: (b, a) for n, b, a in seen}
    assert by["language"][1].count() >= 0.97 * by["language"][0].count()
    before, after = by["near_copies"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({x for _, x in test_near_copies.direct(rows)})
    assert decontaminate.find_matches(by["benchmarks"][1], spark.read.parquet(f"{small}/benchmark.parquet")).where("n_hit > 0").count() == 0
    assert {r.doc_id for r in by["packed"][1].select("doc_id").collect()} == {r.doc_id for r in by["packed"][0].select("doc_id").collect()}
    assert all(r.n_chars == len(r.text) for r in by["lines"][1].select("n_chars", "text").collect())


def corpus():
    rng = random.Random(5)
    word = {"aa": lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7))), "bb": lambda: "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(2, 7)))}
    menu = {x: [" ".join(f() for _ in range(4)) for _ in range(5)] for x, f in word.items()}
    items = [(k, " ".join(word[x]() for _ in range(14))) for k, x in enumerate(["aa", "bb", "aa"])]
    docs = []
    for i in range(60):
        x = rng.choice(["aa", "bb"])
        lines = [" ".join(word[x]() for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 0:
            lines.append(rng.choice(menu[x]))
        if i % 9 == 5:
            lines.append("start " + items[i // 9 % 3][1] + " end")
        docs.append((i, "\n".join(lines), x))
    far = " ".join(word["aa"]() for _ in range(150)).split(" ")
    docs += [(100 + k, " ".join(far[:k] + [f"abc{k}"] + far[k + 1 :]), "aa") for k in (10, 40, 70)]
    docs += [(7, docs[7][1], "aa"), (None, "abc cab bad fed face", None), (201, None, "aa"), (202, "", "bb"), (203, "12 34", "bb"), (204, "\n\n", "aa"), (3, "vvw xyz wxy zzy uvx", "bb")]
    return docs, items


def by_loops(docs, items):
    """The documents that stay, and their texts."""
    kept = [(d, t) for (d, t, _), (_, x, p) in zip(docs, test_langid.brute(docs)) if x != "und" and p >= 0.5]
    kept = [(d, new) for (d, old), (_, new) in zip(kept, test_line_dedup.direct(kept)) if new == old or new.strip()]
    order, groups = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)), {}
    for k, root in test_near_copies.direct([(k, t) for k, (_, t) in enumerate(order)]):
        groups.setdefault(root, []).append(order[k])
    return [g[0] for g in groups.values() if not test_decontaminate.direct(g[:1], items)[0][2]]


def test_whole_equals_loops(spark, tmp_path):
    docs, items = corpus()
    df = spark.createDataFrame([(*r, "src", len(r[1] or ""), 5) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, row long").withColumn("gone", F.lit("x"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = c.run(spark, str(tmp_path)).collect()
    want = []
    for d, t in by_loops(docs, items):
        ids = test_packing.library_ids(t)
        want.append((str(d), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want) and 20 < len(want) < len(docs) - 8


def test_no_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
