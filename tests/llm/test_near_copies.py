"""Near copies of the pipeline against all pairs."""

import random

import corpus_pipeline
import pytest
from mnemoframe.llm import near_copies as c, simhash

DOCS = "doc_id long, text string"


def drop(df):
    return simhash.drop_near_duplicates(df, c.SHINGLE, similarity=c.SIMILARITY)


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def direct(docs):
    """Smallest id that each id reaches over all pairs with similarity 0.8 or more."""
    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, least[top(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(20)]
    pool = [[word() for _ in range(rng.randrange(1, 90))] for _ in range(15)]
    while len(pool) < n:
        x = list(rng.choice(pool))
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = word()
        x += rng.choice([[], [], [], common, [word()]])
        pool.append(x)
    texts = ["", None, " \n", *(" ".join(x) for x in pool)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(c, "BROADCAST_ROWS", -1)
    docs = corpus(seed)
    want = direct(docs)
    assert len(docs) > len({x for _, x in want}) > 20
    df = spark.createDataFrame(docs, DOCS)
    found = c.groups(df).collect()
    least = {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert sorted((r.doc_id, least[r.root]) for r in found) == want
    assert sorted(r.doc_id for r in drop(df).collect()) == sorted({x for _, x in want})


def test_stage_drops_a_copy_with_one_word_changed(spark, small):
    words = [f"word{k}" for k in range(120)]
    docs = [(k, " ".join([*words[: 9 * k], f"other{k}", *words[9 * k + 1 :]])) for k in range(1, 12)] + [(20, "another text of a few words")]
    df = spark.createDataFrame(docs, DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, small).collect()) == [1, 20]


def test_repeated_and_null_ids_and_no_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(3, text), (3, text), (None, "alone"), (4, text.upper())], DOCS)
    assert sorted((str(r.doc_id), r.text) for r in drop(df).collect()) == [("3", text), ("None", "alone")]
    assert c.groups(df.limit(0)).count() == 0
