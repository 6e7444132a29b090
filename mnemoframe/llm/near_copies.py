"""The near-duplicate operator for a bound on shared shingles: pairs of texts whose sets of shingles are that similar.

A text is the set of its shingles of ``n`` words; two are near copies if what they share is at least ``similarity`` of what
they have together, and rows connected by such pairs are one group. SimHash fingerprints of the sets and their index
(``simhash.links``) find the closest pairs first. At two bits the index sees few of the pairs at 4/5, so the others are
found by bands of minima: a set has ``BANDS`` keys, each of the least values of ``ROWS`` hash functions over its shingles,
and two sets that share s of what they have together have a key in common but for one time in 1 / (1 - s^4)^40: at 4/5,
once in 1.4 billion pairs. Pairs whose sizes or parities (``sketch``) show that they differ too much are left out where
they meet, without loss; what stays is verified by the whole sets, so no pair is linked wrongly.

Texts with equal sets are merged before. Every text is compared first with the one that leads most of its keys, the text
that meets most others; copies of one text thus find it at once. Then, below a key, members are compared with a few
leaders, which leave; the number of leaders grows from round to round. Members that are linked already are not compared
again, and a key whose members are all linked is done, so a large group of near copies is not paired with itself.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mnemoframe.llm import simhash
from mnemoframe.llm.common import small_batches
from mnemoframe.operators.components import connected_components
from mnemoframe.scratch import discard, drop_shuffles, written

SHINGLE = 5
#: Numerator and denominator of the least similarity.
SIMILARITY = (4, 5)
#: Bits of the parities by which pairs that differ too much are left out before any row is made of them.
SKETCH = 512
#: Keys of a set, hash functions of a key, and how many times more leaders a round has than the one before.
BANDS, ROWS, GROWTH = 40, 4, 32
#: Rows of a lookup that is broadcast (8 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the shingles of ``text``; words are those of ``simhash.fingerprint``.

    Fewer words than a shingle: their whole sequence is the one shingle. No word (also null): none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    grams = map(b" ".join, zip(*(words[i:] for i in range(min(n, len(words)))), strict=False)) if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(simhash.SEED)), np.uint64))


_DRAWN = np.random.default_rng(42)
_FACTORS = _DRAWN.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _DRAWN.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none of an empty one."""
    if not len(found):
        return np.empty(0, np.uint64)
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        values = _FACTORS * x[lo : lo + 4096]
        values += _SHIFTS
        np.minimum(least, values.min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ part) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def sketch(found: np.ndarray) -> np.ndarray:
    """``SKETCH`` parities of the shingles of a set. Two sets differ in at least as many shingles as their parities do."""
    odd = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _node(found: np.ndarray) -> int:
    n = xxhash.xxh3_64_intdigest(found.tobytes())
    return n - (1 << 64) if n >> 63 else n


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(v.view(np.int64) for v in values)])))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _marked(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, tk, node, fp, n, sketch, keys``: ``node`` names a set of shingles, ``fp`` is its fingerprint, ``n`` its size."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def work(batches):
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(2)]
            fps = np.array([simhash.majority([s], len(s)) for s in sets], np.uint64).view(np.int64)
            cols = [b.column(0), b.column(1), pa.array(map(_node, sets), pa.int64()), pa.array(fps), pa.array(map(len, sets), pa.int32()), _lists([sketch(s) for s in sets]), _lists([bands(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return _texts(docs).mapInArrow(work, "doc_id long, tk long, node long, fp long, n int, sketch array<long>, keys array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``node, found`` of every row."""
    schema = pa.schema([("node", pa.int64()), ("found", pa.list_(pa.int64()))])

    def work(batches):
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), _lists(sets)], schema=schema)

    return texts.select("text").mapInArrow(work, "node long, found array<long>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _alike(shared, a, b, similarity: tuple[int, int]):
    num, den = similarity
    return shared * F.lit(num + den) >= (a + b) * F.lit(num)


def _may_be_alike(a: str, b: str, similarity: tuple[int, int]):
    """Whether sizes and parities of two nodes leave room for the similarity; ``a`` and ``b`` are prefixes of columns."""
    num, den = similarity
    of = lambda p, c: F.col(f"{p}{c}")
    apart = reduce(add, (F.bit_count(F.get(of(a, "sketch"), F.lit(i)).bitwiseXOR(F.get(of(b, "sketch"), F.lit(i)))) for i in range(SKETCH // 64)))
    both = of(a, "n") + of(b, "n")
    return _alike(F.least(of(a, "n"), of(b, "n")), of(a, "n"), of(b, "n"), similarity) & (apart * F.lit(den + num) <= both * F.lit(den - num))


def _verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b: nodes) whose sets are alike. Only their texts are made sets again."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), "nodes")
    keys = written(distinct.select("node", "doc", "tk").join(_small(nodes), "node").select("doc", "tk"), "keys")
    # a repeated row repeats links, which does no harm
    read = _texts(docs).withColumn("doc", F.coalesce("doc_id", F.lit(simhash._LAST))).join(_small(keys), ["doc", "tk"], "left_semi")
    sets = written(_sets(read, size), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("found").alias("x")).join(_small(pairs), "a")
    two = sets.select(F.col("node").alias("b"), F.col("found").alias("y")).join(_small(pairs.select("b").distinct()), "b")
    both = one.join(two, "b")
    out = written(both.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), similarity)).select("a", "b").distinct(), "alike")
    discard(spark, pairs, nodes, keys, sets)
    return out


def _close(docs: DataFrame, distinct: DataFrame, size: int, similarity: tuple[int, int], max_diff: int) -> DataFrame:
    """Verified links among nodes whose fingerprints are equal or linked by the index."""
    fps = written(distinct.groupBy("fp").agg(F.min("node").alias("lead")), "fps")
    equal = distinct.select("node", "fp").join(fps, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(fps, max_diff).distinct()
    named = linked.join(fps.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _verified(docs, distinct, equal.unionByName(named), size, similarity)


def _heaviest(weighed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """One pair ``a, b`` for each node ``b``: with the node that leads most of its keys, the heavier one among equals."""
    lead = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "sketch")).alias("l")).select("key", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("weight", "node", "n", "sketch")))
    near = weighed.join(lead, "key").where((F.col("l_node") != F.col("node")) & _may_be_alike("", "l_", similarity))
    meets = near.groupBy("node", "l_weight", "l_node").agg(F.count(F.lit(1)).alias("keys"))
    return meets.groupBy("node").agg(F.max(F.struct("keys", "l_weight", "l_node")).alias("best")).select(F.col("best.l_node").alias("a"), F.col("node").alias("b"))


def _links(docs: DataFrame, distinct: DataFrame, size: int, similarity: tuple[int, int], max_diff: int) -> DataFrame:
    """Edges ``a, b`` that connect the nodes that near copies connect."""
    spark = docs.sparkSession
    places = distinct.select("node", "n", F.explode("keys").alias("key"))
    shared = written(places.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "shared")
    # a node's weight is how many it meets over all its keys: the text that near copies come from has the most
    met = written(places.join(_small(shared), "key"), "met")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = written(met.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    weighed = written(met.join(weights.join(distinct.select("node", "sketch"), "node"), "node").select("key", "node", "n", "sketch", "weight"), "weighed")
    discard(spark, shared, met, weights)
    first = _close(docs, distinct, size, similarity, max_diff)
    second = _verified(docs, distinct, _heaviest(weighed, similarity), size, similarity)
    found = written(first.unionByName(second), "links")
    discard(spark, first, second)
    parts = connected_components(found).withColumnRenamed("component", "root")
    here, leaders = written(weighed.join(parts, "node", "left").select("key", "node", "n", "sketch", "weight", F.coalesce("root", "node").alias("comp")), "places"), 1
    discard(spark, weighed)
    while True:
        drop_shuffles(spark)
        open_keys = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        before, here = here, written(here.join(open_keys, "key", "left_semi"), "open")
        discard(spark, before)
        if here.isEmpty():
            return found
        cell = F.pmod(F.xxhash64("node"), F.lit(leaders))
        lead = written(here.groupBy("key", cell.alias("cell")).agg(F.max(F.struct("weight", "node", "n", "sketch", "comp")).alias("l")).select("key", "l.*"), "leaders")
        other = lead.select("key", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"), F.col("comp").alias("a_comp"))
        pairs = here.join(other, "key").where((F.col("comp") != F.col("a_comp")) & _may_be_alike("", "a_", similarity)).select("a", F.col("node").alias("b")).distinct()
        new = _verified(docs, distinct, pairs, size, similarity)
        before, found = (found, new, lead), written(found.unionByName(new), "links")
        parts = connected_components(found).withColumnRenamed("component", "root")
        left = here.join(lead.select("key", "node"), ["key", "node"], "left_anti").drop("comp")
        closed, here = here, written(left.join(parts, "node", "left").select("key", "node", "n", "sketch", "weight", F.coalesce("root", "node").alias("comp")), "left")
        discard(spark, *before, closed)
        leaders *= GROWTH


def groups(docs: DataFrame, n: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, max_diff: int = simhash.MAX_DIFF) -> DataFrame:
    """``doc_id, tk, root`` for every row of ``docs``: a hash of its text, and one name for each group.

    Repeated rows stay repeated; null and empty texts have no shingles and are one group. Rows without an id are told
    apart by their texts. Other columns are not read. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    marked = written(_marked(docs, n), "marked")
    place = F.min(F.struct(F.coalesce("doc_id", F.lit(simhash._LAST)).alias("doc"), "tk")).alias("place")
    merged = marked.groupBy("node").agg(place, *(F.any_value(c).alias(c) for c in ("fp", "n", "sketch", "keys")))
    distinct = written(merged.select("node", "place.*", "fp", "n", "sketch", "keys"), "distinct")
    narrow = written(marked.select("doc_id", "tk", "node"), "nodes")
    discard(docs.sparkSession, marked)
    parts = connected_components(_links(docs, distinct, n, similarity, max_diff))
    discard(docs.sparkSession, distinct)
    drop_shuffles(docs.sparkSession)
    return narrow.join(parts, "node", "left").select("doc_id", "tk", F.coalesce("component", "node").alias("root"))
