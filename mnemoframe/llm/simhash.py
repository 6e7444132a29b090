"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64-bit majority of the XXH64 values of word shingles. Documents whose fingerprints differ in at most
``max_diff`` = 2 bits are linked, and every document gets the smallest ``doc_id`` it reaches.

The index is a forest. Its top nodes are masked bit patterns: the 64 bits are cut into 6 blocks, and two fingerprints
that differ in at most two bits agree in at least 4 of them, so each fingerprint stands below the 15 nodes that fix 4
blocks (42 to 44 bits) and every link lies below one of them. Top nodes are what Spark deals out, so the index is never
in one place, and below a node at most 2^22 different fingerprints exist at all. Below a top node the members are
sorted by Gray rank (neighbours in that order share long patterns), every 8 members form a node, every 8 nodes the next,
and a node holds the bits on which all below it agree and its parent does not. A search carries the differences counted
so far downwards and drops a whole node as soon as they exceed the bound.

Exact copies are merged before (one row per fingerprint), and below a node links are contracted to a star, so what is
shuffled stays linear in the number of different fingerprints however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.operators.components import connected_components
from mnemoframe.scratch import discard, written

SEED = 42
SHINGLE = 3
MAX_DIFF = 2
BLOCKS = (11, 11, 11, 11, 10, 10)
FAN = 8
_QUERIES_AT_ONCE = 1 << 15
_HASHES_AT_ONCE = 1 << 15
_LAST = (1 << 63) - 1


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of whole ``text``.

    A-Z is lower-cased, words are split at ASCII white space, shingles of ``n`` words count as often as they occur.
    Fewer words: their whole sequence is the one shingle. No word (also null): zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < n:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        total = len(words) - n + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    return majority((np.fromiter(islice(hashes, _HASHES_AT_ONCE), np.uint64) for _ in range(0, total, _HASHES_AT_ONCE)), total)


def majority(hashes: Iterable[np.ndarray], total: int) -> int:
    """The bits set in over half of ``total`` hashes, which come in runs."""
    bits = np.zeros(64, np.int64)
    for h in hashes:
        bits += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, tk`` of every row of ``docs``: the fingerprint as a signed long, and a hash of the text.

    Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("tk", pa.int64())])

    def work(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield record(schema, [batch.column(0), fps.view(np.int64), batch.column(1)])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text")).mapInArrow(work, "doc_id long, fp long, tk long")


def top_masks(blocks: tuple[int, ...] = BLOCKS, max_diff: int = MAX_DIFF) -> list[int]:
    """The masks of the top nodes: all choices of blocks but ``max_diff`` of them. ``blocks`` are widths, 64 in all."""
    starts = [sum(blocks[:i]) for i in range(len(blocks))]
    fields = [((1 << w) - 1) << s for w, s in zip(blocks, starts, strict=True)]
    return [sum(c) for c in combinations(fields, len(blocks) - max_diff)]


def _gray_rank(fp):
    """Position of a bit pattern in the reflected Gray sequence, as a long that sorts like an unsigned number."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _search(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, max_diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j), i < j, within groups of equal depth; ``fps`` is sorted by group and Gray rank."""
    depth = 0
    while FAN**depth < sizes.max():
        depth += 1
    # levels[0] are the members; level k has a node for every FAN nodes of level k - 1 of the same group
    firsts, counts = [np.arange(len(fps))], [sizes]
    agree, pattern = [np.full(len(fps), ~np.uint64(0))], [fps]
    low, high = fps, fps
    for _ in range(depth):
        below = counts[-1]
        here = -(-below // FAN)
        offset = np.cumsum(below) - below
        within = np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
        first = np.repeat(offset, here) + within * FAN
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        firsts.append(first)
        counts.append(here)
        agree.append(~(low ^ high))
        pattern.append(low)
    # bits that a node fixes and its parent does not
    own = [a.copy() for a in agree]
    for k in range(depth):
        parents = np.repeat(np.arange(len(firsts[k + 1])), np.diff(np.append(firsts[k + 1], len(firsts[k]))))
        own[k] &= ~agree[k + 1][parents]
    root = np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(fps), _QUERIES_AT_ONCE):
        query = np.arange(lo, min(lo + _QUERIES_AT_ONCE, len(fps)))
        node = root[query]
        so_far = np.bitwise_count((fps[query] ^ pattern[depth][node]) & own[depth][node]).astype(np.int64)
        for k in range(depth, 0, -1):
            ends = np.append(firsts[k][1:], len(firsts[k - 1]))
            n = ends[node] - firsts[k][node]
            child = np.repeat(firsts[k][node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, so_far = np.repeat(query, n), np.repeat(so_far, n)
            so_far += np.bitwise_count((fps[query] ^ pattern[k - 1][child]) & own[k - 1][child])
            keep = so_far <= max_diff
            query, node, so_far = query[keep], child[keep], so_far[keep]
        later = node > query
        yield query[later], node[later]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        new = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def group_links(top: np.ndarray, pattern: np.ndarray, fps: np.ndarray, max_diff: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, root) within the top nodes; rows are sorted by top node, then by Gray rank."""
    new = np.append(True, (top[1:] != top[:-1]) | (pattern[1:] != pattern[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fps)))
    out_a, out_b = [], []
    bound = 1
    while bound < (sizes.max() if len(sizes) else 0):
        chosen = (sizes > bound) & (sizes <= bound * FAN)
        bound *= FAN
        if not chosen.any():
            continue
        s, z = starts[chosen], sizes[chosen]
        at = np.repeat(s - (np.cumsum(z) - z), z) + np.arange(z.sum())
        members = fps[at]
        label = np.arange(len(members))
        for i, j in _search(members, s, z, max_diff):
            # contracted after every slice of queries, so links never pile up
            some = _roots(len(members), np.append(np.arange(len(members)), i), np.append(label, j))
            label = some
        moved = np.flatnonzero(label != np.arange(len(members)))
        out_a.append(members[moved])
        out_b.append(members[label[moved]])
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def links(fps: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """Edges ``a, b`` over the different values of ``fps.fp`` that connect exactly what links of <= ``max_diff`` bits do."""
    masks = [m - (1 << 64) if m >> 63 else m for m in top_masks(BLOCKS, max_diff)]
    nodes = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("top", "pattern"))
    dealt = nodes.repartition("top", "pattern").sortWithinPartitions("top", "pattern", _gray_rank(F.col("fp"))).select("top", "pattern", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        def found(runs):
            a, b = group_links(*(np.concatenate(x) for x in zip(*runs, strict=True)), max_diff)
            return record(schema, [a.view(np.int64), b.view(np.int64)])

        # runs of rows, joined only once their last node has ended
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            cols = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if size >= 1 << 16:
                before = held[-1]
                first = np.flatnonzero(np.append(before[0][-1], cols[0][:-1]) != cols[0]), np.flatnonzero(np.append(before[1][-1], cols[1][:-1]) != cols[1])
                starts = [int(f[0]) for f in first if len(f)]
                if starts:
                    cut = min(starts)
                    yield found([*held, [x[:cut] for x in cols]])
                    held, size, cols = [], 0, [x[cut:] for x in cols]
            held.append(cols)
            size += len(cols[0])
        if size:
            yield found(held)

    return dealt.mapInArrow(work, "a long, b long")


def _classes(distinct: DataFrame, max_diff: int) -> DataFrame:
    """``distinct`` (a row for each ``fp``) with ``root``, one fingerprint for each linked group."""
    parts = connected_components(links(distinct, max_diff))
    return distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, max_diff: int = MAX_DIFF) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Repeated rows stay repeated; null and empty texts have fingerprint zero and are linked like any other. A null
    ``doc_id`` keeps its row, and its component is the smallest id that is not null (null if there is none). Columns of
    ``docs`` other than ``doc_id`` and ``text`` are not read. Empty tables give no rows.
    """
    marked = written(fingerprints(docs, n).select("doc_id", "fp"), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = _classes(distinct, max_diff)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``found`` (doc_id, tk, root: a row for each row of ``docs``).

    It is the one with the smallest id (null ids last), then the smallest hash of its text; of rows equal in id and text
    one stays. Rows are told apart by id and text, so rows without an id, or with one id, do not stand for each other.
    Only the keys of rows that go are joined with the texts.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    rows = found.select(doc, "tk", "root").groupBy("root", "doc", "tk").agg(F.count(F.lit(1)).alias("n"))
    ranked = written(rows, "ranked")
    least = ranked.groupBy("root").agg(F.min(F.struct("doc", "tk")).alias("least"))
    decided = ranked.join(least, "root").select("doc", "tk", "n", (F.struct("doc", "tk") == F.col("least")).alias("stays"))
    gone = written(decided.where(~F.col("stays")).select("doc", "tk"), "gone")
    many = written(decided.where(F.col("stays") & (F.col("n") > 1)).select("doc", "tk"), "many")
    discard(spark, ranked)
    keyed = docs.select(doc, F.xxhash64(F.col("text").cast("string")).alias("tk"), F.struct("*").alias("row"))
    left = keyed.join(gone, ["doc", "tk"], "left_anti")
    if not many.isEmpty():
        again = left.join(many, ["doc", "tk"], "left_semi").dropDuplicates(["doc", "tk"])
        left = left.join(many, ["doc", "tk"], "left_anti").unionByName(again)
    return left.select("row.*")


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, max_diff: int = MAX_DIFF, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of every linked group, with all its columns; see ``one_of_each`` for which.

    With ``similarity`` (a fraction) texts are linked by their sets of ``n``-word shingles instead: what the index finds is
    verified, and similar texts that differ in more than ``max_diff`` bits are found by bands of minima (``near_copies``). Null and empty
    texts are one group.
    """
    if similarity is not None:
        from mnemoframe.llm import near_copies

        return one_of_each(docs, near_copies.groups(docs, n, similarity, max_diff))
    marked = written(fingerprints(docs, n), "fingerprints")
    rooted = _classes(written(marked.select("fp").distinct(), "distinct"), max_diff)
    return one_of_each(docs, marked.join(rooted, "fp").select("doc_id", "tk", "root"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
