"""Ranked lexical search over K2-treaps of the term-document grid.

A shard of documents is a grid: rows are the terms that the queries ask for, columns the documents, a cell holds the impact
of the term on the document. The grid is a quadtree that keeps only quadrants with a cell, as a mask of its four children,
the place of the first, and the greatest impact inside. A query goes down the paths of all its rows at once: for a range of
columns it has a node for each row, and the weighted sum of their maxima bounds the score of every document in the range.
Ranges are opened best first, in batches, until no range can reach the k-th score; at single columns the bound is the score.

The corpus is read once for the postings of the asked terms, which are written, and these once for the counts and once for
the search. Shards are cut inside the tasks, so no document moves; each shard gives its k best for every query and a window
keeps the k best of all. Queries come in blocks of ``BLOCK_BYTES`` of text, one pass each, so what is broadcast is bounded.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.llm.word_hashes import Words
from mnemoframe.scratch import written

#: Text of a block of queries.
BLOCK_BYTES = 4_000_000
#: Cells and columns of a shard.
SHARD_CELLS, SHARD_DOCUMENTS = 2_000_000, 1 << 16
#: Ranges opened at once, and the numbers that a batch holds at most.
BATCH, BATCH_NODES = 1024, 1 << 20
K = 20
_LAST = (1 << 63) - 1

WORDS = Words(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of ``x`` with a zero before each."""
    x = x.astype(np.uint64)
    for by, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(by))) & np.uint64(keep)
    return x


class Treap:
    """A grid of impacts as a compressed quadtree with maxima. Level 0 is the whole grid, level ``height`` its cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int):
        self.height = max(1, (max(n_rows, n_columns) - 1).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        code, most = code[order], impacts[order].astype(np.int32)
        #: By level: the mask of a node's children (bit 2 * row half + column half), the place of the first, the maximum.
        self.mask: list[np.ndarray] = [np.empty(0, np.uint8)] * (self.height + 1)
        self.first = [np.empty(0, np.int32)] * (self.height + 1)
        self.most = [most] * (self.height + 1)
        for level in range(self.height - 1, -1, -1):
            above = code >> np.uint64(2)
            begin = np.flatnonzero(np.append(True, above[1:] != above[:-1])) if len(above) else np.empty(0, np.int64)
            child = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            self.mask[level] = np.bitwise_or.reduceat(child, begin) if len(begin) else np.empty(0, np.uint8)
            self.first[level] = begin.astype(np.int32)
            most = np.maximum.reduceat(most, begin) if len(begin) else most
            self.most[level] = most
            code = above[begin]

    def children(self, level: int, nodes: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Nodes of the next level in the quadrants ``halves``; -1 for a quadrant without a cell."""
        mask = self.mask[level][nodes]
        mask[nodes < 0] = 0
        return np.where(mask >> halves & 1, self.first[level][nodes] + _BEFORE[mask, halves], -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the ``k`` best columns with a score above 0; equal scores by ascending ``tie`` of the column."""
        columns, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.most[0]) or not len(rows):
            return columns, scores
        size = max(1, min(BATCH, BATCH_NODES // len(rows)))
        root = np.zeros((1, len(rows)), np.int32)
        opened = 0
        heap = [(-int(self.most[0][0] * weights.sum()), opened, 0, np.zeros(1, np.int64), root, np.array([self.most[0][0] * weights.sum()]))]
        while heap:
            _, _, level, ranges, nodes, bound = heapq.heappop(heap)
            least = scores[-1] if len(scores) == k else 1
            if bound[0] < least:
                break  # the best batch there is
            n = int(np.searchsorted(-bound, -least, "right"))
            if level == self.height:
                columns, scores = np.concatenate([columns, ranges[:n]]), np.concatenate([scores, bound[:n]])
                order = np.lexsort((tie[columns], -scores))[:k]
                columns, scores = columns[order], scores[order]
                continue
            down = self.height - level - 1
            row_half = ((rows >> down & 1) << 1).astype(np.uint8)
            halves = np.concatenate([np.broadcast_to(row_half, (n, len(rows))), np.broadcast_to(row_half | 1, (n, len(rows)))])
            nodes = self.children(level, np.concatenate([nodes[:n], nodes[:n]]), halves)
            ranges = np.concatenate([2 * ranges[:n], 2 * ranges[:n] + 1])
            most = self.most[level + 1][nodes].astype(np.int64)
            most[nodes < 0] = 0
            bound = most @ weights
            keep = np.flatnonzero(bound >= least)
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            for lo in range(0, len(keep), size):
                part = keep[lo : lo + size]
                opened += 1
                heapq.heappush(heap, (-int(bound[part[0]]), opened, level + 1, ranges[part], nodes[part], bound[part]))
        return columns, scores


#: How many children of a mask stand before a quadrant.
_BEFORE = np.array([[bin(m & ((1 << h) - 1)).count("1") for h in range(4)] for m in range(16)], np.int32)


class Queries:
    """A block of queries: their terms in ascending order of the hash, and for each query its rows and how often each."""

    def __init__(self, texts: list[str | None]):
        found, begin = WORDS.hashes(pa.array(texts, pa.string()))
        self.terms, of = np.unique(found, return_inverse=True)
        self.asked = [np.unique(of[lo:hi], return_counts=True) for lo, hi in zip(begin[:-1], begin[1:], strict=True)]


_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _postings(docs: DataFrame, known) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document: its number of terms, and which asked ones occur how often."""

    def work(batches):
        terms = known.value.terms
        for b in batches:
            found, begin = WORDS.hashes(b.column(1))
            place = np.searchsorted(terms, found)
            place[place == len(terms)] = 0
            hit = terms[place] == found if len(terms) else np.zeros(len(found), bool)
            doc = np.repeat(np.arange(b.num_rows), np.diff(begin))
            pair, n = np.unique(doc[hit] * (len(terms) + 1) + place[hit], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(b.num_rows + 1) * (len(terms) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % (len(terms) + 1), n)]
            yield record(_POSTINGS, [b.column(0), np.diff(begin), *lists])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, terms array<int>, counts array<int>")


def _statistics(postings: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each asked term."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def work(batches):
        df, n, length = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
            size = b.column(0).to_numpy()
            n, length = n + int((size > 0).sum()), length + int(size.sum())
        seen = np.flatnonzero(df)
        yield record(schema, [np.append(seen, [-1, -2]), np.append(df[seen], [n, length])])

    found = postings.select("n", "terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    df = np.zeros(n_terms, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    whole = dict(zip(term.tolist(), n.tolist(), strict=True))
    return whole.get(-1, 0), whole.get(-2, 0), df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


_FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _shards(batches, cells: int, documents: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``doc_id, whether it is null, n, terms, counts, place of each document's first`` of shards of documents with an asked term."""
    held: list[pa.RecordBatch] = []
    n_cells = n_docs = 0

    def joined():
        t = pa.Table.from_batches(held).combine_chunks()
        terms = t.column("terms").chunk(0)
        ids = t.column("doc_id")
        sizes = terms.value_lengths().to_numpy()
        return ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(), t.column("n").to_numpy(), terms.flatten().to_numpy(), t.column("counts").chunk(0).flatten().to_numpy(), sizes

    for b in batches:
        b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
        if b.num_rows:
            held.append(b)
            n_cells, n_docs = n_cells + len(b.column(2).flatten()), n_docs + b.num_rows
        if n_cells >= cells or n_docs >= documents:
            yield joined()
            held, n_cells, n_docs = [], 0, 0
    if held:
        yield joined()


def _searched(postings: DataFrame, known, model, k: int) -> DataFrame:
    """``query, doc_id, score`` of the ``k`` best documents of every shard."""

    def work(batches):
        queries, (n_all, length, row, weights) = known.value, model.value
        for ids, null, n, terms, counts, sizes in _shards(batches, SHARD_CELLS, SHARD_DOCUMENTS):
            # documents of like length stand together, so a range's maxima are close to its documents' impacts
            order = np.argsort(n, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            m = np.array([75 + 25 * x * n_all // length for x in n.tolist()], np.int64)
            tf = counts.astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
            treap = Treap(row[terms], np.repeat(place, sizes), impact, len(row), len(ids))
            ids, null = ids[order], null[order]
            found = [[], [], []]
            for q, (asked, times) in enumerate(queries.asked):
                columns, scores = treap.search(row[asked], weights[asked] * times, k, ids)
                found[0] += [q] * len(columns)
                found[1] += [None if null[c] else int(ids[c]) for c in columns.tolist()]
                found[2] += scores.tolist()
            yield record(_FOUND, found)

    return postings.mapInArrow(work, "query int, doc_id long, score long")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block_bytes`` of text; the driver holds one at a time."""
    held, size = [], 0
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append(tuple(r))
        size += len(r[1] or "") + 50
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, scores above 0 only.

    Equal scores go by ascending doc_id, a null doc_id last. A null or empty text, or one without a term, gives no rows on
    either side; documents without a term count nowhere. Repeated documents are ranked one by one, repeated items are
    answered one by one, and a null item_id is answered under null. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(items.dtypes)["item_id"]
    parts = []
    for block in _blocks(items, block_bytes):
        queries = Queries([t for _, t in block])
        if not len(queries.terms):
            continue
        known = spark.sparkContext.broadcast(queries)
        postings = written(_postings(docs, known), "postings")
        n, length, df = _statistics(postings, len(queries.terms))
        row = np.empty(len(df), np.int64)
        row[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weights = np.array([weight(n, d) for d in df.tolist()], np.int64)
        best = _searched(postings, known, spark.sparkContext.broadcast((n, length, row, weights)), k)
        order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item_id {kind}")
        parts.append(top.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, over all documents; cases of nulls and repeats are those of ``rank``."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d_ as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i_ as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
n_ as (select doc_id, count(*) as n from d_ group by 1),
a_ as (select count(*) as docs, cast(sum(n) as bigint) as words from n_),
tf_ as (select doc_id, term, count(*) as tf from d_ where term in (select term from i_) group by 1, 2),
w_ as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf_, a_ group by term, docs),
m_ as (select doc_id, 100 - 25 + (25 * n * docs) // words as m from n_, a_),
q_ as (select item_id, term, count(*) as times from i_ group by 1, 2),
s_ as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from q_ join w_ using (term) join tf_ using (term) join m_ using (doc_id) group by 1, 2)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s_ where score > 0) where rank <= 20
"""
