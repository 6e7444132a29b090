"""Benchmark decontamination by suffix arrays over the training texts.

Every task cuts its documents into shards of about two million words and sorts the suffixes of a shard (by their first
``WINDOW`` words, which is all that a window search compares). Every suffix of every benchmark item is then looked up by
binary search in every shard: the range it opens gives all places where its window occurs. From each place that does not
go on to the left, the suffix is compared further, word by word, to the longest match. Suffixes that cannot begin a
match (their first two words never stand together in an item) are left out of the array, which changes no result.

Documents never leave their task; only the benchmark travels, broadcast in blocks of ``BENCHMARK_BYTES`` of text that
each shard is searched for one after the other, in one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import by_size, record, small_batches, table

WINDOW = 10
#: Text of a benchmark block that is broadcast at once.
BENCHMARK_BYTES = 16_000_000
SHARD_WORDS = 2_000_000
_PAIRS_AT_ONCE = 500_000

#: ASCII letters in lower case and digits stay, bytes of other characters too, the rest of ASCII separates words.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The suffixes of benchmark items, ready for binary search: different windows, and all places of each."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        self.items = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        flat, at, length, owner, word = [-1], [], [], [], []
        for item, text in sorted({(str(i), t) for i, t in items if i is not None and t is not None}):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            n = max(1, len(ids) - size + 1) if ids else 0
            at += range(len(flat), len(flat) + n)
            length += [min(size, len(ids))] * n
            owner += [number[item]] * n
            word += range(n)
            flat += [*ids, -1]
        self.size, self.vocabulary = size, vocabulary
        #: All items one behind the other, with -1 around each.
        self.words = np.array(flat, np.int32)
        n, starts = np.array(length, np.int64), np.array(at, np.int64)
        columns = np.arange(size)
        inside = columns < n[:, None]
        rows = np.where(inside, self.words[np.minimum(starts[:, None] + columns, len(self.words) - 1)], 0).astype(">u4").reshape(-1, size)
        low, first, of = np.unique(rows.view(f"S{4 * size}").ravel(), return_index=True, return_inverse=True)
        self.low, self.length = low, n[first]
        self.high = np.where(inside[first], rows[first], 0xFFFFFFFF).astype(">u4").reshape(-1, size).view(f"S{4 * size}").ravel()
        by = np.argsort(of, kind="stable")
        self.first = np.searchsorted(of[by], np.arange(len(low) + 1))
        self.at, self.item, self.word = starts[by], np.array(owner, np.int64)[by], np.array(word, np.int64)[by]
        self.short = bool((self.length < 2).any())
        follow = np.flatnonzero((self.words[:-1] > 0) & (self.words[1:] > 0))
        self.pairs = np.unique(self.words[follow].astype(np.int64) * (len(vocabulary) + 1) + self.words[follow + 1])

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Positions whose suffix can begin with a window."""
        if self.short:
            return np.flatnonzero(ids)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[at].astype(np.int64) * (len(self.vocabulary) + 1) + ids[at + 1]
        spot = np.searchsorted(self.pairs, code)
        spot[spot == len(self.pairs)] = 0
        return at[self.pairs[spot] == code] if len(self.pairs) else at[:0]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in a shard: position (ascending), window."""
        none = np.empty(0, np.int64)
        if not len(self.length) or not len(ids):
            return none, none
        at = self.starts(ids)
        if not len(at):
            return none, none
        padded = np.append(ids, np.zeros(self.size, ids.dtype)).astype(">u4")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.size)[at]).view(f"S{4 * self.size}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes, at = suffixes[order], at[order]
        left = np.searchsorted(suffixes, self.low, "left")
        right = np.searchsorted(suffixes, self.high, "right")
        at, window = at[_spread(left, right)], np.repeat(np.arange(len(left)), right - left)
        order = np.argsort(at, kind="stable")
        return at[order], window[order]

    def longest(self, ids: np.ndarray, at: np.ndarray, window: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``(position, item, word of the item, words)`` of the occurrences extended as far as they go, in runs.

        An occurrence that goes on one word to the left is part of a longer one and is not extended itself.
        """
        n = np.cumsum(self.first[window + 1] - self.first[window])
        cuts = np.append(np.searchsorted(n, np.arange(0, n[-1] if len(n) else 0, _PAIRS_AT_ONCE), "right"), len(n))
        text, item_text = np.append(ids, np.int32(0)), self.words
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            w = window[lo:hi]
            which = _spread(self.first[w], self.first[w + 1])
            pos, size = np.repeat(at[lo:hi], self.first[w + 1] - self.first[w]), np.repeat(self.length[w], self.first[w + 1] - self.first[w])
            begins = (pos == 0) | (text[pos - 1] != item_text[self.at[which] - 1])
            which, pos, size = which[begins], pos[begins], size[begins].copy()
            going, step = np.arange(len(which)), 16
            while len(going):
                # as many words more as agree; both texts end in words that agree with nothing
                k = size[going, None] + np.arange(step)
                same = text[np.minimum(pos[going, None] + k, len(text) - 1)] == item_text[np.minimum(self.at[which[going], None] + k, len(item_text) - 1)]
                more = np.where(same.all(axis=1), step, same.argmin(axis=1))
                size[going] += more
                going = going[more == step]
                step = min(2 * step, max(16, 1_000_000 // max(1, len(going))))
            yield pos, self.item[which], self.word[which], size


def _spread(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All numbers of every range from ``left`` to ``right``, one range behind the other."""
    n = right - left
    return np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _shard(texts: list[str | None], indexes: Iterable[Windows], with_matches: bool = True) -> tuple[list[int], np.ndarray, list[set], list[list]]:
    """Per text: words, hit words, items, and matches that no longer match of the same item contains."""
    hit, ends, starts = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    items, matches = [set() for _ in texts], [[] for _ in texts]
    lengths: list[int] = []
    for index in indexes:
        get, parts = index.vocabulary.get, []
        for text in texts:
            w = words(text)
            parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), np.zeros(1, np.int32)]
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        if not len(ends):
            lengths = [len(p) for p in parts[::2]]
            ends = np.cumsum(np.array(lengths, np.int64) + 1)
            starts, hit = ends - np.array(lengths, np.int64) - 1, np.zeros(len(ids), bool)
        at, window = index.search(ids)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + index.length[window], -1)
        hit |= np.cumsum(edge[:-1]) > 0
        doc = np.searchsorted(ends, at, "right")
        seen = np.unique(np.stack([doc, window]), axis=1)
        for d, w in seen.T.tolist():
            items[d].update(index.items[i] for i in np.unique(index.item[index.first[w] : index.first[w + 1]]).tolist())
        if with_matches:
            found: dict[tuple, list] = {}
            for pos, item, word, size in index.longest(ids, at, window):
                for d, p, i, t, n in zip(np.searchsorted(ends, pos, "right").tolist(), pos.tolist(), item.tolist(), word.tolist(), size.tolist(), strict=True):
                    found.setdefault((d, i), []).append((p - int(starts[d]), -n, t))
            for (d, i), some in found.items():
                reach = 0
                for p, n, t in sorted(some):
                    if p - n > reach:
                        reach = p - n
                        matches[d].append({"item_id": index.items[i], "doc_word": p, "item_word": t, "n_words": -n})
    n_hit = np.diff(np.append(0, np.cumsum(hit))[np.append(starts, len(hit))]) if len(starts) else np.zeros(len(texts), np.int64)
    return lengths, n_hit, items, matches


def _indexes(docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int) -> Callable[[], Iterator[Windows]]:
    """The benchmark as broadcast blocks; a task goes through them, holding one at a time if there are several."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    mine = [asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [asked]
    known = [spark.sparkContext.broadcast(Windows([tuple(r) for r in m.collect()], size)) for m in mine]

    def each():
        for b in known:
            yield b.value
            if len(known) > 1 and hasattr(b, "_value"):
                del b._value  # read again from the local copy when it is next asked for

    return each


_MATCHES = "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", _MATCH_TYPE)])


def find_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, matches``.

    ``items`` are the ids (strings, sorted) of the items of which a window occurs; ``matches`` the longest verbatim runs
    with their places in document and item: none lies inside another of the same item, and of equal runs at several
    places of an item the first place is named. An item of fewer than ``size`` words is one window; one without words, with
    a null text or a null id occurs nowhere. Null and empty texts have no words. Repeated rows are answered one by one;
    repeated items count once. Other columns are not read; empty tables give no rows, or rows without hits.
    """
    small_batches(docs.sparkSession)
    each = _indexes(docs, benchmark, size, block_bytes)

    def work(batches):
        for rows in by_size(batches, "text", 6 * SHARD_WORDS):
            lengths, n_hit, items, matches = _shard([r[1] for r in rows], each())
            yield record(_FOUND, [[r[0] for r in rows], lengths, n_hit, [sorted(i) for i in items], [sorted(m, key=lambda x: (x["item_id"], x["doc_word"])) for m in matches]])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, f"doc_id long, n_words long, n_hit long, items array<string>, matches {_MATCHES}")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """``docs`` without the rows in whose text a benchmark window occurs; all columns stay.

    Every row is judged by its own text: ids, also null or repeated ones, play no part, and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    each = _indexes(docs, benchmark, size, block_bytes)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, held_chars = [], 0
        for texts in batches:
            held += texts.tolist()
            held_chars += sum(len(t) for t in texts if t)
            if held_chars >= 6 * SHARD_WORDS:
                yield pd.Series(_shard(held, each(), False)[1] == 0)
                held, held_chars = [], 0
        if held:
            yield pd.Series(_shard(held, each(), False)[1] == 0)

    return docs.where(clean(F.col("text").cast("string")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items, with the longest verbatim matches and their places; nulls and repeats are treated as in ``find_matches``."""
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches")
