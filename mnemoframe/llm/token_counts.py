"""Token counts of a byte-pair vocabulary without making identifiers.

A piece of text starts as one symbol per byte in a linked list; a heap holds the ranks of adjacent pairs, the lowest
rank (leftmost among equals) is merged until no pair has a rank, and the count is symbols minus merges. Counts of pieces
that recur are remembered in the worker process, within a bound.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table

#: The published split of byte-level vocabularies: contractions, letters, digits, other signs, white space. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker remembers.
REMEMBERED = 1_000_000


def byte_symbols() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def splits_at_spaces(spec: dict) -> bool:
    """Whether a vocabulary (its JSON) has the byte-level split alone, so that words behind single spaces stand for themselves."""
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    return plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)


class PairCounter:
    """Counts tokens by ranks of merges read from a ``tokenizers`` JSON file with a byte-level BPE model.

    ``ValueError`` for a vocabulary that is split or normalised in another way.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type") != "BPE" or not splits_at_spaces(spec):
            raise ValueError("no byte-level BPE vocabulary with the published split")
        vocab = spec["model"]["vocab"]
        self.start = [vocab[s] for s in byte_symbols()]
        self.base = max(vocab.values()) + 1
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault(vocab[left] * self.base + vocab[right], (rank, vocab[left + right]))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.odd = regex.compile(r" \s| $")
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def piece(self, data: bytes) -> int:
        """Tokens of one piece: its bytes minus the merges made."""
        symbol = [self.start[b] for b in data]
        n = len(symbol)
        if n < 2:
            return n
        merge, base = self.merge, self.base
        heap = [(m[0], i) for i in range(n - 1) if (m := merge.get(symbol[i] * base + symbol[i + 1]))]
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count = n
        while heap:
            rank, i = heappop(heap)
            if symbol[i] < 0 or (j := after[i]) >= n:
                continue
            m = merge.get(symbol[i] * base + symbol[j])
            if m is None or m[0] != rank:
                continue
            count -= 1
            symbol[i], symbol[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get(symbol[i] * base + symbol[k]):
                    heappush(heap, (m[0], i))
            h = before[i]
            if h >= 0 and (m := merge.get(symbol[h] * base + symbol[i])):
                heappush(heap, (m[0], h))
        return count

    def _pieces(self, text: str) -> int:
        known, total = self.pieces, 0
        for p in self.split.findall(text):
            n = known.get(p)
            if n is None:
                n = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) < 64:
                    if len(known) >= REMEMBERED // 2:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        # A single space before a word always begins a piece, so words can be counted one by one.
        if self.odd.search(text):
            return self._pieces(text)
        known, total = self.chunks, 0
        head, *rest = text.split(" ")
        total = self._pieces(head)
        for w in rest:
            n = known.get(w)
            if n is None:
                n = self._pieces(" " + w)
                if len(w) < 64:
                    if len(known) >= REMEMBERED // 2:
                        known.clear()
                    known[w] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; the vocabulary's added tokens count one each where their strings stand in it."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        found, at, total = 0, 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) if m.start() > at else 0
            found, at = found + 1, m.end()
        return total + found + (self._plain(text[at:]) if at < len(text) else 0)


@lru_cache(maxsize=2)
def _counter(path: str) -> PairCounter:
    return PairCounter(path)


def token_counts(docs: DataFrame, vocabulary: str | Callable[[], str]) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row of ``docs``; null texts count as empty.

    ``vocabulary`` is the path of the JSON file on the workers, or a function that gives it there. Repeated rows and
    null ids are answered as they stand; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def work(batches):
        counter = _counter(vocabulary if isinstance(vocabulary, str) else vocabulary())
        for b in batches:
            counts = np.fromiter((counter.count(t.as_py()) for t in b.column(2)), np.int64, b.num_rows)
            yield record(schema, [b.column(0), b.column(1), counts])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Longest text, in tokens, that is not over the limit.
TOKEN_LIMIT = 512


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_vocabulary)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
