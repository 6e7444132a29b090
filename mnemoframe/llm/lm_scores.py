"""Language-model scores by a weighted automaton with failure arcs.

The model is an n-gram model of order ``ORDER`` over all learning texts, smoothed towards the next shorter context:
P(w | h) = (c(h w) + PRIOR P(w | h')) / (c(h) + PRIOR), and at the empty context (c(w) + 1) / (N + V + 1), so the
probabilities of every context add up to 1. As an automaton, a state is a context that was seen, an arc a seen n-gram with
the log of its probability, and a failure arc, with the log of PRIOR / (c(h) + PRIOR), leads to the context without its
first word. A text is scored by one walk from left to right that carries the state and adds the weights it meets.

The counts are of any size, so no task holds them all. Documents are dealt into chunks of about ``CHUNK_BYTES``. A chunk
sends the hashes of its different n-grams with their counts in its learning texts, in runs for each stretch of hash
values; a stretch adds up what all chunks sent, and sends every chunk the totals of what it asked. Each chunk then builds
the part of the automaton that its texts can reach, and walks it. A frequent word or n-gram is one entry a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.llm.word_hashes import Words, mix

ORDER = 2
#: How many observations the shorter context is worth.
PRIOR = 64.0
CHUNK_BYTES = 4_000_000
#: Entries that one stretch of hash values gets, by estimate.
STRETCH_ENTRIES = 4_000_000
#: A word has six bytes or so.
_WORD_BYTES = 6

WORDS = Words(b" \t\n\x0b\x0c\r")
_START, _END, _STEP = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543211), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 7; false for null ids, which are not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


class Grams:
    """The n-grams of some texts: a text's words stand between a start and an end.

    ``sizes[k - 1]`` has the hash of the n-gram of k words that ends at each position and ``valid`` whether the text has one.
    """

    def __init__(self, texts: pa.Array, order: int):
        found, begin = WORDS.hashes(texts)
        n = np.diff(begin)
        self.begin = np.append(0, np.cumsum(n + 2))
        tokens = np.empty(self.begin[-1], np.uint64)
        word = np.ones(len(tokens), bool)
        word[self.begin[:-1]] = word[self.begin[1:] - 1] = False
        tokens[self.begin[:-1]], tokens[self.begin[1:] - 1], tokens[word] = _START, _END, found
        self.text = np.repeat(np.arange(len(n)), n + 2)
        self.place = np.arange(len(tokens)) - np.repeat(self.begin[:-1], n + 2)
        self.sizes, self.valid = [tokens], [np.ones(len(tokens), bool)]
        for k in range(2, order + 1):
            before = np.append(np.uint64(0), self.sizes[-1][:-1])
            self.sizes.append(mix(before * _STEP + tokens))
            self.valid.append(self.place >= k - 1)


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of bytes: the planes that are the same all along take no room."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _runs(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sorted entries in runs of one stretch each, which the first ``bits`` of a hash name: stretch, entries, steps, counts."""
    stretch = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    cut = np.append(np.flatnonzero(np.diff(stretch, prepend=stretch[:1] + np.uint64(1))), len(hashes)) if len(hashes) else [0]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(stretch[lo]), int(hi - lo), _pack(np.diff(hashes[lo:hi], prepend=np.uint64(0))), _pack(counts[lo:hi].astype(np.int64))


def _summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The totals of all entries of a stretch, and for each entry that was sent the place of its total."""
    n, steps, counts = (t.column(c).to_pylist() for c in ("n", "steps", "counts"))
    hashes = np.concatenate([np.cumsum(_unpack(x, k, np.uint64), dtype=np.uint64) for x, k in zip(steps, n, strict=True)])
    different, of = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(different), np.int64)
    np.add.at(total, of, np.concatenate([_unpack(x, k, np.int64) for x, k in zip(counts, n, strict=True)]))
    return total, of


def _bits(entries: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, entries / STRETCH_ENTRIES))))


_VOCABULARY = pa.schema([("stretch", pa.int64()), ("n", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])
_SIZE = pa.schema([("words", pa.int64()), ("tokens", pa.int64())])


def vocabulary(docs: DataFrame, bits: int) -> tuple[int, int]:
    """Different tokens (words and the end) and all tokens of the learning texts."""

    def flush(held):
        h, n = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        counts = np.bincount(n, weights=np.concatenate([x[1] for x in held]), minlength=len(h))
        return record(_VOCABULARY, list(zip(*_runs(h, counts, bits), strict=True)))

    def work(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            tokens = Grams(b.column(0), 1)
            held.append(np.unique(tokens.sizes[0][tokens.place > 0], return_counts=True))
            size += len(held[-1][0])
            if size > STRETCH_ENTRIES // 2:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def merged(t: pa.Table) -> pa.Table:
        totals, _ = _summed(t)
        return pa.table([[int((totals > 0).sum())], [int(totals.sum())]], schema=_SIZE)

    sent = docs.where("learned").select("text").mapInArrow(work, "stretch long, n long, steps binary, counts binary")
    row = sent.groupBy("stretch").applyInArrow(merged, "words long, tokens long").agg(F.sum("words"), F.sum("tokens")).first()
    return row[0] or 0, row[1] or 0


class Automaton:
    """States and arcs for the n-grams of some texts.

    State 0 is the empty context, state e + 1 the context that is entry e. ``arcs`` leads from (state, word) to an entry, whose
    ``weight`` is added and whose ``target`` is the next state; ``fail`` and ``fail_weight`` are those of states. Every word
    of the texts has an arc at state 0, so a walk always goes on.
    """

    def __init__(self, grams: Grams, entry: list[np.ndarray], total: np.ndarray, words: int, tokens: int, prior: float):
        order, m = len(grams.sizes), len(total)
        self.n = m
        probability = np.full(m, 1.0 / (tokens + words + 1))
        self.target = np.zeros(m, np.int64)
        self.fail = np.zeros(m + 1, np.int64)
        self.fail_weight = np.append(0.0, np.log10(prior / (total + prior)))
        keys, values = [], []
        for k in range(1, order + 1):
            # one place of every entry of this size; what its first and last words are follows from the places around
            at = np.flatnonzero(grams.valid[k - 1] & (grams.place > 0))
            e, first = np.unique(entry[k - 1][at], return_index=True)
            at = at[first]
            if k == 1:
                probability[e] = (total[e] + 1) / (tokens + words + 1)
                seen = total[e] > 0
                self.target[e[seen]] = e[seen] + 1 if order > 1 else 0
                keys.append(e)
                values.append(e)
                continue
            known = total[e] > 0
            e, at = e[known], at[known]
            context, shorter = entry[k - 2][at - 1], entry[k - 2][at]
            probability[e] = (total[e] + prior * probability[shorter]) / (total[context] + prior)
            self.target[e] = shorter + 1 if k == order else e + 1
            if k < order:
                self.fail[e + 1] = shorter + 1
            keys.append((context + 1) * m + entry[0][at])
            values.append(e)
        self.arcs = dict(zip(np.concatenate(keys).tolist(), np.concatenate(values).tolist(), strict=True))
        self.weight = np.log10(probability)

    def walk(self, start: int, words: list[int]) -> float:
        """The sum of the weights from state ``start`` over ``words`` (entries of single words)."""
        arcs, weight, target, fail, fail_weight, n = self.tables
        state, total = start, 0.0
        for w in words:
            arc = arcs(state * n + w)
            while arc is None:
                total += fail_weight[state]
                state = fail[state]
                arc = arcs(state * n + w)
            total += weight[arc]
            state = target[arc]
        return total

    @property
    def tables(self):
        if not hasattr(self, "_tables"):
            self._tables = self.arcs.get, self.weight.tolist(), self.target.tolist(), self.fail.tolist(), self.fail_weight.tolist(), self.n
        return self._tables


def _entries(grams: Grams) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different hashes of all sizes, sorted, and the place of each position's n-gram in them."""
    flat = np.concatenate([h[v] for h, v in zip(grams.sizes, grams.valid, strict=True)])
    hashes, of = np.unique(flat, return_inverse=True)
    out, at = [], 0
    for v in grams.valid:
        mine = np.full(len(v), -1, np.int64)
        mine[v] = of[at : at + int(v.sum())]
        out.append(mine)
        at += int(v.sum())
    return hashes, out


_SENT = pa.schema([("stretch", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("stretch", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("totals", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, learned, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``learned`` is a column that says which rows the model counts; ``held_out`` is its opposite, but for rows whose doc_id is
    null, where both are false. Null and empty texts have one token, the end. Repeated rows count and are scored one by one.
    Other columns are not read. Without learning rows every token has probability 1. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_id = F.col("doc_id").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (has_id & learned).alias("learned"), (has_id & ~learned).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).cast("long"), F.count(F.lit(1))).first()
    n_tokens = (size[0] or 0) / _WORD_BYTES + size[1]
    words, tokens = vocabulary(rows, _bits(n_tokens))
    chunks = max(1, math.ceil(((size[0] or 0) + 20 * size[1]) / CHUNK_BYTES))
    bits = _bits(order * n_tokens)
    # the same exchange serves both readers below
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk")

    def send(t: pa.Table) -> pa.Table:
        grams = Grams(t.column("text").combine_chunks(), order)
        hashes, entry = _entries(grams)
        counted = t.column("learned").to_numpy()[grams.text]
        counts = sum(np.bincount(e[v & counted], minlength=len(hashes)) for e, v in zip(entry, grams.valid, strict=True))
        runs = list(zip(*_runs(hashes, counts, bits), strict=True))
        chunk = t.column("chunk")[0].as_py()
        return pa.table([list(runs[0]), [chunk] * len(runs[0]), *map(list, runs[1:])], schema=_SENT)

    def answer(t: pa.Table) -> pa.Table:
        totals, of = _summed(t)
        back = np.split(totals[of], np.cumsum(t.column("n").to_numpy())[:-1])
        return pa.table([t.column("stretch"), t.column("chunk"), t.column("n"), [_pack(x) for x in back]], schema=_BACK)

    def walked(t: pa.Table, back: pa.Table) -> pa.Table:
        grams = Grams(t.column("text").combine_chunks(), order)
        hashes, entry = _entries(grams)
        back = back.sort_by("stretch")
        total = np.concatenate([_unpack(x, k, np.int64) for x, k in zip(back.column("totals").to_pylist(), back.column("n").to_pylist(), strict=True)])
        machine = Automaton(grams, entry, total, words, tokens, prior)
        own, begin, token = entry[0], grams.begin, grams.place > 0
        context = own[begin[:-1]]
        start = np.where((total[context] > 0) & (order > 1), context + 1, 0)
        known = np.append(0, np.cumsum((total[own] > 0) & token))[begin]
        base = np.add.reduceat(np.where(token, np.log10((total[own] + 1) / (tokens + words + 1)), 0.0), begin[:-1])
        flat = own.tolist()
        found = [machine.walk(s, flat[lo + 1 : hi]) for s, lo, hi in zip(start.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        n = np.diff(begin) - 1
        return pa.table([t.column("doc_id"), t.column("held_out"), n, np.diff(known), np.full(len(n), tokens), base, found], schema=_SCORED)

    sent = dealt.groupBy("chunk").applyInArrow(send, "stretch long, chunk long, n long, steps binary, counts binary")
    answers = sent.groupBy("stretch").applyInArrow(answer, "stretch long, chunk long, n long, totals binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(walked, _SCORED_SQL)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those that are not held out; nulls and repeats are treated as in ``score``."""
    return score(table(spark, sf_dir, "documents"), ~held_out())
