"""Best-fit packing of documents into sequences of several permitted lengths.

Texts become token ids; documents longer than the largest length are cut into pieces. A task packs the pieces of about
``PACK_IDS`` ids together: longest first, each into the open bin that it fills best; if none has room, a bin opens whose
length costs least for what it will probably hold; at the end every bin shrinks to the smallest permitted length that
holds its contents. The cost of a sequence of ``n`` tokens is ``FIXED + n + n * n / QUADRATIC``: what every sequence
costs, linear layers, and attention. Sequences are written with their ids and the places of the documents in them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.llm.token_files import END_ID, Encoder, RankEncoder, public_encoder
from mnemoframe.scratch import new_path

Encodes = Encoder | RankEncoder
LENGTHS = (2048, 4096, 8192, 16384)
#: Ids that are packed together.
PACK_IDS = 8_000_000
FIXED, QUADRATIC = 256, 65_536


def cost(n: int) -> float:
    return FIXED + n + n * n / QUADRATIC


class _Rooms:
    """Open bins by free space; ``best(n)`` gives the fullest bin with room for ``n``."""

    def __init__(self, most: int):
        self.bits = 1 << most.bit_length()
        self.tree = np.zeros(2 * self.bits, np.int64).tolist()
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, free: int, n: int) -> None:
        k = free + self.bits
        while k:
            self.tree[k] += n
            k >>= 1

    def put(self, free: int, which: int) -> None:
        self.bins[free].append(which)
        if len(self.bins[free]) == 1:
            self._add(free, 1)

    def best(self, n: int) -> tuple[int, int] | None:
        tree, k = self.tree, n + self.bits
        while not tree[k]:
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.bits:
            k *= 2
            if not tree[k]:
                k += 1
        free = k - self.bits
        if free >= len(self.bins):
            return None
        which = self.bins[free].pop()
        if not self.bins[free]:
            self._add(free, -1)
        return free, which


def open_length(piece: int, left: int, mean: float, lengths: Sequence[int]) -> int:
    """The permitted length to open for ``piece`` when ``left`` tokens, itself included, in pieces of ``mean`` are unpacked.

    A bin is expected to be filled but for half a mean piece, and at most by what is left; the length that then costs
    least a token is taken, the smaller one among equals.
    """
    best, price = lengths[-1], math.inf
    for n in lengths:
        if n >= piece:
            filled = min(max(piece, n - mean / 2), left)
            if (now := cost(n) / filled) < price - 1e-12:
                best, price = n, now
    return best


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and length of the bin of every piece. Pieces of size 0 go with the first bin."""
    lengths = sorted(lengths)
    sizes = np.asarray(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms, used, size_of = _Rooms(lengths[-1]), [], []
    left = int(sizes.sum())
    for rest, k in zip(range(len(sizes), 0, -1), order.tolist(), strict=True):
        n = int(sizes[k])
        found = rooms.best(n)
        if found is None:
            which, free = len(used), open_length(n, max(left, 1), left / rest, lengths)
            used.append(0)
            size_of.append(free)
        else:
            free, which = found
        where[k], offset[k] = which, used[which]
        used[which] += n
        rooms.put(free - n, which)
        left -= n
    fit = [next(n for n in lengths if n >= u) for u in used]
    return where, offset, np.array(fit, np.int64)[where] if used else where


_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("piece_start", pa.int64()), ("n_tokens", pa.int32()), ("bin_offset", pa.int32())])
_SEQUENCE = pa.schema([("bin_id", pa.int64()), ("bin_length", pa.int32()), ("pieces", pa.list_(_PIECE)), ("tokens", pa.binary())])
_SEQUENCE_DDL = "bin_id long, bin_length int, pieces array<struct<doc_id:long,piece:int,piece_start:long,n_tokens:int,bin_offset:int>>, tokens binary"


def fill(held: list[tuple], first_bin: int, lengths: Sequence[int] = LENGTHS) -> pa.RecordBatch:
    """Sequences of ``(doc_id, piece, piece_start, ids)``, ids as little-endian 32-bit integers."""
    where, offset, length = pack([len(h[3]) // 4 for h in held], lengths)
    order = np.lexsort((offset, where)).tolist()
    bins: list[list[int]] = [[] for _ in range(int(where.max(initial=-1)) + 1)]
    for k in order:
        bins[where[k]].append(k)
    pieces = [[(*held[k][:3], len(held[k][3]) // 4, int(offset[k])) for k in b] for b in bins]
    named = [[dict(zip(_NAMES, p, strict=True)) for p in b] for b in pieces]
    return record(_SEQUENCE, [range(first_bin, first_bin + len(bins)), [int(length[b[0]]) for b in bins], named, [b"".join(held[k][3] for k in b) for b in bins]])


_NAMES = [f.name for f in _PIECE]


def sequences(docs: DataFrame, vocabulary: Callable[[], Encodes] = public_encoder, lengths: Sequence[int] = LENGTHS, end_id: int = END_ID, pack_ids: int = PACK_IDS) -> DataFrame:
    """Packed sequences of the token ids of ``docs``: ``bin_id, bin_length, pieces, tokens``.

    Every text is encoded whole (null: empty) by what ``vocabulary`` gives in a task, and ended by ``end_id``; ids of a document longer than the largest of
    ``lengths`` are cut there. ``tokens`` holds the ids of a sequence, little-endian 32-bit, without padding, and
    ``pieces`` says which document stands where: ``piece_start`` counts ids of the document, ``bin_offset`` ids of the sequence.
    Repeated rows are packed as often as they occur; null ids keep their rows; other columns are not read; an empty table
    gives no rows. Nothing is shuffled: a task packs what it reads, in packs of about ``pack_ids`` ids, and a task that is
    run again reads the same and makes the same.
    """
    small_batches(docs.sparkSession)
    most = 4 * max(lengths)

    def work(batches):
        from pyspark import TaskContext

        words = vocabulary()
        end = int(end_id).to_bytes(4, "little")
        first, held, size = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                held += [(doc_id, k, at // 4, ids[at : at + most]) for k, at in enumerate(range(0, len(ids), most))]
                size += len(ids) // 4
                if size >= pack_ids:
                    out = fill(held, first, lengths)
                    yield out
                    first, held, size = first + out.num_rows, [], 0
        if held:
            yield fill(held, first, lengths)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, _SEQUENCE_DDL)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of the sequences written in ``path``: ``doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_length, ids_crc32``.

    ``ids_crc32`` is that of the piece's ids as they stand in the file.
    """
    small_batches(spark)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("piece_start", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64()), ("bin_length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields)

    def rows(batch):
        for bin_id, length, pieces, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for p in pieces:
                ids = tokens[4 * p["bin_offset"] : 4 * (p["bin_offset"] + p["n_tokens"])]
                if len(ids) != 4 * p["n_tokens"]:
                    raise ValueError(f"sequence {bin_id} is cut off")
                yield p["doc_id"], p["piece"], p["piece_start"], p["n_tokens"], bin_id, p["bin_offset"], length, zlib.crc32(ids)

    def work(batches):
        for b in batches:
            found = list(rows(b))
            if found:
                yield record(schema, list(zip(*found, strict=True)))

    return spark.read.schema(_SEQUENCE_DDL).parquet(path).mapInArrow(work, "doc_id long, piece int, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: Callable[[], Encodes] = public_encoder, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """Writes the sequences of ``docs`` in the shared folder and gives their pieces as read back; see ``sequences``."""
    path = new_path(docs.sparkSession, "sequences")
    sequences(docs, vocabulary, lengths).write.parquet(path)
    return read_sequences(docs.sparkSession, path)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
