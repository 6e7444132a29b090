"""Token-id files: documents encoded, ended, coded in frames, and read back.

A table of frames is written as Parquet in a folder of any store that Spark reaches. A shard is one range of ``doc_id``;
its frames hold whole documents in ascending order of id, and a frame is ``MAGIC``, the directory of its documents (ids
and lengths) with a CRC-32, and blocks of ``idcoder``. Frames are read independently of each other.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemoframe.llm import idcoder
from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.llm.token_counts import SPLIT, byte_symbols, public_vocabulary, splits_at_spaces
from mnemoframe.scratch import new_path

END_ID = 2
MAGIC = b"MFT1"
#: Ids gathered before a task codes them, and ids after which a frame is closed.
IDS_AT_ONCE, FRAME_IDS = idcoder.BLOCK * idcoder.LANES, 16 * idcoder.BLOCK
#: Words that an encoder remembers, twice over.
_REMEMBERED = 400_000
_ODD, _WORD = re.compile(r" \s| $"), re.compile(r" (?=\S)")
#: Words that are cut into pieces here: ASCII and Latin signs that are the same in every version of Unicode.
_LATIN = re.compile(r"[\t\n\r -~\xa1-\u024f]*").fullmatch
_PIECES = regex.compile(SPLIT).findall
_STAND_INS = dict(enumerate(byte_symbols()))
_HEAD = struct.Struct("<4sIIII")  # magic, documents, blocks, bytes of the directory, CRC-32 of the directory
_FRAME_DDL = "shard int, frame int, first_token long, n_tokens long, payload binary"
_FRAME = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library; words that recur are remembered, within a bound.

    Words are asked alone only where that gives the ids of the whole text: with a byte-level split, no normalizer and
    added tokens that take no white space. Other vocabularies are asked for whole texts. Words of Latin signs are cut
    into the pieces of that split here, and the library's model is asked for a piece, without its own split and the
    places in the text that it keeps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_at_spaces(json.load(f))
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)").search
        self.model = self.library.model
        #: What was asked lately, and what was asked before that.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each with the space before it."""
        one, found, rest, space = self.model.tokenize, {}, [], _STAND_INS[32]
        for w in words:
            if self.added(w):
                rest.append(w)
                continue
            if w.isascii() and w.isalpha():
                ids = [t.id for t in one(space + w)]
            elif _LATIN(w):
                pieces = (" " + w,) if w.isalpha() else _PIECES(" " + w)
                ids = [t.id for p in pieces for t in one(p.encode().decode("latin-1").translate(_STAND_INS))]
            else:
                rest.append(w)
                continue
            found[w] = array("I", ids).tobytes()
        found.update(zip(rest, self._ask([" " + w for w in rest]), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. Null is empty."""
        if not self.by_words:
            return self._ask([t or "" for t in texts])
        # A space before a sign that is no white space always begins a new piece of the byte-level split.
        split = [(_WORD.split(t) if _ODD.search(t) else t.split(" ")) if t else [] for t in texts]
        known = self.known
        wanted = set().union(*(s[1:] for s in split))
        new = wanted - known.keys()
        if len(known) + len(new) > _REMEMBERED:
            self.known, self.before = {}, known
            known, new = self.known, wanted
        if self.before:
            seen = new & self.before.keys()
            known.update(zip(seen, map(self.before.__getitem__, seen), strict=True))
            new = new - seen
        known.update(self._words(list(new)))
        starts = iter(self._ask([s[0] for s in split if s]))
        return [b"".join([next(starts), *map(known.__getitem__, s[1:])]) if s else b"" for s in split]


class RankEncoder:
    """The same from a table of ranks (base64 of the bytes, and the id, on a line), by the ``tiktoken`` library.

    ``pattern`` splits texts into pieces; strings of ``special`` in a text have their own ids.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        one = self.library.encode_to_numpy
        return [one(t, allowed_special="all").astype("<u4", copy=False).tobytes() if t else b"" for t in texts]


@lru_cache(maxsize=1)
def public_encoder() -> RankEncoder:
    """The vocabulary of ``public_vocabulary`` from its table of ranks, which is faster; its added token comes last."""
    import public_tokenizers

    return RankEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks share what it remembers."""
    return Encoder(path)


def pack_frames(docs: list[tuple[int | None, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """``(ids, payload)`` of frames for documents in order; the blocks of all frames are coded side by side."""
    frames: list[list] = [[]]
    held = 0
    for doc in docs:
        if held >= FRAME_IDS:
            frames.append([])
            held = 0
        frames[-1].append(doc)
        held += len(doc[1])
    streams = [np.concatenate([np.empty(0, np.uint32), *(d[1] for d in f)]) for f in frames]
    cut = [[s[i : i + idcoder.BLOCK] for i in range(0, len(s), idcoder.BLOCK)] for s in streams]
    coded = iter(idcoder.encode_blocks([b for c in cut for b in c]))
    for docs_here, stream, blocks in zip(frames, streams, cut, strict=True):
        named = np.array([d[0] is not None for d in docs_here], np.uint8)
        ids = np.array([d[0] or 0 for d in docs_here], "<i8")
        lengths = np.array([len(d[1]) for d in docs_here], "<u4")
        directory = zlib.compress(named.tobytes() + ids.tobytes() + lengths.tobytes(), 6)
        body = [struct.pack("<I", len(b)) + b for b in (next(coded) for _ in blocks)]
        yield len(stream), _HEAD.pack(MAGIC, len(docs_here), len(blocks), len(directory), zlib.crc32(directory)) + directory + b"".join(body)


def unpack_frames(payloads: list[bytes]) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The documents of each frame; ``ValueError`` if a frame is damaged."""
    heads, blocks = [], []
    for data in payloads:
        magic, docs, n, size, crc = _HEAD.unpack_from(data)
        packed = data[_HEAD.size : _HEAD.size + size]
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("directory of a frame is damaged")
        plain = zlib.decompress(packed)
        named, ids, lengths = np.frombuffer(plain, np.uint8, docs), np.frombuffer(plain, "<i8", docs, docs), np.frombuffer(plain, "<u4", docs, 9 * docs)
        at = _HEAD.size + size
        for _ in range(n):
            (length,) = struct.unpack_from("<I", data, at)
            blocks.append(data[at + 4 : at + 4 + length])
            at += 4 + length
        heads.append((named, ids, lengths, n))
    plain_blocks = iter(idcoder.decode_blocks(blocks))
    for named, ids, lengths, n in heads:
        stream = np.concatenate([np.empty(0, np.uint32), *(next(plain_blocks) for _ in range(n))])
        if len(stream) != int(lengths.sum(dtype=np.int64)):
            raise ValueError("a frame holds another number of ids than its directory says")
        ends = np.cumsum(lengths, dtype=np.int64)
        yield [(int(i) if k else None, stream[e - m : e]) for k, i, m, e in zip(named, ids, lengths, ends, strict=True)]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | Callable[[], str], end_id: int = END_ID) -> None:
    """Writes the ids of every row of ``docs`` in ascending order of ``doc_id`` to the folder ``path``.

    Each text is encoded whole (null: empty) and ended by ``end_id``. Repeated rows are written as often as they occur;
    rows of one id are ordered by text, null ids come first. Other columns are not read. An empty table makes an empty
    folder that can be read.
    """
    small_batches(docs.sparkSession)

    def work(batches):
        from pyspark import TaskContext

        shard, frame, first = TaskContext.get().partitionId(), 0, 0
        words = encoder(vocabulary if isinstance(vocabulary, str) else vocabulary())
        ending = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []
        size = 0

        def packed():
            nonlocal frame, first
            for n, payload in pack_frames(held):
                yield record(_FRAME, [[shard], [frame], [first], [n], [payload]])
                frame, first = frame + 1, first + n

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                held.append((doc_id, np.frombuffer(ids + ending, "<u4")))
                size += len(held[-1][1])
                if size >= IDS_AT_ONCE:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(work, _FRAME_DDL).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document in ``path``, ascending by shard.

    ``start`` counts the ids of all documents before it. Sizes of shards, a row each, are added up in one task.
    """
    small_batches(spark)
    frames = spark.read.schema(_FRAME_DDL).parquet(path)
    shards = frames.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    placed = frames.join(F.broadcast(before), "shard").select((F.col("before") + F.col("first_token")).alias("first"), "n_tokens", "payload")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def rows(held):
        for (first, _, _), docs in zip(held, unpack_frames([h[2] for h in held]), strict=True):
            for doc_id, ids in docs:
                yield (doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] * with_ids))
                first += len(ids)

    def work(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += row[1]
                if size >= IDS_AT_ONCE:
                    yield record(schema, list(zip(*rows(held), strict=True)))
                    held, size = [], 0
        if held:
            yield record(schema, list(zip(*rows(held), strict=True)))

    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_vocabulary)
    return read_tokens(spark, path, with_ids=False)
