"""Document fingerprints by winnowing.

Every ``K`` characters in a row have a rolling hash; of every ``WINDOW`` hashes in a row the smallest is chosen, the
rightmost among equals, and its position is kept. Two texts that share ``K + WINDOW - 1`` characters in a row therefore
share a chosen hash, and no match shorter than ``K`` can make one. Hashes are compared by their upper 32 bits first,
so a tie is a tie of those.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table

K = 20
WINDOW = 20
#: Bytes of text in a range of neighbouring documents, and the most ranges there are.
RANGE_BYTES = 8_000_000
MOST_RANGES = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of every ``k`` neighbours, built from those of 1, 2, 4, ... neighbours."""
    one = points.astype(np.uint64) + np.uint64(1)
    total, have, step, width = None, 0, one, 1
    left = k
    while left:
        if left & 1:
            if total is None:
                total, have = step, width
            else:
                n = len(points) - have - width + 1
                total = total[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + step[have : have + n]
                have += width
        left >>= 1
        if left:
            n = len(step) - width
            step = step[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + step[width : width + n]
            width *= 2
    h = total ^ (total >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, ascending. A text shorter than ``k`` is one gram; an empty one has none."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = rolling(points, min(k, len(points)))
    last = np.uint64(0xFFFFFFFF)
    key = (h & ~last) | (last - np.arange(len(h), dtype=np.uint64))
    w = min(window, len(h))
    width = 1
    while width * 2 <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < w:
        key = np.minimum(key[: width - w], key[w - width :])
    chosen = key[np.append(True, key[1:] != key[:-1])]
    at = (last - (chosen & last)).astype(np.int64)
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints (as sets); 1 if both have none."""
    x, y = np.unique(a), np.unique(b)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def digest(hashes: np.ndarray, at: np.ndarray) -> str:
    """A fingerprint as 32 hex digits of its hashes and positions."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + at.astype("<i8").tobytes(), digest_size=16).hexdigest()


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first characters of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` for every row; null texts count as empty. Positions are in characters from 0."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def work(batches):
        for b in batches:
            found = [winnow(t.as_py(), k, window) for t in b.column(1)]
            yield record(schema, [b.column(0), [f[0].view(np.int64) for f in found], [f[1] for f in found]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, hashes array<long>, positions array<long>")


def with_following(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of ids, each ended by a copy of the row that follows its last one.

    Rows are ``part, copied, key, doc_id, text``; a range is in one partition, sorted by descending id (null ids last,
    repeated ids by text), then the copies. After the last range comes the first row of all. Only texts that begin a
    range are sent twice. The driver sees one id for each range.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_RANGES, max(1, math.ceil(size / RANGE_BYTES))))
    place = rows.withColumn("place", F.col("key").cast("double"))
    cuts = sorted(set(place.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] or [])) if parts > 1 else []
    if cuts:
        ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="part").transform(place).withColumn("part", F.col("part").cast("int"))
    else:
        ranged = place.withColumn("part", F.lit(0))
    heads = [tuple(r) for r in ranged.groupBy("part").agg(F.max("key")).orderBy(F.desc("part")).collect()]
    # the first row of a range follows the last row of the range before it; the first of all follows the last of all
    targets = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    copies = spark.createDataFrame(targets, "key long, target int")
    sent = ranged.join(F.broadcast(copies), "key", "left")
    own = F.struct(F.col("part"), F.lit(False).alias("copied"))
    extra = F.struct(F.col("target").alias("part"), F.lit(True).alias("copied"))
    spread = sent.withColumn("to", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    dealt = spread.select("to.part", "to.copied", "key", "doc_id", "text")
    return dealt.repartitionByRange(max(1, len(heads)), "part").sortWithinPartitions("part", "copied", F.desc("key"), "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hashes array<long>, positions array<long>"


def compare_with_edited(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Every row's fingerprint beside that of its edited text (``edited``) and that of the row that follows it.

    ``fingerprint`` names the chosen hashes and their positions, which stand in ``hashes`` and ``positions``; a likeness is
    that of ``likeness`` over such hashes.

    Rows follow one another by descending id; null ids come last, equal ids are ordered by text, and the first row
    follows the last. Null texts count as empty. A table of one row is followed by itself; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def compared(row, following):
        doc_id, text, (h, at) = row
        _, next_text, (nh, _) = following
        changed = edited(text, next_text)
        eh, eat = (h, at) if changed == text else winnow(changed, k, window)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(h, at), digest(eh, eat), likeness(h, eh), likeness(h, nh), h.view(np.int64), at

    def work(batches):
        part, held = None, None
        for b in batches:
            out = []
            for p, copied, _, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, held = p, None
                elif copied and held is None:
                    continue
                row = (doc_id, text, winnow(text, k, window))
                if held is not None:
                    out.append(compared(held, row))
                held = None if copied else row
            if out:
                yield record(_OUT, list(zip(*out, strict=True)))

    return with_following(docs).mapInArrow(work, _OUT_DDL)


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))
