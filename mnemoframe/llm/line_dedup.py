"""Line deduplication within an edit bound of one character, by a deletion-neighbourhood join.

A line is compared without white space at its ends. It is removed if an equal line, or one that becomes equal by
inserting, deleting or replacing one character, stands earlier in the corpus: by ``doc_id`` (null ids last), texts of one
id by their hash, then by line number. The earlier line need not stay itself: of three lines, each one edit from the one
before, the first alone stays. Every line but blank ones is compared; a caller may ask for a least length.

Two lines within the bound meet in a variant: both without the character at one position, or the longer one without a
character and the shorter one as it is. Every line emits the hashes of its variants as keys, tagged so that all lines
with one position key are within the bound of each other, and a deletion key links only its full line with the others.
The earliest line of a key is therefore all that the others need to be compared with, no pairs within a key are made, and
a key has at most as many lines as the alphabet and the length allow. Candidates are verified by edit distance.

Which lines need variants at all is decided before, without loss: two lines within the bound agree in their first or in
their second half, so a line emits only the variants on the other side of a half that another line has too. Everything
but the variants, which few lines need, is made of built-in functions. Equal lines are equal in two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemoframe.llm.common import small_batches, table
from mnemoframe.scratch import discard, written

#: Rows of a lookup that is broadcast (16 bytes a key); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_BLANK = " \t\r"
_LAST = (1 << 63) - 1

_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (1_000_003, 998_244_353)
#: Characters of lines hashed together, and positions whose variants are made together.
_AT_ONCE = 200_000


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the base and of its inverse, for both primes, up to exponent ``n``."""
    out = []
    for p, b in zip(_PRIMES, _BASES, strict=True):
        pair = []
        for base in (b, pow(b, -1, int(p))):
            w = np.ones(1, np.uint64)
            while len(w) <= n:
                w = np.concatenate([w, w * np.uint64(pow(base, len(w), int(p))) % p])
            pair.append(w[: n + 1])
        out.append(tuple(pair))
    return out


class _Hashed:
    """Hashes of many lines, whole or without a character; sums run over all lines one behind the other."""

    def __init__(self, lines: list[str]):
        self.n = np.array([len(x) for x in lines], np.int64)
        self.start = np.cumsum(self.n) - self.n
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        at = np.arange(len(points)) - np.repeat(self.start, self.n)
        self.powers = _powers(int(self.n.max(initial=0)) + 1)
        self.sums = [np.append(np.uint64(0), np.cumsum(points * w[at] % p, dtype=np.uint64)) for p, (w, _) in zip(_PRIMES, self.powers, strict=True)]

    def whole(self, line: np.ndarray) -> list[np.ndarray]:
        """Residues of each ``line``."""
        s = self.start[line]
        return [(t[s + self.n[line]] - t[s]) % p for t, p in zip(self.sums, _PRIMES, strict=True)]

    def without(self, line: np.ndarray, i: np.ndarray) -> list[np.ndarray]:
        """Residues of each ``line`` without its character ``i``."""
        s, n = self.start[line], self.n[line]
        return [((t[s + i] - t[s]) + (t[s + n] - t[s + i + 1]) % p * inv[1]) % p for t, p, (_, inv) in zip(self.sums, _PRIMES, self.powers, strict=True)]


def _key(residues: list[np.ndarray], length: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    """A 64-bit key of a hash, a length and what kind of key it is."""
    x = (residues[0] << np.uint64(31)) ^ residues[1]
    for y in (length, tag):
        x = (x ^ np.asarray(y).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def variant_keys(lines: list[str], sides: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(line, key, role)`` in runs: keys of variants on the sides asked for; bit k of ``sides`` stands for half key k.

    Roles: 0 without the character at a position, 1 a whole line, 2 a line with one character deleted.
    """
    h = _Hashed(lines)
    want = np.array(sides, np.int64)
    whole = np.flatnonzero(want & 12)
    yield whole, _key(h.whole(whole), h.n[whole], 3), np.ones(len(whole), np.int32)
    cut = h.n // 2
    lo = np.where(want & 2, 0, cut)  # a shared second half leaves the first half to change
    hi = np.where(want & 1, h.n, cut)
    count = np.maximum(hi - lo, 0)
    before = np.cumsum(count) - count
    for at in range(0, int(count.sum()), _AT_ONCE):
        k = np.arange(at, min(at + _AT_ONCE, int(count.sum())))
        line = np.searchsorted(before + count, k, "right")
        i = k - before[line] + lo[line]
        v = h.without(line, i)
        keys = np.concatenate([_key(v, h.n[line], i + 16), _key(v, h.n[line] - 1, 3)])
        yield np.tile(line, 2), keys, np.repeat(np.array([0, 2], np.int32), len(k))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """``doc, tk, line_no, line, h, g`` of lines long enough: id and hash of the text, and two hashes of the line."""
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    cut = docs.select(doc, F.xxhash64(text).alias("tk"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    trimmed = cut.select("doc", "tk", "line_no", F.btrim("raw", F.lit(_BLANK)).alias("line")).where(F.length("line") >= max(1, least))
    return trimmed.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def _half_keys(least: int) -> list:
    """Four keys of ``line``: first and second half, as the longer of a pair and as the shorter one.

    A pair whose longer line has m characters is cut after m // 2 from the front, and before the other m - m // 2 from
    the back. Lines under ``least`` characters have no keys.
    """
    n, out = F.length("line"), []
    for m in (n, n + 1):
        a = F.floor(m / 2).cast("int")
        out += [F.xxhash64(F.left("line", a), m, F.lit(1)), F.xxhash64(F.right("line", m - a), m, F.lit(2))]
    return [F.when(n >= least, k) for k in out]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _near(docs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``h, g`` of classes that have an earlier class within the bound."""
    keyed = classes.where(F.col("k0").isNotNull()).select("h", "g", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "key"))
    shared = written(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where(F.col("lo") != F.col("hi")).select("key"), "halves")
    asked = written(keyed.join(_small(shared), "key").groupBy("h", "g").agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("sides")), "asked")
    place = F.struct("doc", "tk", "line_no")
    found = _lines(docs, least).join(_small(asked), ["h", "g"]).groupBy("h", "g").agg(F.min(place).alias("first"), F.any_value("sides").alias("sides"), F.any_value("line").alias("line"))
    texts = written(found.select("h", "g", "first.*", "sides", "line"), "texts")
    schema = pa.schema([("key", pa.int64()), ("role", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("tk", pa.int64()), ("line_no", pa.int32())])

    def work(batches):
        for b in batches:
            lines, sides = b.column(6).to_pylist(), b.column(5).to_pylist()
            lo = 0
            while lo < len(lines):
                hi, size = lo, 0
                while hi < len(lines) and (hi == lo or size + len(lines[hi]) <= _AT_ONCE):
                    size += len(lines[hi])
                    hi += 1
                for line, key, role in variant_keys(lines[lo:hi], sides[lo:hi]):
                    at = pa.array(line + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), *(b.column(k).take(at) for k in range(5))], schema=schema)
                lo = hi

    variants = texts.select("h", "g", "doc", "tk", "line_no", "sides", "line").mapInArrow(work, "key long, role int, h long, g long, doc long, tk long, line_no int")
    me, group = F.struct("doc", "tk", "line_no", "h", "g"), W.partitionBy("key")
    met = variants.select("key", "role", me.alias("me"))
    lead = F.min(F.when(F.col("role") < 2, F.col("me"))).over(group)
    tail = F.min(F.when(F.col("role") == 2, F.col("me"))).over(group)
    found = met.select("me", F.when(F.col("role") == 1, tail).otherwise(lead).alias("other")).where(F.col("other") < F.col("me"))
    pairs = found.select("me.h", "me.g", F.col("other.h").alias("eh"), F.col("other.g").alias("eg")).distinct()
    text = texts.select("h", "g", "line")
    both = pairs.join(text, ["h", "g"]).join(text.toDF("eh", "eg", "earlier"), ["eh", "eg"])
    near = written(both.where(F.levenshtein("line", "earlier", 1) >= 0).select("h", "g").distinct(), "near")
    discard(docs.sparkSession, shared, asked, texts)
    return near


def removed_lines(docs: DataFrame, max_edits: int = 1, least_chars: int = 1, least_equal: int | None = None) -> DataFrame:
    """``doc, tk, line_no`` of the lines that have an earlier line within the bound.

    ``doc`` is the id (null: the largest long) and ``tk`` the hash of the text. ``max_edits`` is 0 (equal lines only) or 1.
    Equal lines are removed from ``least_equal`` characters on (``least_chars`` if it is not given), lines one character
    apart from ``least_chars`` on. Repeated rows of one id and text are one place in the corpus: none of them makes the
    others repeats.
    """
    if max_edits not in (0, 1):
        raise ValueError("the bound is 0 or 1")
    small_batches(docs.sparkSession)
    equal = least_chars if least_equal is None else least_equal
    lines, place = _lines(docs, min(equal, least_chars)), F.struct("doc", "tk", "line_no")
    halves = [F.any_value(k).alias(f"k{i}") for i, k in enumerate(_half_keys(least_chars))] if max_edits else []
    classes = written(lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), *halves), "classes")
    touched = repeated = classes.where("n > 1").select("h", "g", F.lit(False).alias("all"))
    if max_edits:
        near = _near(docs, classes, least_chars)
        touched = repeated.join(near, ["h", "g"], "left_anti").unionByName(near.select("h", "g", F.lit(True).alias("all")))
    touched = written(touched, "touched")
    size = F.length("line") >= equal
    met = written(lines.join(_small(touched), ["h", "g"]).where(F.col("all") | size).select("h", "g", "doc", "tk", "line_no", "all"), "met")
    first = written(met.where(~F.col("all")).groupBy("h", "g").agg(F.min(place).alias("first")), "first")
    later = met.join(_small(first), ["h", "g"], "left").where(F.col("all") | (place != F.col("first")))
    return later.select("doc", "tk", "line_no").distinct()


def dedup_lines(docs: DataFrame, max_edits: int = 1, least_chars: int = 1, least_equal: int | None = None) -> DataFrame:
    """``docs`` with later lines removed from ``text``, and ``n_removed``; all other columns stay.

    Null and empty texts stay as they are. A text whose every line is removed becomes empty. Rows of one id are told apart
    by their texts, also where the id is null; an empty table gives no rows; a column ``n_removed`` of ``docs`` is replaced.
    """
    gone = removed_lines(docs, max_edits, least_chars, least_equal).groupBy("doc", "tk").agg(F.collect_list("line_no").alias("gone"))
    others = [c for c in docs.columns if c not in ("text", "n_removed")]
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tk"), F.split(text, "\n").alias("lines"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    joined = rows.join(gone, ["doc", "tk"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    out = {c: F.col(f"row.`{c}`") for c in others} | {"text": F.array_join(kept, "\n")}
    return joined.select(*(out[c].alias(c) for c in docs.columns if c != "n_removed"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for every document; a null text has no lines and no digest."""
    docs = table(spark, sf_dir, "documents")
    kept = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    return kept.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
