"""Language identification by known words, backing off to character n-grams.

Every learned language has the log frequency of its words and of the n-grams of 1 to 4 characters inside them, counted
over all learning rows. A known word adds its log frequencies; an unseen word adds the mean over its characters of the
longest known n-gram that starts there, trying 4 characters first, then 3, 2 and 1. The language with the largest sum is
predicted, and the score is its share among all languages.

The counts are tables of any size. The most frequent words, up to ``HEAD_ENTRIES``, are broadcast, and the tasks that read
the texts add up those alone; the other words of the documents are made distinct, joined with the tables and joined
back. So the bound decides how much is shuffled, not what is counted or scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm.common import record, small_batches, table
from mnemoframe.scratch import written

UNKNOWN = "und"
LONGEST_GRAM = 4
#: Words whose log frequencies are broadcast, the most frequent ones.
HEAD_ENTRIES = 400_000
#: Rows of a table of n-grams that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
_FLUSH = 400_000
#: Words are cut for their n-grams so that no piece is long; neighbours overlap.
_PIECE = 256
_LAST = (1 << 63) - 1

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def words(text: str) -> list[bytes]:
    """Lower-case runs of ASCII letters and other characters beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for null ids, which are not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over the rows that may be learned from; words are counted in the tasks before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def rows(seen):
        flat = [(lang, w.decode("utf-8", "replace"), n) for lang, c in seen.items() for w, n in c.items()]
        for at in range(0, len(flat), 50_000):
            yield record(schema, list(zip(*flat[at : at + 50_000], strict=True)))

    def work(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, seen.values())) > _FLUSH:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return known.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(work, "lang string, word string, n long")


@dataclass
class Model:
    """Counts of words (``gram, n0, n1, ...``) and of n-grams by their size, a count for each language."""

    langs: list[str]
    words: DataFrame | None = None
    grams: dict[int, DataFrame] = field(default_factory=dict)
    #: Sums of the counts by size (0: words).
    totals: dict[int, list[int]] = field(default_factory=dict)
    head: tuple[list[str], np.ndarray | None] = ([], None)

    def logs(self, size: int, prefix: str = "v") -> DataFrame:
        """``gram`` and its log frequency in every language."""
        counts = self.grams[size] if size else self.words
        values = [F.log((F.coalesce(f"n{i}", F.lit(0)) + 0.5) / (t + 0.5)).alias(f"{prefix}{i}") for i, t in enumerate(self.totals[size])]
        return counts.select("gram", *values)


def _columns(langs: list[str], name: str = "n") -> list[str]:
    return [f"{name}{i}" for i in range(len(langs))]


def _places(df: DataFrame, word: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``g1`` to ``g4``, the n-grams that begin at each character of ``^word$`` (shorter at its end)."""
    padded = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    step = _PIECE - LONGEST_GRAM + 1
    cut = df.select(*keep, padded.alias("padded"), F.length(padded).alias("all")).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("all"), F.lit(step))))
    piece = cut.select(*keep, F.substr("padded", F.col("from"), F.lit(_PIECE)).alias("piece"), F.least(F.lit(step), F.col("all") - F.col("from") + 1).alias("places"))
    at = piece.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("places"))))
    return at.select(*keep, *(F.substr("piece", F.col("at"), F.lit(n)).alias(f"g{n}") for n in range(1, LONGEST_GRAM + 1)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def learn(docs: DataFrame, entries: int = HEAD_ENTRIES) -> Model:
    """The model of all learning rows of ``docs`` (not held out, ``lang``, ``text`` and ``doc_id`` not null).

    Every word of every learning row is counted, however long or rare. A language without a word is not learned.
    """
    small_batches(docs.sparkSession)
    langs = sorted(str(r[0]) for r in docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string")).distinct().collect())
    if not langs:
        return Model([])
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{i}") for i, x in enumerate(langs)]
    counted = written(count_words(docs).groupBy(F.col("word").alias("gram")).agg(*by_lang), "words")
    totals = {0: [n or 0 for n in counted.agg(*(F.sum(c) for c in _columns(langs))).first()]}
    learned = [i for i, n in enumerate(totals[0]) if n]
    if not learned:
        return Model([])
    if len(learned) < len(langs):
        counted = counted.select("gram", *(F.col(f"n{i}").alias(f"n{k}") for k, i in enumerate(learned)))
        langs, totals[0] = [langs[i] for i in learned], [totals[0][i] for i in learned]
    names = _columns(langs)
    sized = F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.col(f"g{n}").alias("gram")) for n in range(1, LONGEST_GRAM + 1)))).alias("g")
    grams = _places(counted, "gram", names).select(*names, sized).select("g.*", *names).where(F.length("gram") == F.col("size"))
    every = written(grams.groupBy("size", "gram").agg(*(F.sum(c).alias(c) for c in names)), "grams", ("size",))
    for r in every.groupBy("size").agg(*(F.sum(c).alias(c) for c in names)).collect():
        totals[r["size"]] = [r[c] or 0 for c in names]
    tables = {n: every.where(F.col("size") == n).drop("size") for n in totals if n}
    model = Model(langs, counted, tables, totals)
    # the least count at which no more than the bound are as frequent, by eighths of powers of two
    n = reduce(add, (F.coalesce(c, F.lit(0)) for c in names))
    left, least = entries, 1 << 62
    for bucket, rows in sorted(map(tuple, counted.groupBy(F.floor(F.log2(n) * 8)).count().collect()), reverse=True):
        if rows > left:
            break
        left, least = left - rows, bucket
    frequent = counted.where(F.floor(F.log2(n) * 8) >= least).select("gram")
    head = model.logs(0).join(frequent, "gram", "left_semi").toArrow() if least < 1 << 62 else None
    if head is not None:
        model.head = head.column("gram").to_pylist(), np.stack([head.column(f"v{i}").to_numpy() for i in range(len(langs))], axis=1)
    return model


def _first_pass(docs: DataFrame, model: Model) -> DataFrame:
    """``row, doc_id, tk, letters, part, rest``: the sums of the broadcast words, and all other words with their counts."""
    langs = len(model.langs)
    frequent, values = model.head
    known = docs.sparkSession.sparkContext.broadcast(({w.encode(): k for k, w in enumerate(frequent)}, values))
    rest = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("letters", pa.bool_()), ("part", pa.list_(pa.float64())), ("rest", rest)])

    def work(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        places, logs = known.value
        for b in batches:
            letters, parts, ends, others, counts = [], [], [0], [], []
            for t in b.column(2):
                text = t.as_py()
                letters.append(bool(text and _LETTER.search(text)))
                found = words(text) if letters[-1] else []
                at = list(map(places.get, found))
                if None in at:
                    unknown = Counter(w for w, k in zip(found, at, strict=True) if k is None)
                    others += [w.decode() for w in unknown]
                    counts += unknown.values()
                    at = [k for k in at if k is not None]
                parts.append(logs[at].sum(axis=0) if at else np.zeros(langs))
                ends.append(len(others))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(others, pa.string()), pa.array(counts, pa.int64())], fields=list(rest.value_type)))
            yield record(schema, [range(row, row + b.num_rows), b.column(0), b.column(1), letters, parts, listed])
            row += b.num_rows

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    return rows.mapInArrow(work, "row long, doc_id long, tk long, letters boolean, part array<double>, rest array<struct<word:string,k:long>>")


def word_logs(asked: DataFrame, model: Model) -> DataFrame:
    """``word, v0, v1, ...`` of different words: their own log frequencies, or the mean of their longest known n-grams.

    Zero for a word of which no n-gram is known.
    """
    names = _columns(model.langs, "v")
    own = written(asked.join(model.logs(0).withColumnRenamed("gram", "word"), "word", "left"), "own")
    unseen = own.where(F.col("v0").isNull()).select("word")
    places = _places(unseen, "word", ["word"])
    for n in range(1, LONGEST_GRAM + 1):
        if n in model.grams:
            places = places.join(_small(model.logs(n, f"s{n}_")).withColumnRenamed("gram", f"g{n}"), f"g{n}", "left")
    longest = [F.coalesce(*(F.col(f"s{n}_{i}") for n in sorted(model.grams, reverse=True))).alias(v) for i, v in enumerate(names)]
    means = places.select("word", *longest).groupBy("word").agg(*(F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in names))
    return own.where(F.col("v0").isNotNull()).unionByName(means)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, tk, lang_pred, score`` of every row."""
    small_batches(docs.sparkSession)
    if not model.langs:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tk"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = _columns(model.langs, "v")
    rows = written(_first_pass(docs, model), "first")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k")
    logs = written(word_logs(rest.select("word").distinct(), model), "logs")
    sums = rest.join(logs, "word").groupBy("row").agg(*(F.sum(F.col("k") * F.col(v)).alias(v) for v in names))
    joined = rows.drop("rest").join(sums, "row", "left")
    total = joined.select("doc_id", "tk", "letters", F.array(*(F.get("part", F.lit(i)) + F.coalesce(v, F.lit(0.0)) for i, v in enumerate(names))).alias("total"))
    best = total.withColumn("best", F.array_max("total"))
    share = reduce(add, (F.exp(F.get("total", F.lit(i)) - F.col("best")) for i in range(len(names))))
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", F.col("best")).cast("int"))
    return best.select("doc_id", "tk", F.when(F.col("letters"), lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), 1 / share).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``.

    ``und`` with score 0 for null texts, texts without a letter, and models that learned nothing. Equal sums go to the
    language first in order. Other columns are not read; repeated rows and null ids are answered as they stand.
    """
    return _scored(docs, model).select("doc_id", "lang_pred", "score")


def reject_unknown(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without rows whose language is ``und`` or whose score is under ``least``; all columns stay.

    Rows are told apart by id and text, so rows without an id, or with one id, do not go for each other.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    gone = written(_scored(docs, model).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(doc, "tk").distinct(), "rejected")
    keyed = docs.select(doc, F.xxhash64(F.col("text").cast("string")).alias("tk"), F.struct("*").alias("row"))
    return keyed.join(gone, ["doc", "tk"], "left_anti").select("row.*")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
