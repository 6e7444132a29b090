"""A BM25 index that is kept and changed (D6, D9): changes append, nothing is built anew.

Below a root folder every change is a batch, which replaces itself when it is run again:

* ``postings`` (term, chunk_id, tf, len) and ``terms`` (term, delta of its document frequency), in ``PARTS`` folders by a hash
  of the term, so a search reads the folders of its terms alone;
* ``chunks`` (chunk_id, len, live), and ``dead`` (chunk_id, since): the chunks that a change replaced or removed, and the
  batch their postings are in;
* ``totals``, one row: chunks, tokens, and the mean weight of all terms after the change. It is written last, so readers see
  whole changes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoframe.functions.text import tokens_word, tokens_ws
from mnemoframe.operators.retrieve import bm25_topk, lookup
from mnemoframe.scratch import exists, written

PARTS = 64
#: Chunks whose terms a task counts at once.
CUT = 1000
_TABLES = {
    "postings": "term string, chunk_id {id}, tf long, len int, part int",
    "terms": "term string, delta long, part int",
    "chunks": "chunk_id {id}, len int, live boolean",
    "dead": "chunk_id {id}, since long",
    "totals": "n long, words long, mean double, id string, split string",
}


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class KeptIndex:
    """The index below ``root``. ``words`` takes words of two or more characters instead of white-space tokens."""

    def __init__(self, spark: SparkSession, root: str, words: bool = False, id_type: str = "string"):
        self.spark, self.root, self.words, self.id_type = spark, root.rstrip("/"), words, id_type

    def _read(self, table: str, upto: int | None = None) -> DataFrame:
        schema = _TABLES[table].format(id=self.id_type) + ", batch long"
        path = f"{self.root}/{table}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(path)
        done = self._last() if upto is None else upto
        return rows.where(F.col("batch") <= done)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        path = f"{self.root}/{table}/batch={batch}"
        if "part" in df.columns:
            # a folder's rows come together, large ones in several files, so that a change does not leave many small ones
            df.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def _last(self) -> int:
        """The last finished change; -1 before the first."""
        path = f"{self.root}/totals"
        if not exists(self.spark, path):
            return -1
        rows = self.spark.read.schema("n long, batch long").option("basePath", path).parquet(path)
        found = rows.agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def change(self, added: DataFrame, removed: DataFrame | None = None, batch: int | None = None, text: str = "content") -> int:
        """Adds ``added`` (chunk_id, and its text), in place of chunks with the same ids, and takes out ``removed`` (chunk_id).

        ``batch`` numbers the change (the next one by default); with the number of an earlier try it replaces that. Of
        repeated ids the row with the largest hash counts; rows without an id are left out. Returns the number.
        """
        batch = self._last() + 1 if batch is None else batch
        before = batch - 1
        rows = added.where(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").cast(self.id_type).alias("chunk_id"), F.col(text).alias("text"))
        # texts stay where they are read; only those of repeated ids are brought together
        again = written(rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"), "again")
        once = rows
        if not again.isEmpty():
            often = lookup(again)
            best = rows.join(often, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            once = rows.join(often, "chunk_id", "left_anti").unionByName(best)
        tokens = tokens_word(F.col("text")) if self.words else tokens_ws(F.col("text"))
        cut = once.select("chunk_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("ts"))
        gone = self.spark.createDataFrame([], f"chunk_id {self.id_type}") if removed is None else removed.select(F.col("chunk_id").cast(self.id_type).alias("chunk_id")).where("chunk_id is not null")

        counted = cut.mapInArrow(_counts, f"term string, chunk_id {self.id_type}, tf long, len int")
        self._write(counted.select("term", "chunk_id", "tf", "len", part_of(F.col("term")).alias("part")), "postings", batch)
        new_chunks = cut.select("chunk_id", F.size("ts").alias("len"), F.lit(True).alias("live"))
        out = gone.distinct().join(new_chunks, "chunk_id", "left_anti").select("chunk_id", F.lit(0).alias("len"), F.lit(False).alias("live"))
        self._write(new_chunks.unionByName(out), "chunks", batch)
        here = self.spark.read.schema(_TABLES["chunks"].format(id=self.id_type)).parquet(f"{self.root}/chunks/batch={batch}")
        live = self._live(before).join(here.select("chunk_id"), "chunk_id", "left_semi")
        self._write(live.select("chunk_id", F.col("batch").alias("since")), "dead", batch)
        dead = self.spark.read.schema(_TABLES["dead"].format(id=self.id_type)).parquet(f"{self.root}/dead/batch={batch}")

        mine = self.spark.read.schema(_TABLES["postings"].format(id=self.id_type)).parquet(f"{self.root}/postings/batch={batch}")
        lost = self._read("postings", before).join(dead.withColumnRenamed("since", "batch"), ["chunk_id", "batch"], "left_semi")
        delta = mine.select("term", F.lit(1).alias("d")).unionAll(lost.select("term", F.lit(-1))).groupBy("term").agg(F.sum("d").alias("delta")).where("delta <> 0")
        self._write(delta.select("term", "delta", part_of(F.col("term")).alias("part")), "terms", batch)

        old = self._read("totals", before).where(F.col("batch") == before).first()
        size = here.where("live").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        less = self._live(before).join(dead.select("chunk_id"), "chunk_id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        n, words = ((old["n"], old["words"]) if old else (0, 0))
        n, words = n + size[0] - less[0], words + size[1] - less[1]
        mean = self._df(batch).agg(F.avg(_raw(F.lit(n)))).first()[0]
        self._write(self.spark.createDataFrame([(n, words, mean, self.id_type, "words" if self.words else "space")], _TABLES["totals"]).coalesce(1), "totals", batch)
        return batch

    def _live(self, upto: int) -> DataFrame:
        """``chunk_id, len, batch`` of the chunks that are there after a change."""
        last = self._read("chunks", upto).groupBy("chunk_id").agg(F.max_by(F.struct("len", "live"), "batch").alias("c"), F.max("batch").alias("batch"))
        return last.where("c.live").select("chunk_id", "c.len", "batch")

    def _df(self, upto: int, parts: list[int] | None = None) -> DataFrame:
        rows = self._read("terms", upto)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        return rows.groupBy("term").agg(F.sum("delta").alias("df")).where("df > 0")

    def tables(self, parts: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Postings, terms and the one row of totals, as ``retrieve.bm25_index`` makes them; ``parts`` reads some folders only."""
        last = self._last()
        total = self._read("totals", last).where(F.col("batch") == last)
        postings = self._read("postings", last)
        postings = postings if parts is None else postings.where(F.col("part").isin(parts))
        dead = self._read("dead", last).select("chunk_id", F.col("since").alias("batch"))
        postings = postings.join(dead, ["chunk_id", "batch"], "left_anti").select("term", "chunk_id", "tf", "len")
        stats = total.select("n", F.when(F.col("n") > 0, F.col("words") / F.col("n")).alias("avg_len"))
        raw = self._df(last, parts).join(F.broadcast(total.select("n", "mean"))).select("term", "df", _raw(F.col("n")).alias("raw"), "mean")
        terms = raw.select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        return postings, terms, stats

    def search(self, queries: DataFrame, k: int = 5, **more) -> DataFrame:
        """``retrieve.bm25_topk`` over the folders that the queries' terms are in; the driver gets the numbers of those."""
        tokens = tokens_word(F.col("text")) if self.words else tokens_ws(F.col("text"))
        parts = [r[0] for r in queries.select(F.explode(tokens).alias("term")).select(part_of(F.col("term"))).distinct().collect()]
        return bm25_topk(queries, self.tables(parts), k, words=self.words, **more)

    def compact(self, to: str) -> KeptIndex:
        """The same index below a new root, with one folder a table, numbered as the last change; this one stays."""
        last = self._last()
        other = KeptIndex(self.spark, to, self.words, self.id_type)
        if last < 0:
            return other
        postings, _, _ = self.tables()
        other._write(postings.withColumn("part", part_of(F.col("term"))), "postings", last)
        other._write(self._df(last).select("term", F.col("df").alias("delta"), part_of(F.col("term")).alias("part")), "terms", last)
        other._write(self._live(last).select("chunk_id", "len", F.lit(True).alias("live")), "chunks", last)
        other._write(self._read("totals", last).where(F.col("batch") == last).drop("batch"), "totals", last)
        return other


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, chunk_id, tf, len`` of whole chunks (chunk_id, and its terms with repeats)."""
    for batch in batches:
        for at in range(0, batch.num_rows, CUT):
            ids, lists = (batch.column(i).slice(at, CUT) for i in (0, 1))
            size = pc.list_value_length(lists).to_numpy()
            terms = pc.dictionary_encode(lists.flatten())
            n = max(1, len(terms.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + terms.indices.to_numpy(), return_counts=True)
            of = pa.array(key // n)
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(key % n)), ids.take(of), pa.array(tf), pa.array(size.astype(np.int32)).take(of)], names=["term", "chunk_id", "tf", "len"])


def _raw(n: Column) -> Column:
    return F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
