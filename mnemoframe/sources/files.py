"""Files in, tables in and out."""

from __future__ import annotations

import contextlib
import fnmatch
import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mnemoframe.functions.text import _col, checksum, tokens_word
from mnemoframe.schemas import TABLES

# Suffixes with modality; suffixes of text files that the readers here decode.
MODALITY = {
    ".txt": "text", ".md": "text", ".pdf": "pdf", ".jpg": "image", ".jpeg": "image", ".png": "image", ".bmp": "image", ".tiff": "image", ".wav": "audio", ".mp3": "audio", ".m4a": "audio", ".flac": "audio", ".ogg": "audio",
    ".json": "json", ".docx": "text",
}
PARSER = {".txt": "text", ".md": "text", ".json": "json"}


@contextlib.contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs over many small files have tasks by the files that are worth one, in listing and in reading.

    Spark lists up to 10,000 paths with a task for each, takes opening a file for reading 4 MB, and keeps 250 MB of names of
    files in the driver after they are read.
    """
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    put = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": tasks,
        "spark.sql.files.minPartitionNum": tasks,
        "spark.sql.files.openCostInBytes": "256k",
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {k: spark.conf.get(k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scan_files(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """``path, modified, length, content, checksum`` of every file below ``dirs``; Spark's reader leaves out empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dirs))
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content", checksum("content").alias("checksum"))


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files below a folder as a stream; changes and deletions are found by snapshot differences in a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)


def _local(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder of local files (or of a share that all machines have as such), which is made; None in other stores."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return at.toUri().getPath() if fs.getScheme() == "file" and fs.mkdirs(at) else None


def write_each(rows: DataFrame, folder: str, keys: Sequence[str], text: str) -> None:
    """Writes the text of every row, and a line break, as a file of its own below ``folder/key=value/...``.

    Where rows of one first key are in one task, Spark's writer commits by one rename for each first key. For local files
    Hadoop starts up to five processes a file to set permissions, so there Python writes them, under a hidden name and then
    moved; names are by task and order, so a task that is run again leaves the same files.
    """
    base = _local(rows.sparkSession, folder)
    if base is None:
        rows.select(*keys, text).write.partitionBy(*keys).option("maxRecordsPerFile", 1).text(folder)
        return

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at, n = TaskContext.get(), None, 0
        for b in batches:
            for place, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if place != at:
                    at, n = place, 0
                    os.makedirs(f"{base}/{place}", exist_ok=True)
                part = f"{base}/{place}/.{task.taskAttemptId()}.part"
                with open(part, "wb") as out:
                    out.write(data.as_py() + b"\n")
                os.replace(part, f"{base}/{place}/part-{task.partitionId():05d}-{n:05d}.txt")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    value = lambda k: F.coalesce(F.replace(F.url_encode(F.col(k).cast("string")), F.lit("+"), F.lit("%20")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    place = F.concat_ws("/", *(F.concat(F.lit(f"{k}="), value(k)) for k in keys))
    named = rows.select(place.alias("place"), F.col(text).cast("binary").alias("data")).sortWithinPartitions("place", "data")
    named.mapInArrow(work, "n long").agg(F.sum("n")).first()


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(_col(path), r"([^/\\]*)$", 1), r".(\.[^.]+)$", 1))


def tag_modality(df: DataFrame, path: str = "path", parsers: Mapping[str, str] = PARSER) -> DataFrame:
    """Adds ``suffix``, ``modality`` (text unless known otherwise), ``parser`` and ``supported``.

    ``parsers`` names a parser for each suffix; a caller registers others by giving a larger map.
    """
    lookup = lambda m: F.create_map(*(F.lit(x) for p in m.items() for x in p))[F.col("suffix")]
    tagged = df.withColumn("suffix", suffix(path))
    return tagged.withColumn("modality", F.coalesce(lookup(MODALITY), F.lit("text"))).withColumn("parser", lookup(parsers)).withColumn("supported", F.col("suffix").isin(*MODALITY))


def excluded(path: str | Column, patterns: Sequence[str]) -> Column:
    """Whether a path matches a glob, also below any folder; ``base/**`` matches where its parts stand in a row."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for pattern in patterns:
        for glob in (pattern, f"*/{pattern}"):
            out = out | p.rlike(fnmatch.translate(glob).replace(r"\Z", r"\z").replace("(?>", "(?:").replace("(?s:", "(?s:"))
        base = pattern.split("/**", 1)[0].strip("/") if "/**" in pattern else ""
        if base:
            out = out | p.rlike(f"(^|/){re.escape(base)}(/|$)")
    return out


def file_gate(df: DataFrame, suffixes: Sequence[str] = tuple(MODALITY), excludes: Sequence[str] = (), max_mb: int = 50, path: str = "path", length: str = "length") -> DataFrame:
    return df.where(suffix(path).isin(*suffixes) & ~excluded(path, excludes) & (F.col(length) <= max_mb * 1024 * 1024))


def decode_text(df: DataFrame, content: str = "content", replace: bool = False) -> DataFrame:
    """Adds ``text``: valid UTF-8 without its byte-order mark, else Latin-1; with ``replace`` bad bytes are replaced."""
    s = F.col(content).cast("string")
    good = F.is_valid_utf8(s)
    text = F.make_valid_utf8(s) if replace else F.when(good, s).otherwise(F.decode(F.col(content), "ISO-8859-1"))
    return df.withColumn("text", F.regexp_replace(text, r"\A﻿", ""))


def _flat(value, prefix: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{prefix}[{i}]")
    else:
        yield f"{prefix}: {value}" if prefix else str(value)


def _json_text(f: Callable[[object], str]) -> Callable[[str | Column], Column]:
    """A column function over parsed JSON; texts that are no JSON pass as they are."""

    def apply(c: str | Column) -> Column:
        def work(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(t):
                try:
                    return None if t is None else f(json.loads(t))
                except ValueError:
                    return t

            for s in texts:
                yield s.map(one)

        work.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(work, "string")(_col(c))

    return apply


#: Lines ``a.b[0]: value``, depth first, of JSON of any depth.
flatten_json = _json_text(lambda v: "\n".join(_flat(v)))
#: JSON with an indent of two.
pretty_json = _json_text(lambda v: json.dumps(v, indent=2, ensure_ascii=False))


def flatten_variant(df: DataFrame, json_text: str, key: str, depth: int = 8) -> DataFrame:
    """``key, flat``: the lines of ``flatten_json`` by the VARIANT type, without Python, for JSON of at most ``depth`` levels.

    Members stand in alphabetical order, as VARIANT keeps them; what lies deeper is one line of JSON. Texts that are no JSON
    pass as they are, null stays null. ``key`` tells rows apart.
    """
    spark = df.sparkSession
    parsed = df.select(F.col(key).alias("row"), F.col(json_text).alias("said"), F.try_parse_json(json_text).alias("v"))
    rows = parsed.where("v is not null").select("row", F.lit("").alias("path"), F.array().cast("array<int>").alias("at"), "v")
    lines = None
    for level in range(depth + 1):
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY") if level < depth else F.lit(False)
        value = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.col("v").cast("string"))).otherwise(F.col("v").cast("string"))
        leaf = rows.where(~inner).select("row", "at", F.when(F.col("path") == "", value).otherwise(F.concat("path", F.lit(": "), value)).alias("line"))
        lines = leaf if lines is None else lines.unionByName(leaf)
        if level == depth:
            break
        below = rows.where(inner).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("k"), F.col("value").alias("next")))
        name = F.when(F.col("k").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), "k"))
        rows = below.select("row", name.alias("path"), F.concat("at", F.array("pos")).alias("at"), F.col("next").alias("v"))
    flat = lines.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    joined = parsed.select("row", "said", F.col("v").isNotNull().alias("good")).join(flat.withColumnRenamed("row", "r"), F.col("row").eqNullSafe(F.col("r")), "left")
    return joined.select(F.col("row").alias(key), F.when(F.col("good"), F.coalesce("lines", F.lit(""))).otherwise(F.col("said")).alias("flat"))


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def align_schema(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones get their default or null, extra ones stay last."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols, *(c for c in df.columns if c not in schema.fieldNames()))


def audit_rows(df: DataFrame, kind: str, now: Column) -> DataFrame:
    """``id, event_type, payload, timestamp`` with all columns of a row as JSON."""
    payload = F.to_json(F.struct(*df.columns))
    return df.select(F.sha2(F.concat_ws("|", F.lit(kind), payload), 256).alias("id"), F.lit(kind).alias("event_type"), payload.alias("payload"), now.alias("timestamp"))


def append_audit(df: DataFrame, kind: str, now: Column, path: str) -> None:
    audit_rows(df, kind, now).write.mode("append").parquet(path)


def write_dead_letter(df: DataFrame, path: str, now: Column) -> None:
    """Failed events with the time of giving up, as lines of JSON."""
    df.withColumn("dead_at", now).write.mode("append").json(path)


def save_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Writes ``path, checksum`` as a new version; readers take the newest complete one."""
    out = f"{root}/version={version:012d}"
    df.select("path", "checksum").write.mode("overwrite").parquet(out)
    return out


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``path, checksum`` of the newest complete version below ``root``; no rows if there is none."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    done = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    newest = max((str(f.getPath().getParent()) for f in done), default=None)
    schema = "path string, checksum string"
    return spark.createDataFrame([], schema) if newest is None else spark.read.schema(schema).parquet(newest)


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "vec_id", size: int | None = None) -> DataFrame:
    """Vectors of ``new`` in place of those with the same id; of repeated ids the row with the largest hash stays. Other lengths are an error."""
    if size is not None:
        new = new.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector does not have {size} numbers")).cast(dict(new.dtypes)["embedding"])))
    row = F.struct(*new.columns)
    once = new.groupBy(F.col(key).alias("k")).agg(F.max_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return old.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def replace_sources(df: DataFrame, path: str, defaults: DataFrame | None = None) -> DataFrame:
    """Writes the list of sources anew; an empty list is replaced by ``defaults``."""
    rows = df if defaults is None or df.limit(1).count() else defaults
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def hashing_encoder(size: int = 384) -> Callable[[pd.Series], list[list[float]]]:
    """A stand-in encoder: signed counts of hashed words, scaled to length 1."""

    def encode(texts: pd.Series) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), size))
        for r, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[r, h % size] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return encode


def embed(df: DataFrame, text: str, encoder: Callable[[pd.Series], list[list[float]]] | None = None, name: str = "embedding") -> DataFrame:
    """Adds vectors by a caller's encoder, which gets batches of texts; it is made once for each task."""
    f = encoder or hashing_encoder()

    def work(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(f(s)) if len(s) else pd.Series([], dtype=object)

    work.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(work, "array<double>")(F.col(text)))


def hashed_terms(df: DataFrame, text: str, size: int = 384) -> DataFrame:
    """The same idea without Python: Spark ML's hashing of words, scaled to length 1."""
    from pyspark.ml.feature import HashingTF, Normalizer

    words = df.select(F.struct("*").alias("row"), tokens_word(text).alias("words"))
    hashed = HashingTF(numFeatures=size, inputCol="words", outputCol="counts").transform(words)
    return Normalizer(inputCol="counts", outputCol="vector", p=2.0).transform(hashed).select("row.*", "vector")
