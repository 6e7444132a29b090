"""Tables that are replaced at once (C4): readers see a whole version, and a writer that fails changes nothing.

A version is a folder that is never written again, and a manifest, a small file that names the folder. The manifest is
written aside and renamed to its number, which fails if that number is there: so of two writers of one version the first
wins, and the second starts again from what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from mnemoframe.operators.ingest import upsert


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


def _fs(spark: SparkSession, root: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, ascending."""
    at, fs = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.globStatus(at(f"{root}/manifest/*")) or []]
    return sorted(int(n) for n in names if n.isdigit())


def _folder(spark: SparkSession, root: str, number: int) -> str:
    at, fs = _fs(spark, root)
    stream = fs.open(at(f"{root}/manifest/{number:012d}"))
    try:
        return f"{root}/data/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The newest version, or the one asked for; None if there is none. It stays as it is while others are made."""
    known = versions(spark, root)
    number = (known[-1] if known else None) if version is None else version
    return spark.read.parquet(_folder(spark, root, number)) if number in known else None


def commit(df: DataFrame, root: str, expected: int | None = None) -> int:
    """Writes ``df`` as the version after ``expected`` (-1 before the first; the newest by default), and returns its number.

    If that version is made by someone else meanwhile, Conflict is raised and nothing of this one is ever seen.
    """
    spark = df.sparkSession
    at, fs = _fs(spark, root)
    number = (max(versions(spark, root), default=-1) if expected is None else expected) + 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/data/{name}")
    aside = at(f"{root}/manifest/.{name}")
    out = fs.create(aside, False)
    out.write(bytearray(name.encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(aside, fs.makeQualified(at(f"{root}/manifest/{number:012d}")), none)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        raise Conflict(f"version {number} exists") from e
    return number


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Makes a version of what ``change`` does to the newest, again from the start if another writer was faster."""
    for _ in range(tries):
        newest = max(versions(spark, root), default=-1)
        try:
            return commit(change(current(spark, root, newest)), root, newest)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries met another writer")


def upsert_table(batch: DataFrame, root: str, key: str = "source_uri", version: str = "checksum") -> int:
    """``ingest.upsert`` of a batch into the table below ``root``, as a new version."""
    return update(batch.sparkSession, root, lambda old: upsert(batch.limit(0) if old is None else old, batch, key, version)[0])


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest ``keep`` versions, manifests first."""
    at, fs = _fs(spark, root)
    for number in versions(spark, root)[:-keep or None]:
        folder = _folder(spark, root, number)
        fs.delete(at(f"{root}/manifest/{number:012d}"), False)
        fs.delete(at(folder), True)
