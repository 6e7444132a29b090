"""Written intermediate tables in the folder that the cluster shares.

Long jobs cut their lineage by writing a table and reading it again, so a lost executor costs only the tasks it ran.
The folder is the one the session names in ``spark.checkpoint.dir``. Only in local mode may that be unset (tests,
notebooks): a local folder is then made for the session.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. A cluster must name one; in local mode a new local folder is set if none is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="mnemoframe-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders that this process has named.
_NAMED: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _NAMED.append(f"{shared_dir(spark)}/mnemoframe-{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it as read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a shuffle that one task is meant to hold, and those that are worth a task while cores are free.
ROWS, FEW_ROWS = 500_000, 25_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that ``rows`` rows of a shuffle are dealt to.

    Adaptive execution sizes tasks by compressed bytes, of which ids need few: 64 MB may be millions of rows, and hash
    tables and lists of them take many times that.
    """
    return max(1, -(-rows // ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables made by ``written`` that no later plan reads."""
    for df in frames:
        _delete(spark, df.written_at)


def named() -> list[str]:
    """The folders that this process has named so far, in order."""
    return list(_NAMED)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Deletes some of the folders that ``named`` tells; DataFrames that read them can no longer be used."""
    for folder in folders:
        _delete(spark, folder)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody refers to any more.

    Spark deletes them when the driver's garbage is collected, which in a loop of many small jobs is seldom by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this process in the shared folder; DataFrames that read them can no longer be used."""
    while _NAMED:
        _delete(spark, _NAMED.pop())
