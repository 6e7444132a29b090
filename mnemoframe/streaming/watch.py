"""Changes below watched folders (A2): created, modified, deleted and moved files, by snapshots that survive restarts.

A stream of new files cannot see that a file was rewritten, removed or renamed. So a clock drives the micro-batches; each
lists the folders, reads the files whose size or time differ from the last snapshot, writes the new one, and writes the
difference. A batch that is run again replaces its own snapshot and its own changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.functions.text import checksum
from mnemoframe.operators.ingest import diff_snapshots

_SEEN = "path string, modified timestamp, length long, checksum string"
CHANGES = "path string, change string, checksum string, old_path string, ts timestamp"
#: Changed files that are named to the reader; where more changed, the folders are read whole.
MOST_NAMED = 10_000


def _listed(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """Paths, times and sizes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dirs)).select("path", F.col("modificationTime").alias("modified"), "length")


def take_snapshot(spark: SparkSession, dirs: Sequence[str], known: DataFrame, gate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``path, modified, length, checksum`` of all files that pass ``gate``; unchanged ones keep the checksum they had."""
    now = _listed(spark, dirs)
    now = now if gate is None else gate(now)
    old = known.select("path", F.col("modified").alias("m"), F.col("length").alias("l"), "checksum")
    both = now.join(old, "path", "left")
    same = both.where((F.col("m") == F.col("modified")) & (F.col("l") == F.col("length"))).select("path", "modified", "length", "checksum")
    other = now.join(same.select("path"), "path", "left_anti")
    names = [r.path for r in other.select("path").limit(MOST_NAMED + 1).collect()]
    if not names:
        return same
    named = len(names) <= MOST_NAMED and not any(re.search(r"[][{}*?\\%]", n) for n in names)
    read = spark.read.format("binaryFile") if named else spark.read.format("binaryFile").option("recursiveFileLookup", True)
    content = read.load(names if named else list(dirs)).select("path", F.col("modificationTime").alias("modified"), "length", checksum("content").alias("checksum"))
    return same.unionByName(content if named else content.join(other.select("path"), "path", "left_semi"))


def _versions(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots/version=*/_SUCCESS")
    done = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    paths = sorted(str(f.getPath().getParent()) for f in done)
    older = [p for p in paths if int(p.rpartition("=")[2]) < before]
    return spark.read.schema(_SEEN).parquet(older[-1]) if older else None


def watch_changes(spark: SparkSession, dirs: Sequence[str], root: str, gate: Callable[[DataFrame], DataFrame] | None = None, detect_moves: bool = True, baseline: bool = False, every: str | None = None):
    """Starts a query that writes the changes of each look below ``root/changes``; ``read_changes`` reads them.

    With ``every`` (such as "10 seconds") it looks again and again, else once. What is there at the first look is reported as
    created, or not at all with ``baseline``. Files that do not pass
    ``gate`` (columns path, modified, length) are not there, nor are empty ones, which Spark's reader leaves out.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def look(batch: DataFrame, batch_id: int) -> None:
        known = _versions(spark, root, batch_id)
        first = known is None
        known = spark.createDataFrame([], _SEEN) if first else known
        path = f"{root}/snapshots/version={batch_id:012d}"
        take_snapshot(spark, dirs, known, gate).write.mode("overwrite").parquet(path)
        seen = spark.read.schema(_SEEN).parquet(path)
        found = diff_snapshots(known, seen, first_run=first and baseline, detect_moves=detect_moves)
        stamped = found.join(seen.select("path", F.col("modified").alias("ts")), "path", "left")
        stamped.select("path", "change", "checksum", "old_path", "ts").write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    writer = clock.writeStream.foreachBatch(look).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """``path, change, checksum, old_path, ts, batch``; ``ts`` is the time of the file, null for deleted ones."""
    return spark.read.schema(f"{CHANGES}, batch long").option("basePath", f"{root}/changes").parquet(f"{root}/changes")
