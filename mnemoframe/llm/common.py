"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch sent to Python. Texts can be long, so batches are small.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 4_000_000
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_PER_BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_PER_BATCH}


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small; smaller settings of the session stand.

    Spark reads these settings when a plan runs, which is after an operator has returned, so they stay in the session.
    """
    for key, most in _BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(str(now).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def by_size(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[list[tuple]]:
    """Row tuples in runs whose texts have about ``limit`` characters together (one longer text makes its own run)."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            held += len(row[at] or "")
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
