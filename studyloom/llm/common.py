"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_dir

#: A key with at least this share of all rows is heavy; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back; cuts the lineage for good."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what has just been written
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Bound the rows Spark sends a Python worker at a time, for workers that hold whole texts beside a JVM; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[list[dict]]:
    """The rows of Arrow batches as lists of dicts, a bounded number at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step).to_pylist()


def batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))
