"""Append-only tables that micro-batches write and readers resolve.

Every batch writes its own folder ``batch=<n>`` in overwrite mode, so running a batch again after a failure
replaces what it wrote before. What batches add up to (winners, sums) is resolved by the reader and folded
into one folder by :func:`compact` now and then, so no batch reads what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches; a listing of folder names."""
    system, path = _system(spark, folder)
    if not system.exists(path):
        return []
    names = [s.getPath() for s in system.listStatus(path)]
    done = [p for p in names if p.getName().startswith(f"{BATCH}=") and system.exists(p.suffix("/_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def read_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows of all batches with the batch's number, by which folders are pruned."""
    numbers = batches(spark, folder)
    if not numbers:
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0))
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    folders = [f"{folder}/{BATCH}={n}" for n in numbers]
    return spark.read.schema(f"{fields}, {BATCH} int").option("basePath", folder).parquet(*folders)


def drop_before(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Deletes the folders of batches before ``batch_id``."""
    for n in batches(spark, folder):
        if n < batch_id:
            system, path = _system(spark, f"{folder}/{BATCH}={n}")
            system.delete(path, True)


def compact(spark: SparkSession, folder: str, schema, resolve: Callable[[DataFrame], DataFrame]) -> None:
    """Folds all batches but the newest into the one before it, while no batch runs. The fold is written
    beside the log first, so that a job that dies in between leaves the log as it was."""
    numbers = batches(spark, folder)
    if len(numbers) < 3:
        return
    target = numbers[-2]
    rows = read_log(spark, folder, schema).where(F.col(BATCH) <= target).drop(BATCH)
    beside = f"{folder}-fold"
    resolve(rows).write.mode("overwrite").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").parquet(f"{folder}/{BATCH}={target}")
    drop_before(spark, folder, target)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes everything there is now, batch by batch, and stops. A batch is kept while it is handled,
    as it is read more than once."""

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
