"""Continuous versions of ingestion, counter differences, election and the time series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators.counters import COUNTERS
from ..operators.elect import first_by
from .counters import NUMBERS, TOKENS, USAGE, Differences
from .logs import BATCH, compact, read_log, run_available, write_batch
from .refresh import current_rows, refresh

LAST = ("last_input", "last_cached", "last_cache_write", "last_output", "last_reasoning")


def stream_ingest(spark: SparkSession, roots: str, glob: str, read: Callable[[list[str]], DataFrame], sink: str, agent: str = "log") -> dict[str, int]:
    """Ingests until a listing shows nothing new: new and grown files are read again whole through ``read``
    (paths to rows with a path), and their rows give way to the new ones. Call it again for what comes later.
    """
    total = {"read": 0, "failed": 0, "vanished": 0}
    while any((done := refresh(spark, roots, glob, read, sink, agent, winners=False)).values()):
        total = {k: total[k] + done[k] for k in total}
        if not done["read"] + done["vanished"]:
            break  # only failures, which wait for their time
    return total


def ingested(spark: SparkSession, sink: str) -> DataFrame:
    return current_rows(spark, sink)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_delta(samples: DataFrame, sink: str, checkpoint: str, spelling: str | None = None):
    """Running totals to per-request usage across batches, by the batch operator's own rules, appended to ``sink``/usage.

    ``transformWithState`` keeps the last sample of each path in RocksDB under the checkpoint, so a batch costs what
    its rows cost however many paths there are, and a restart goes on where the checkpoint ends. Samples of a
    path arrive in order of their batches; within a batch they may come in any order of line.
    """
    columns = ["path", "line", *COUNTERS, *([spelling] if spelling else []), *LAST]
    missing = [c for c in columns if c not in samples.columns]
    if missing:
        raise ValueError(f"samples lack {missing}")
    spark = samples.sparkSession
    numbers = [*COUNTERS, *([spelling] if spelling else []), *LAST]
    others = [f for f in samples.schema.fields if f.name not in numbers]
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit("")) for c in numbers)).alias(NUMBERS)
    packed = samples.select(*(F.col(f"`{f.name}`") for f in others), text)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{NUMBERS}` string, `{USAGE}` string"])
    number = lambda name, i, kind: F.split(F.col(f"`{name}`"), ",")[i].try_cast("long").cast(kind)
    read = [number(NUMBERS, numbers.index(f.name), f.dataType).alias(f.name) if f.name in numbers else F.col(f"`{f.name}`") for f in samples.schema.fields]
    read += [number(USAGE, i, "long").alias(t) for i, t in enumerate(TOKENS)]
    state = ", ".join(f"{c} long" for c in (*COUNTERS, *([spelling] if spelling else [])))
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # the only store that this operator works with
    try:
        usage = packed.groupBy("path").transformWithState(Differences([f.name for f in others], state, bool(spelling)), fields, "Append", "None").select(*read)
        query = usage.writeStream.format("parquet").option("path", f"{sink}/usage").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return query


def _winning(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_by(rows, keys, [F.col("ts").desc(), F.col("mtime").desc(), F.col("path").asc()])


def stream_elect(raw: DataFrame, sink: str, checkpoint: str, keys: Sequence[str] = ("agent", "id")):
    """Keeps the winner per identity as copies arrive, however late: no watermark.

    Election is a maximum, so a batch logs its own winners and the reader takes the best of all batches.
    ``raw`` carries its file's mtime.
    """
    return run_available(raw, lambda batch, n: write_batch(_winning(batch, keys), f"{sink}/winners", n), checkpoint)


def winners(spark: SparkSession, sink: str, schema, keys: Sequence[str] = ("agent", "id")) -> DataFrame:
    return _winning(read_log(spark, f"{sink}/winners", schema).drop(BATCH), keys)


def compact_winners(spark: SparkSession, sink: str, schema, keys: Sequence[str] = ("agent", "id")) -> None:
    compact(spark, f"{sink}/winners", schema, lambda rows: _winning(rows, keys))


_SERIES = ", ".join(f"{c} long" for c in ("bucket", *TOKENS, "events"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(*[S.saturating_sum(c).alias(c) for c in TOKENS], F.sum("events").alias("events"))


def stream_series(events: DataFrame, width_ms: int, sink: str, checkpoint: str, offset_ms: int = 0):
    """Usage per tumbling bucket. A batch logs its own sums and the reader adds them up, so a row counts
    however late it comes."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("bucket", S.bucket_floor("ts", width_ms, offset_ms)).withColumn("events", F.lit(1).cast("bigint"))
        write_batch(_summed(rows), f"{sink}/series", batch_id)

    return run_available(events, handle, checkpoint)


def series(spark: SparkSession, sink: str) -> DataFrame:
    return _summed(read_log(spark, f"{sink}/series", _SERIES).drop(BATCH))


def compact_series(spark: SparkSession, sink: str) -> None:
    compact(spark, f"{sink}/series", _SERIES, _summed)
