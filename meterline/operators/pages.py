"""Pages, exports' row order, and top-k boards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path, store

# Largest page of events and of activities.
EVENT_PAGE_MAX, ACTIVITY_PAGE_MAX = 500, 1000
ROWS_PER_RANGE = 100_000


def _check(limit: int, most: int) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"a page has 1 to {most} rows, not {limit}")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("ts").desc(), F.col("agent").asc(), F.col("id").asc())


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A slice, newest first. Runs as a top-k: each task keeps offset + limit rows."""
    return newest_first(df).offset(offset).limit(limit)


def page_after(df: DataFrame, cursor: tuple[int, str, str] | None, limit: int) -> DataFrame:
    """The slice after a row's (ts, agent, id). Deep pages cost no more than the first."""
    if cursor is not None:
        ts, agent, ident = cursor
        at = F.col("ts") == ts
        df = df.where(
            (F.col("ts") < ts) | (at & (F.col("agent") > agent))
            | (at & (F.col("agent") == agent) & (F.col("id") > ident))
        ).where(F.col("ts") <= ts)
    return newest_first(df).limit(limit)


@dataclass(frozen=True)
class Ordered:
    """A table written in page order, and how many rows lie before each of its files."""

    folder: str
    index: DataFrame
    """file, n, before: one row per file."""
    total: int


def in_order(df: DataFrame, folder: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> Ordered:
    """Writes ``df`` newest first, by a range-partitioned sort, in files of at most ``rows_per_range`` rows. Rows of one time
    are parted by agent and id, so a crowded moment is many files, too."""
    spark, folder = df.sparkSession, folder or scratch_path(df.sparkSession, "pages")
    newest_first(df).write.option("maxRecordsPerFile", rows_per_range).parquet(folder)
    rows = spark.read.schema(df.schema).parquet(folder)
    files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("ts")).alias("age"), "agent", "id")).alias("first")
    )
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    index = store(files.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "n", "before"), "page-index")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Ordered(folder, index, total)


def page_at(spark: SparkSession, ordered: Ordered, offset: int, limit: int) -> DataFrame:
    """A slice of any depth: reads the files that the offset falls into, and no others."""
    hit = ordered.index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()  # limit / ROWS_PER_RANGE + 2 files
    if not hit:
        return spark.createDataFrame([], spark.read.parquet(ordered.folder).schema)
    rows = spark.read.parquet(*(f"{ordered.folder}/{r['file']}" for r in hit))
    return page(rows, offset - min(r["before"] for r in hit), limit)


def event_page(events: DataFrame, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(one-row total, slice). Raises on a page larger than EVENT_PAGE_MAX, rather than cutting it."""
    _check(limit, EVENT_PAGE_MAX)
    return events.agg(F.count(F.lit(1)).alias("total")), page(events, offset, limit)


def activity_page(activities: DataFrame, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(one-row total, slice). Raises on a page larger than ACTIVITY_PAGE_MAX, rather than cutting it."""
    _check(limit, ACTIVITY_PAGE_MAX)
    return activities.agg(F.count(F.lit(1)).alias("total")), page(activities, offset, limit)


def export_rows(events: DataFrame) -> DataFrame:
    """Ascending (ts, id): a range-partitioned sort, so files come out in order."""
    return events.orderBy("ts", "id")
