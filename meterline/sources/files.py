"""Reading log files as numbered lines, and listing them.

Files are read in splits, so one very large file is many tasks. The line number is exact: the
rank inside a split plus the lines of the file's earlier splits (one small row per split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import percent_decode
from .frames import scan_frames

# Extensions are matched in any case.
JSONL = "*.[jJ][sS][oO][nN][lL]"
ZSTD = "*.[zZ][sS][tT]*"
PAGE_MAX = 2000


class FileChanged(RuntimeError):
    """The file is not the one the page was opened on."""


def _without_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?", "")


def _plain_path(uri: Column) -> Column:
    return _without_scheme(percent_decode(uri))


def scan_jsonl(
    spark: SparkSession, roots: Sequence[str] | str, glob: str = JSONL
) -> DataFrame:
    """[path, line, value, terminated]. Bad bytes become U+FFFD, blank lines are skipped but
    keep their number, a byte-order mark is dropped. ``terminated`` tells whether the line
    ended; only the last line of a file may not have.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    raw = reader.option("lineSep", "\n").text(list(roots) if not isinstance(roots, str) else roots).select(
        "value", F.col("_metadata.file_path").alias("_uri"),
        F.col("_metadata.file_block_start").alias("_split"), F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_at"),
    )
    splits = raw.groupBy("_uri", "_split").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size")
    )
    file = Window.partitionBy("_uri")
    earlier = file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "_uri", "_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(file).alias("_total"), (F.sum("_bytes").over(file) - F.col("_size")).alias("_extra"),
    )
    rank = F.row_number().over(Window.partitionBy("_uri", "_split").orderBy("_at"))
    lines = raw.drop("_size").withColumn("_rank", rank).join(starts, ["_uri", "_split"], "left")
    line = F.col("_before") + F.col("_rank")
    # One byte too many means the last line had no newline; a dropped mark hides three bytes.
    unfinished = F.col("_extra").isin(1, -2)
    value = F.ltrim(F.make_valid_utf8("value"), F.lit("\ufeff"))
    return lines.select(
        _plain_path(F.col("_uri")).alias("path"), line.cast("bigint").alias("line"), value.alias("value"),
        ((line < F.col("_total")) | ~unfinished).alias("terminated"),
    ).where(F.btrim("value", F.lit(" \t\r\n")) != "")


def scan_jsonl_zst(spark: SparkSession, roots: Sequence[str] | str, glob: str = ZSTD) -> DataFrame:
    """The same over zstd files of many frames, read in ranges of frames; what can be decoded before a cut or damaged
    frame is kept. ``terminated`` is as exact as for plain files."""
    rows = scan_frames(list_files(spark, roots, glob))
    value = F.ltrim(F.make_valid_utf8(F.col("bytes").cast("string")), F.lit("\ufeff"))
    return rows.select("path", F.col("line").cast("bigint").alias("line"), value.alias("value"), "terminated").where(F.btrim("value", F.lit(" \t\r\n")) != "")


def list_files(spark: SparkSession, roots: Sequence[str] | str, glob: str = "*") -> DataFrame:
    """[path, size, mtime_ms] without reading any content."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(list(roots) if not isinstance(roots, str) else roots)
    )
    return listing.select(
        _without_scheme(F.col("path")).alias("path"), F.col("length").alias("size"),  # not encoded here
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )


def raw_lines_page(
    lines: DataFrame, ledger: DataFrame, path: str, start: int, limit: int, expected_size: int
) -> DataFrame:
    """Lines ``start`` (from 0) onward of one file. Refuses when the ledger's size is not the one the
    caller saw, and a limit beyond PAGE_MAX."""
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"a page has 1 to {PAGE_MAX} lines, not {limit}")
    known = ledger.where(F.col("path") == path).select("size").first()
    if known is None:
        raise FileChanged(f"not indexed: {path}")
    if expected_size >= 0 and known["size"] != expected_size:
        raise FileChanged(f"changed since it was opened: {path}")
    chosen = (F.col("path") == path) & (F.col("line") > start) & (F.col("line") <= start + limit)
    return lines.where(chosen).select("line", F.rtrim("value", F.lit("\r")).alias("value")).orderBy("line")
