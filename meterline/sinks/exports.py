"""Exports and maintained tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from .versions import Tables, Version


def _rfc3339(ts: str) -> Column:
    stamp = F.timestamp_millis(ts)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.when(F.col(ts) % 1000 == 0, whole).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))


def export_rows(priced: DataFrame, currency: str = "USD", usd_cny: float | None = None) -> DataFrame:
    """The 14 export columns as text, guarded against formulas, cost in the display currency."""
    text = lambda c: F.col(c).cast("string")
    columns = {
        "Time (UTC)": _rfc3339("ts"), "Agent": F.col("agent"), "Session": F.col("session"), "Project": F.col("project"),
        "Model": F.col("model"), "Input": text("input"), "Cached": text("cached"), "Cache write": text("cache_write"),
        "Output": text("output"), "Reasoning (included)": text("reasoning"), "Total": S.total_tokens().cast("string"),
        f"Estimated {currency}": S.display_cost("cost", currency, usd_cny), "Source": S.display_path("path"), "Line": text("line"),
    }
    return priced.select("ts", "id", *[S.csv_safe(e).alias(n) for n, e in columns.items()])


def export_csv(priced: DataFrame, path: str, currency: str = "USD", usd_cny: float | None = None) -> None:
    """CSV files in (ts, id) order: a range-partitioned sort, one file per range, all quoted."""
    ordered = export_rows(priced, currency, usd_cny).orderBy("ts", "id").drop("ts", "id")
    ordered.write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue=""
    ).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> Version:
    """Publishes all maintained tables as one version below ``path``: a reader gets all of them as of now or all as they were.

    Rows are dealt to writers by bytes (a rebalanced exchange splits what is large and joins what is small). Tables
    that are not given stay as they are in the version before.
    """
    spark = next(iter(tables.values())).sparkSession
    root = Tables(spark, path)
    root.clean()
    base = root.version()
    return root.publish(base, {name: root.write(name, table.hint("rebalance"), ()) for name, table in tables.items()})


def read_tables(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, by default the newest."""
    root = Tables(spark, path)
    version = root.version(number)
    return {name: root.read(version, name) for name in version.tables}
